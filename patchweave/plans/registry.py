"""Where queries and their SQL twins are registered."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, name: str | None = None):
    """Registers a query and its twin."""

    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE[name or f.__name__] = sql
        return f

    return add
