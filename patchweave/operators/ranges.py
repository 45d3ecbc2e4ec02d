"""Interval evaluation: does a version lie in a range of introduced, fixed and last_affected events?

A range is read declaratively. Its events are ordered by key ("0" first); an event is passed if the version is at or
above it (above it, for last_affected). The version is inside if the last event passed is an introduced one, and the
first upper bound after that event is the evidence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patchweave.functions import versions as V

EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>"
ANY_EARLIER = "any earlier version"
NO_EVENTS = "the range has no introduced, fixed or last_affected event"
BAD_BOUND = "the range bound %s could not be read"


_BOUND = "coalesce(nullif(e.introduced, ''), nullif(e.fixed, ''), nullif(e.last_affected, ''))"


def bounds(events: str) -> Column:
    """The version of each event of a column, null for a limit."""
    return F.coalesce(F.expr(f"transform({events}, e -> {_BOUND})"), F.array().cast("array<string>"))


def native_keys(comparer: str | None, versions: str) -> Column:
    """Keys of a column of version arrays by a fixed native comparer, or by the one that the column comparer names. The
    key's expression occurs once, whatever the number of versions."""
    return F.expr(f"transform({versions}, v -> {V.NATIVE[comparer]('v') if comparer else V.native_key('comparer', 'v')})")


def _events_sql(events: str, keys: str) -> str:
    """Sorted events with their keys, an array in the order of the events: array<struct<rank,key,i,kind,bound,zero>>."""
    bound = _BOUND
    kind = "case when e.introduced <> '' then 'introduced' when e.fixed <> '' then 'fixed' when e.last_affected <> '' then 'last_affected' else 'limit' end"
    value = f"get({keys}, i)"
    rank = f"case when {bound} is null then 2 when {bound} = '0' then 0 else 1 end"
    return f"array_sort(transform({events}, (e, i) -> named_struct('rank', {rank}, 'key', case when {bound} <> '0' then {value} else '' end, 'i', i, 'kind', {kind}, 'bound', {bound}, 'zero', case when {bound} = '0' then {value} end)))"


def prepared(events: str, event_keys: str) -> Column:
    """Sorted events with their keys, which depend on the advisory alone: compute them before a join."""
    return F.expr(_events_sql(f"`{events}`", f"`{event_keys}`"))


def hit_reason(version: str, introduced: Column | str, fixed: Column | str, last_affected: Column | str) -> Column:
    """Why a version is affected, in words."""
    bound, fix, last = (F.col(c) if isinstance(c, str) else c for c in (introduced, fixed, last_affected))
    low = F.when(bound == "0", ANY_EARLIER).otherwise(bound)
    return (
        F.when(fix.isNotNull(), F.format_string("%s is at or above %s and below the fix %s", version, low, fix))
        .when(last.isNotNull(), F.format_string("%s is at or above %s and at or below %s", version, low, last))
        .otherwise(F.format_string("%s is at or above %s, with no fixed version recorded", version, low))
    )


def evaluate(rows: DataFrame, version: str, events: str | None = None, comparer: str | None = None, range_type: str | None = None, key: str | None = None, event_keys: str | None = None, ready: str | None = None, out: str = "outcome") -> DataFrame:
    """Adds out: struct(kind 'hit' | 'miss' | 'error', cause, introduced, fixed, last_affected, reason).

    Columns are given by name; keys come from a fixed native comparer, or from the columns key and event_keys, or key
    and ready (of prepared()). Causes
    of an error: 'advisory' for an unreadable bound or a range without events, 'target' for an unreadable version that
    a bound had to be compared with. A range of type GIT is always a miss.
    """
    if comparer:
        rows = rows.withColumn("__all", F.concat(F.array(version), bounds(events))).withColumn("__k", native_keys(comparer, "__all"))
        rows = rows.withColumn("__v", F.get("__k", F.lit(0))).withColumn("__ek", F.expr("slice(__k, 2, size(__k))")).drop("__all", "__k")
        event_keys = "__ek"
    else:
        rows = rows.withColumn("__v", F.col(key))
    rows = rows.withColumn("__e", F.col(ready) if ready else prepared(events, event_keys))
    git = F.col(range_type) == "GIT" if range_type else F.lit(False)
    rows = rows.withColumn("__bad", F.expr("get(transform(filter(__e, e -> e.rank = 1 and e.key is null), e -> e.bound), 0)"))
    at = "case when e.bound = '0' and e.kind <> 'introduced' then e.zero else e.key end"
    passed = f"case e.kind when 'introduced' then e.rank = 0 or __v >= e.key when 'fixed' then __v >= {at} when 'last_affected' then __v > {at} else false end"
    rows = rows.withColumn("__last", F.expr(f"try_element_at(filter(transform(__e, (e, n) -> named_struct('n', n, 'kind', e.kind, 'bound', e.bound, 'passed', coalesce({passed}, false))), e -> e.passed), -1)"))
    rows = rows.withColumn("__next", F.expr("get(filter(transform(__e, (e, n) -> named_struct('n', n, 'kind', e.kind, 'bound', e.bound)), e -> e.n > __last.n and e.kind in ('fixed', 'last_affected')), 0)"))
    compared = F.expr(f"exists(__e, e -> e.kind in ('fixed', 'last_affected') and ({at}) is null or e.kind <> 'limit' and not (e.kind = 'introduced' and e.rank = 0) and __v is null)")
    branch = F.expr(f"startswith(coalesce(__v, ''), '{V.BRANCH}') or exists(__e, e -> startswith(coalesce(e.key, ''), '{V.BRANCH}'))")
    unordered = branch & F.expr("exists(__e, e -> e.rank = 1 and e.key <> __v)")
    none = F.lit(None).cast("string")
    hit = F.col("__last.kind") == "introduced"
    fixed, last = (F.when(F.col("__next.kind") == x, F.col("__next.bound")) for x in ("fixed", "last_affected"))
    reason = hit_reason(version, F.col("__last.bound"), fixed, last)

    def outcome(kind: str, cause: Column = none, why: Column = none, **bounds: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), cause.alias("cause"), *(bounds.get(b, none).alias(b) for b in ("introduced", "fixed", "last_affected")), why.alias("reason"))

    empty = F.expr("not exists(__e, e -> e.rank < 2)")
    result = (
        F.when(git, outcome("miss"))
        .when(empty, outcome("error", F.lit("advisory"), F.lit(NO_EVENTS)))
        .when(F.col("__bad").isNotNull(), outcome("error", F.lit("advisory"), F.format_string(BAD_BOUND, F.col("__bad"))))
        .when(compared | F.coalesce(unordered, F.lit(False)), outcome("error", F.lit("target"), F.format_string("the version %s could not be read", version)))
        .when(hit, outcome("hit", why=reason, introduced=F.col("__last.bound"), fixed=fixed, last_affected=last))
        .otherwise(outcome("miss"))
    )
    return rows.withColumn(out, result).drop("__v", "__e", "__bad", "__last", "__next", *(["__ek"] if comparer else []))


def intervals(ready: str) -> Column:
    """Of a column of prepared() events the intervals of keys that are inside, so that a join compares columns only:
    array<struct<low (null: no lower end),high (null: no upper end),closed (high belongs to it),introduced,fixed,
    last_affected>>; empty where a bound can't be read or nothing is introduced."""
    later = f"filter({ready}, (y, m) -> m > n and y.rank < 2)"
    nxt = f"get({later}, 0)"
    upper = f"get(filter({later}, y -> y.kind <> 'introduced'), 0)"
    at = lambda e: f"coalesce({e}.zero, {e}.key)"
    closed = f"forall(filter({later}, y -> {at('y')} = {at('z')}), y -> y.kind = 'last_affected')"
    body = f"named_struct('low', case when x.rank = 1 then x.key end, 'high', {at('z')}, 'closed', {closed}, 'introduced', x.bound, 'fixed', case when u.kind = 'fixed' then u.bound end, 'last_affected', case when u.kind = 'last_affected' then u.bound end)"
    one = f"case when x.kind = 'introduced' then get(transform(array({nxt}), z -> get(transform(array({upper}), u -> {body}), 0)), 0) end"
    readable = f"forall({ready}, e -> e.rank = 2 or (e.rank = 0 and (e.kind = 'introduced' or e.zero is not null)) or e.key is not null)"
    return F.expr(f"case when {readable} then filter(transform({ready}, (x, n) -> {one}), i -> i is not null) else filter(array(named_struct('low', '', 'high', '', 'closed', false, 'introduced', '', 'fixed', '', 'last_affected', '')), i -> false) end")


def inside(key: str, interval: str) -> Column:
    """Whether a key lies in an interval of intervals(). A version without a key is inside only where no bound has to be
    compared with it."""
    k, i = F.col(key), lambda f: F.col(f"{interval}.{f}")
    return (i("low").isNull() | (k >= i("low"))) & (i("high").isNull() | (k < i("high")) | (i("closed") & (k == i("high"))))


OUTCOME = StructType([StructField(n, StringType()) for n in ("kind", "cause", "introduced", "fixed", "last_affected", "reason")])


@F.pandas_udf(OUTCOME)
def evaluate_maven(version: pd.Series, events: pd.Series) -> pd.DataFrame:
    """The same outcome by pairwise comparison; apply it to distinct (version, events)."""
    rows = []
    for v, es in zip(version, events, strict=True):
        rows.append(walk(v, [] if es is None else [e if isinstance(e, dict) else e.asDict() for e in es], V.maven_compare))
    return pd.DataFrame(rows, columns=OUTCOME.names)


def walk(v: str, events: list[dict], compare) -> tuple:
    """One range in plain Python, for orderings without keys and for tests. compare(a, b) is None where one is unreadable."""
    import functools

    kinds = ("introduced", "fixed", "last_affected")
    read = [(next((k for k in kinds if e.get(k)), None), next((e[k] for k in kinds if e.get(k)), None)) for e in events]
    bounds = [(k, b) for k, b in read if k]
    if not bounds:
        return ("error", "advisory", None, None, None, NO_EVENTS)
    for _, b in bounds:
        if b != "0" and compare(b, b) is None:
            return ("error", "advisory", None, None, None, BAD_BOUND % b)
    order = sorted(bounds, key=functools.cmp_to_key(lambda x, y: (x[1] != "0") - (y[1] != "0") or (0 if x[1] == "0" else compare(x[1], y[1]) or 0)))
    last = None
    for n, (k, b) in enumerate(order):
        if k == "introduced" and b == "0":
            last = n
            continue
        c = compare(v, b)
        if c is None:
            return ("error", "target", None, None, None, f"the version {v} could not be read")
        if c > 0 or (c == 0 and k != "last_affected"):
            last = n
    if last is None or order[last][0] != "introduced":
        return ("miss", None, None, None, None, None)
    upper = next(((k, b) for k, b in order[last + 1 :] if k != "introduced"), (None, None))
    low = ANY_EARLIER if order[last][1] == "0" else order[last][1]
    tail = {"fixed": f" and below the fix {upper[1]}", "last_affected": f" and at or below {upper[1]}", None: ", with no fixed version recorded"}[upper[0]]
    return ("hit", None, order[last][1], upper[1] if upper[0] == "fixed" else None, upper[1] if upper[0] == "last_affected" else None, f"{v} is at or above {low}{tail}")
