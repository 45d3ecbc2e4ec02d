"""Chat formatting with a grammar round trip.

A conversation becomes a chain of units, one per turn:

    <<SYS>>text<</SYS>>   [INST]text[/INST]   <s>text</s>   [ROLE]role[/ROLE]text[/TURN]

for system, user, assistant and any other role. The parser is deterministic and strict: inside a text the next
control string has to be the closing one. A turn is first rendered as it is and parsed again; if that does not give
back the same role and text, control strings and backslashes in it are escaped and it is tried again.

Turns are rendered and checked where they lie; then a conversation's turns are a sorted stream in one task, which its
digests need, so memory is bound by one turn, not by one conversation.

Defined results: a null text or role counts as empty; rows whose conv_id is null form one conversation; ties of turn
are ordered by role, then text; a null turn comes first; repeated rows are turns of their own; an empty table gives
an empty result; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROLS = [*OPEN.values(), *CLOSE.values(), ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_CONFLICT = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE_OF = {v: k for k, v in OPEN.items()}

SEGMENTS = "conv_id long, position long, formatted string, escaped boolean, loss_start long, loss_end long"
TURNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class GrammarError(ValueError):
    """The text isn't a chain of whole units."""


def escape(text: str) -> str:
    """A backslash before each backslash, and after the first character of each control string."""
    return _CONFLICT.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int]:
    """A unit, and where its text starts."""
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role], len(OPEN[role])
    head = ROLE_OPEN + role + ROLE_CLOSE
    return head + text + TURN_CLOSE, len(head)


class Parser:
    """Reads turns from a formatted conversation that comes in chunks of any length, each character once."""

    def __init__(self) -> None:
        self.held: list[str] = []  # pieces of an open text that hold no control string
        self.buffer = ""
        self.expect = self.role = None

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        """The (role, text) turns that end in this chunk; GrammarError as soon as no text could follow that parses."""
        buffer, at = self.buffer + chunk, 0
        for m in _CONTROL.finditer(buffer):
            if self.expect is None:
                if m.start() > at:
                    raise GrammarError(f"text between turns: {buffer[at : at + 40]!r}")
                if m[0] in _ROLE_OF:
                    self.role = _ROLE_OF[m[0]]
                    self.expect = CLOSE[self.role]
                elif m[0] == ROLE_OPEN:
                    self.expect = ROLE_CLOSE
                else:
                    raise GrammarError(f"a turn can't start with {m[0]}")
            elif m[0] != self.expect:
                raise GrammarError(f"{m[0]} where {self.expect} is due")
            else:
                inner = unescape("".join([*self.held, buffer[at : m.start()]]))
                self.held = []
                if self.expect == ROLE_CLOSE:
                    self.role, self.expect = inner, TURN_CLOSE
                else:
                    yield self.role, inner
                    self.role = self.expect = None
            at = m.end()
        if self.expect is None:
            self.buffer = buffer[at:]
            if self.buffer and not any(c.startswith(self.buffer) for c in CONTROLS):
                raise GrammarError(f"text between turns: {self.buffer[:40]!r}")
        else:
            # A control string may have begun at the end.
            cut = max(at, len(buffer) - max(map(len, CONTROLS)) + 1)
            self.held.append(buffer[at:cut])
            self.buffer = buffer[cut:]

    def close(self) -> None:
        if self.expect is not None or self.buffer:
            raise GrammarError("an unfinished turn at the end")


def parse(chunks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation that comes in chunks of any length."""
    parser = Parser()
    for chunk in chunks:
        yield from parser.feed(chunk)
    parser.close()


def round_trip(role: str, text: str) -> tuple[str, int, int, bool]:
    """The unit that parses back to the same turn: (unit, start and end of its text, whether it was escaped)."""
    for escaped in (False, True):
        r, t = (escape(role), escape(text)) if escaped else (role, text)
        unit, start = render(r if role not in OPEN else role, t)
        try:
            if list(parse([unit])) == [(role, text)]:
                return unit, start, start + len(t), escaped
        except GrammarError:
            pass
    raise GrammarError(f"no rendering of {text[:80]!r} parses back")


_UNITS = "conv_id long, turn long, role string, formatted string, escaped boolean, text_start long, text_end long"
_UNIT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("escaped", pa.bool_()), ("text_start", pa.int64()), ("text_end", pa.int64())])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Renders each turn, wherever it lies."""
    for b in batches:
        done = [round_trip(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
        unit, start, end, escaped = zip(*done, strict=True) if done else ((),) * 4
        columns = [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(unit, pa.string()), pa.array(escaped, pa.bool_()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_UNIT_SCHEMA)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds positions to sorted turns; other columns pass as they are."""
    conv, position = object(), 0
    for b in batches:
        places = []
        for c in b.column("conv_id").to_pylist():
            conv, position = (c, position + 1) if c == conv else (c, 0)
            places.append(position)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(places, pa.int64()), *(b.column(n) for n in ("formatted", "escaped", "loss_start", "loss_end"))], names=[x.split()[0] for x in SEGMENTS.split(", ")])


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, position, formatted (the conversation's text is their concatenation), escaped, and the
    loss span in code points within formatted (null where the turn bears no loss). Turns are rendered and parsed again
    where they lie; a conversation meets in one task only to be put in order."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    units = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text")).mapInArrow(_format, _UNITS)
    # Only ties of turn and role look at the text.
    text = F.expr("substring(formatted, cast(text_start + 1 as int), cast(text_end - text_start as int))")
    text = F.when(F.col("escaped"), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)
    said = F.col("role") == "assistant"
    rows = units.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text)
    return rows.select("conv_id", "formatted", "escaped", F.when(said, F.col("text_start")).alias("loss_start"), F.when(said, F.col("text_end")).alias("loss_end")).mapInArrow(_number, SEGMENTS)


class _Reader:
    """Digests of one conversation, read from its formatted chunks as they come."""

    def __init__(self) -> None:
        self.chars = self.turns = self.loss = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.parser = Parser()

    def feed(self, chunk: str, start: int | None, end: int | None) -> None:
        """start and end: the chunk's loss span; what it holds is read from the text, whatever the role."""
        self.chars += len(chunk)
        if start is not None:
            said = unescape(chunk[start:end])
            self.loss += len(said)
            self.masked.update(said.encode())
        for role, text in self.parser.feed(chunk):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())

    def row(self, conv: int | None) -> tuple:
        self.parser.close()
        return conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    conv, reader = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for b in batches:
        rows = []
        for c, text, start, end in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if reader is None or c != conv:
                if reader is not None:
                    rows.append(reader.row(conv))
                conv, reader = c, _Reader()
            reader.feed(text, start, end)
        yield batch(rows)
    if reader is not None:
        yield batch([reader.row(conv)])


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation of format_turns, recovered from the formatted text: turns by the parser, the loss by its spans. The rows have to be in the order in which format_turns gives them."""
    return segments.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read, TURNS)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(source.unionByName(more)))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length({_sql_escape("text")}) + CASE role {" ".join(f"WHEN '{r}' THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN)}
    ELSE {len(ROLE_OPEN) + len(ROLE_CLOSE) + len(TURN_CLOSE)} + length({_sql_escape("role")}) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
