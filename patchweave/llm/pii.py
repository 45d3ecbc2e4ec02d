"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

Patterns are those of the contract, made possessive and anchored to the starts of runs, which finds the same leftmost
non-overlapping matches in linear time. Validators: parts of an IP address up to 255, the Luhn sum of 16 to 19 digits,
8 to 15 digits of a phone number, mod 97 of an IBAN. Spans of email, ip, card and phone stay whatever their score;
iban and ssn spans are added where the score, with the words around them, reaches ADDED_SCORE.

A text is split at its matches; the lengths of the pieces give the positions (code points, end exclusive), summed in
blocks so that a text with very many matches stays cheap. There is no shuffle.

Defined results: a null or empty text has no spans; texts of any length are read whole; repeated rows get equal rows;
a null doc_id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import documents

ADDED_SCORE = 0.5
CONTEXT_CHARS = 40
#: Matches whose positions are summed at a time.
BLOCK = 256

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A string without which there is no match, to spare the search.
    needs: str
    #: SQL over v, the matched text.
    valid: str
    score: float
    words: str
    added: bool = False


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@", "true", 0.8, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"v rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$'", 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15,}+", "", "length(translate(v, ' -', '')) between 16 and 19 and luhn_check(translate(v, ' -', ''))", 0.9, "card|visa|master|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", "length(regexp_replace(v, '[^0-9]', '')) between 8 and 15", 0.6, "phone|tel|call|mobile|fax"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
        "",
        "aggregate(split(concat(substring(v, 5), substring(v, 1, 4)), ''), 0, (a, c) -> case when c = '' then a when c < 'A' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1",
        0.9,
        "iban|account|bank",
        True,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "v not rlike '^(000|666|9)|-00-|-0000$'", 0.3, r"ssn|social\W+security|tax\W+id", True),
)

_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"


def _positions(k: Kind) -> str:
    """SQL over the columns m_<kind> (matches) and p_<kind> (the pieces around them): the spans."""
    m, p = f"m_{k.name}", f"p_{k.name}"
    parts = f"transform({m}, (v, i) -> named_struct('g', cast({p}[i].n as bigint), 'l', cast(length(v) as bigint), 'v', v, 'near', concat({p}[i].tail, '\\n', {p}[i + 1].head)))"
    block = f"slice(x, cast(c * {BLOCK} + 1 as int), {BLOCK})"
    blocks = f"sequence(0, cast((size(x) - 1) div {BLOCK} as int))"
    sums = f"transform({blocks}, c -> aggregate({block}, 0L, (a, y) -> a + y.g + y.l))"
    bases = f"aggregate({sums}, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (a, s) -> named_struct('at', a.at + s, 'out', concat(a.out, array(a.at))), a -> a.out)"
    span = f"named_struct('kind', '{k.name}', 'start', a.at + y.g, 'end', a.at + y.g + y.l, 'value', y.v, 'score', least(1D, {k.score}D + case when lower(y.near) rlike '{k.words}' then 0.4D else 0D end))".replace("\\", "\\\\")
    one = f"aggregate({block}, named_struct('at', b[c], 'out', cast(array() as array<{_SPAN}>)), (a, y) -> named_struct('at', a.at + y.g + y.l, 'out', concat(a.out, array({span}))), a -> a.out)"
    # x and b are bound by one-element arrays, so that each is computed once.
    spans = f"flatten(transform(array({parts}), x -> flatten(transform(array({bases}), b -> flatten(transform({blocks}, c -> {one}))))))"
    keep = f"exists(array(s.value), v -> {k.valid})".replace("\\", "\\\\") + (f" and s.score >= {ADDED_SCORE}D" if k.added else "")
    return f"case when size({m}) = 0 then cast(array() as array<{_SPAN}>) else filter({spans}, s -> {keep}) end"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and pii: the spans of each text by kind (in the order of KINDS), then start."""
    t = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    none, pieces = "cast(array() as array<string>)", "cast(array() as array<struct<n:int,head:string,tail:string>>)"

    def matches(k: Kind) -> Column:
        found = F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))
        return (F.when(F.instr("t", k.needs) > 0, found).otherwise(F.expr(none)) if k.needs else found).alias(f"m_{k.name}")

    def around(k: Kind) -> Column:
        split = F.transform(F.split("t", k.pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.left(g, F.lit(CONTEXT_CHARS)).alias("head"), F.right(g, F.lit(CONTEXT_CHARS)).alias("tail")))
        return F.when(F.size(f"m_{k.name}") > 0, split).otherwise(F.expr(pieces)).alias(f"p_{k.name}")

    names = [f"m_{k.name}" for k in KINDS]
    found = texts.select("doc_id", "t", *map(matches, KINDS)).select("doc_id", *names, *map(around, KINDS))
    return found.select("doc_id", F.concat(*(F.expr(_positions(k)) for k in KINDS)).alias("pii"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if not k.added]
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return find(documents(spark, sf_dir)).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in base),
        F.sha2(F.array_join(F.transform(F.filter("pii", lambda x: x["kind"].isin(base)), text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", text), ",").alias("spans"),
    )
