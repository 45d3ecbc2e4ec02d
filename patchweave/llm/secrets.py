"""Secret scans: rules, and character Markov models of random strings and of ordinary identifiers.

Two order-1 models over the characters of tokens are trained from labelled samples: random strings (drawn from the
alphabets that keys use) and identifiers (words of a bounded sample of the corpus, joined as programmers do). A token
is reported as 'random' where the mean log-likelihood ratio per character is above a cut that is set on the labelled
samples. The rules' spans (assign, access, hex) are always kept; they carry the ratio as their score.

Whole texts are scanned, in one pass without a shuffle.

Defined results: a null or empty text has no spans; a text of any length is scanned whole; repeated rows get equal
rows; a null doc_id stays null; an empty table gives an empty result and leaves the identifiers' model to the built-in
names; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import documents

KINDS = ("assign", "access", "hex", "random")
#: The rules of the contract.
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones are just those that the rule drops
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_AT = {c: i for i, c in enumerate(CHARS)}
_END = len(CHARS)
#: Bounds of the training sample.
SAMPLE_DOCUMENTS, SAMPLE_WORDS, SAMPLE_RANDOM = 300, 20_000, 4_000
_NAMES = ["get", "set", "user", "name", "index", "value", "count", "list", "map", "file", "path", "read", "write", "open", "close", "start", "stop", "config", "option", "default", "error", "message", "handler", "request", "response", "session", "table", "column", "filter", "query", "update", "delete", "create", "insert", "buffer", "stream", "parse", "format", "version", "package"]


@dataclass
class TokenModel:
    """Log-likelihood ratios of transitions, random over identifier, and the cut per character."""

    ratio: np.ndarray
    cut: float

    def score(self, token: str) -> float:
        at = [_END, *(_AT.get(c, _END) for c in token), _END]
        return float(self.ratio[at[:-1], at[1:]].sum()) / (len(at) - 1)


def transitions(samples: Iterable[str]) -> np.ndarray:
    """Log probabilities of the next character, add-one smoothed; row and column _END stand for the ends."""
    counts = np.ones((_END + 1, _END + 1))
    for s in samples:
        at = np.array([_END, *(_AT.get(c, _END) for c in s), _END])
        np.add.at(counts, (at[:-1], at[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def random_strings(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", CHARS[:62], CHARS[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 11) -> list[str]:
    """Names of 20 characters or more as programmers join words, paths and numbers."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        name, style = "", rng.randrange(5)
        while len(name) < 20:
            w = rng.choice(words)
            name += {0: w.capitalize(), 1: ("_" if name else "") + w.lower(), 2: ("-" if name else "") + w.lower(), 3: ("_" if name else "") + w.upper(), 4: ("/" if name else "") + w.lower()}[style]
        out.append(name + (f"_{rng.randrange(2100)}" if rng.random() < 0.2 else ""))
    return out


def fit(positive: list[str], negative: list[str]) -> TokenModel:
    """Trains on nine of ten samples; the cut lies midway between the classes' nearest scores on the tenth, errors aside."""
    held = lambda xs: (xs[::10], [x for i, x in enumerate(xs) if i % 10])
    (p_held, p), (n_held, n) = held(positive), held(negative)
    model = TokenModel(transitions(p) - transitions(n), 0.0)
    scores = sorted([(model.score(x), 1) for x in p_held] + [(model.score(x), 0) for x in n_held])
    # An identifier called random counts five times.
    missed, wrong, best = 0, sum(not y for _, y in scores), []
    before = scores[0][0] - 1
    for s, y in scores:
        best.append((missed + 5 * wrong, before - s, (before + s) / 2))
        missed, wrong, before = missed + y, wrong - (not y), s
    model.cut = max(min(best)[2], 0.0)
    return model


def sample_words(docs: DataFrame) -> list[str]:
    """Distinct ASCII words from a bounded sample of documents, for the identifiers' model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({w for t in b.column("text").to_pylist() for w in re.findall(r"(?<![A-Za-z0-9])[A-Za-z]{3,12}(?![A-Za-z0-9])", t or "")})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    picked = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")
    words = texts.mapInArrow(run, "word string").distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()
    return sorted(r.word for r in words)


def train(docs: DataFrame) -> TokenModel:
    words = sample_words(docs) + _NAMES
    return fit(random_strings(SAMPLE_RANDOM), identifiers(words, SAMPLE_RANDOM))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def model_spans(text: str, base: list[tuple[int, int, int]], model: TokenModel) -> list[tuple[int, int, int, float]]:
    """Tokens outside the rules' spans that look random."""
    out, covered, k = [], sorted((a, b) for a, _, b in base), 0
    for m in _TOKEN.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] < m.end():
            continue
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and (s := model.score(token)) > model.cut:
            out.append((m.start(), 3, m.end(), s))
    return out


SPANS = "doc_id long, secrets array<struct<kind:string,start:long,end:long,score:double>>"


def scan(docs: DataFrame, model: TokenModel) -> DataFrame:
    """doc_id and secrets: all spans by start, then kind, with their score (mean log-likelihood ratio per character)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of 70 x 70
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                spans = [(a, k, e, model.score(text[a:e])) for a, k, e in base] + model_spans(text or "", base, model)
                rows.append([{"kind": KINDS[k], "start": a, "end": e, "score": s} for a, k, e, s in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, train(docs))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", text), ",").alias("spans"),
    )
