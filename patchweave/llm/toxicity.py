"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): all thresholds share the weights w over sparse text features: words and
character 4-grams of words (with their ends marked), by the number of distinct words that have them. The report is
the expected grade.

Grades come from the labels: 0 where toxic is 0; a toxic document is grade 2 where it has more indicator features
(those that the labels tie to toxicity) than the median of the toxic training documents, else grade 1.

Training takes at most MAX_PER_CLASS labelled documents of each class, chosen by a hash of doc_id, and MAX_FEATURES
features; both bounds are parameters. Scoring reads whole texts of all documents and is one pass without a shuffle.

Defined results: a null or empty text has no features and gets the score of the thresholds alone; labels that are null
or contradict each other within a document are counted as the larger; with labels of one class only, nothing is
known, so every document has expected severity 0; an empty table gives an empty result; a null doc_id is scored as
any other; repeated rows get equal scores; further columns are ignored by the report and kept by keep_rows().
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from patchweave.llm.common import documents, write_table

MAX_PER_CLASS = 4_000
MAX_FEATURES = 2_048
MIN_DOCUMENTS = 3
#: Features whose rates in the two classes differ by fewer standard errors are left out.
MIN_Z = 4.0
#: Features are kept if the log odds ratio is at least this and they occur in this share of the toxic sample.
MIN_LOG_ODDS, MIN_SHARE = 2.0, 0.02
#: A gram in that many distinct words of a text is a feature of its own, for each of these numbers.
LEVELS = (1, 2, 3, 5)
_WORDS = re.compile(r"[^\W\d_]+")
#: Words whose features a task remembers; workers keep the memory for the stages that follow.
_CACHE = 100_000


def word_features(word: str) -> list[int]:
    """Hashed grams of a word: itself and the character 4-grams of ^word$."""
    marked = f"^{word}$"
    grams = {marked, *(marked[i : i + 4] for i in range(len(marked) - 3))}
    return [zlib.crc32(g.encode()) & 0x7FFFFFFF for g in grams]


def level(gram: int, k: int) -> int:
    """The feature of a gram in k distinct words at least."""
    return gram if k == 1 else (gram ^ k * 0x2545F491) & 0x7FFFFFFF


def features(grams: Iterable[int]) -> set[int]:
    """Features of a text from the grams of its distinct words."""
    return {level(g, k) for g, n in Counter(grams).items() for k in LEVELS if n >= k}


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """Feature -> weight, and ascending thresholds; no thresholds: nothing was learned."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    #: The expected grade from which a document is called toxic.
    cut: float = 0.5

    def expected(self, features: set[int]) -> tuple[float, int]:
        """Expected grade and most likely grade."""
        if not self.thresholds:
            return 0.0, 0
        s = math.fsum(self.weights[f] for f in features)
        below = [1 / (1 + math.exp(-max(-500.0, min(500.0, t - s)))) for t in self.thresholds]
        p = [b - a for a, b in zip([0.0, *below], [*below, 1.0], strict=True)]
        return math.fsum(k * x for k, x in enumerate(p)), max(range(len(p)), key=lambda k: p[k])


def fit(rows: list[list[int]], grades: list[int], columns: list[int], l2: float = 1e-3, steps: int = 400, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by Adam over the whole sample; rows: sorted positions in columns."""
    present = sorted(set(grades))
    if len(present) < 2:
        return OrdinalModel()
    top, n = max(grades), len(rows)
    y = np.array(grades)
    lens = np.array([len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum()))
    owner = np.repeat(np.arange(n), lens)
    balance = np.array([n / (len(present) * max(1, (y == g).sum())) for g in range(top + 1)])[y]
    # Parameters: weights, the first threshold, logarithms of the gaps between thresholds.
    theta = np.zeros(len(columns) + top)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(columns)

    def cuts(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[t[k], np.exp(t[k + 1 :])])

    for step in range(1, steps + 1):
        s = np.bincount(owner, theta[flat], n)
        edge = np.r_[-np.inf, cuts(theta), np.inf]
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(np.clip(s - edge[y + 1], -500, 500))), 1 / (1 + np.exp(np.clip(s - edge[y], -500, 500)))
        hi, lo = np.where(y == top, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p * balance / n, lo * (1 - lo) / p * balance / n
        g_score = d_hi - d_lo  # of the loss by the score
        grad = np.zeros_like(theta)
        grad[:k] = np.bincount(flat, g_score[owner], k) + l2 * theta[:k]
        by_cut = np.array([-d_hi[y == c].sum() + d_lo[y == c + 1].sum() for c in range(top)])
        grad[k] = by_cut.sum()
        for c in range(1, top):
            grad[k + c] = by_cut[c:].sum() * np.exp(theta[k + c])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel({c: float(w) for c, w in zip(columns, theta, strict=False) if abs(w) > 1e-9}, [float(x) for x in cuts(theta)])


def calibrate(model: OrdinalModel, rows: list[tuple[set[int], bool]]) -> float:
    """The cut with the fewest errors on the sample, a clean document called toxic counting twice; of equal ones, amid the widest gap."""
    found = sorted((model.expected({f for f in fs if f in model.weights})[0], toxic) for fs, toxic in rows)
    missed, wrong, before, options = 0, sum(not t for _, t in found), 0.0, []
    for value, group in itertools.groupby(found, key=lambda x: x[0]):
        options.append((missed + 2 * wrong, before - value, (before + value) / 2))
        for _, toxic in group:
            missed, wrong = missed + toxic, wrong - (not toxic)
        before = value
    return min(options)[2]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [sorted(features(g for w in words(t) for g in word_features(w))) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "features"])


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fits the model on a bounded sample of labelled documents."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("toxic <> 0").orderBy(*order).limit(max_per_class).unionByName(known.filter("toxic = 0").orderBy(*order).limit(max_per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text")
    sample = write_table(texts.mapInArrow(_sample_features, "toxic int, features array<int>"), "op1-sample")
    totals = {bool(r.toxic): r["count"] for r in sample.withColumn("toxic", F.col("toxic") != 0).groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return OrdinalModel()
    pos, neg = totals[True], totals[False]
    counts = sample.select(F.explode("features").alias("f"), (F.col("toxic") != 0).cast("int").alias("t")).groupBy("f").agg(F.sum("t").alias("p"), F.sum(1 - F.col("t")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (neg - F.col("n") + 0.5))
    rate = (F.col("p") + F.col("n")) / (pos + neg)
    z = (F.col("p") / pos - F.col("n") / neg) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / pos + 1 / neg))
    chosen = counts.filter(F.col("p") + F.col("n") >= MIN_DOCUMENTS).select("f", "p", z.alias("z"), odds.alias("odds")).filter((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_LOG_ODDS) & (F.col("p") >= MIN_SHARE * pos)).orderBy(F.abs("z").desc(), "f").limit(max_features).collect()
    columns = sorted(r.f for r in chosen)
    at = {f: i for i, f in enumerate(columns)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, hits = [], []
            for fs in b.column("features").to_pylist():
                kept.append([at[f] for f in fs if f in at])
                hits.append(len(kept[-1]))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(kept, pa.list_(pa.int32())), pa.array(hits, pa.int32())], names=["toxic", "at", "hits"])

    rows = sample.mapInArrow(project, "toxic int, at array<int>, hits int").collect()
    rows.sort(key=lambda r: (r.toxic, r.hits, r["at"]))
    middle = float(np.median([r.hits for r in rows if r.toxic]))
    model = fit([r["at"] for r in rows], [0 if not r.toxic else 1 + int(r.hits > middle) for r in rows], columns)
    model.cut = calibrate(model, [({columns[i] for i in r["at"]}, bool(r.toxic)) for r in rows])
    return model


def _scorer(model: OrdinalModel):
    """text -> (expected grade, grade); remembers the words' features, a bounded number of them."""
    cache: dict[str, tuple[int, ...]] = {}
    weights = model.weights
    grams = {level(f, k) for f in weights for k in LEVELS}  # level() undoes itself

    def score(text: str | None) -> tuple[float, int]:
        ws = words(text)
        if len(cache) > _CACHE:
            cache.clear()
        for w in ws:
            if w not in cache:
                cache[w] = tuple(g for g in word_features(w) if g in grams)
        return model.expected({f for f in features(g for w in ws for g in cache[w]) if f in weights})

    return score


def add_severity(docs: DataFrame, model: OrdinalModel, columns: tuple[str, ...] = ("expected_severity", "grade", "toxic")) -> DataFrame:
    """docs with three more columns of the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        score = _scorer(model)
        for b in batches:
            found = [score(t) for t in b.column(names.index("text")).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] >= model.cut for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, *columns])

    types = (DoubleType(), IntegerType(), BooleanType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, t) for c, t in zip(columns, types, strict=True))]))


def keep_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose expected severity is below the model's cut."""
    scored = add_severity(docs, train(docs, labels), ("__expected_severity", "__grade", "__toxic"))
    return scored.filter("not __toxic").drop("__expected_severity", "__grade", "__toxic")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, grade, toxic and kept of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return add_severity(docs.select("doc_id", "text"), model).select("doc_id", "expected_severity", "grade", "toxic", (~F.col("toxic")).alias("kept"))
