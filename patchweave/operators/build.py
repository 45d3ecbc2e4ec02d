"""A build: the streams of all sources become one store, with a list of what each source gave.

Advisories of all providers are one union, ratings of all annotators another, each written by one job. A build is all or
nothing: it is closed by its manifest, so where a provider or an annotator fails, readers keep the build before. A source
of enrichment may fail; the list says so.

A seed is a finished store. Its ratings are carried forward, but for sources that go stale, and a fresh rating replaces
the seed's of the same CVE and source; its windows are merged with those of this run. A build that only rates takes the
seed's advisories as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.operators import lifecycle as L
from patchweave.operators import store as S
from patchweave.operators.incremental import PERISHABLE, last_writes, merge_seed
from patchweave.tables import drop_table, write_table

ADVISORIES, RATINGS, ENRICHMENT = "advisories", "ratings", "enrichment"
#: The list of sources: gap tells that this run's slice doesn't reach the seed's, error why a source gave nothing.
SOURCES = "kind string, source string, records long, data_as_of timestamp, since timestamp, since_known boolean, until timestamp, gap boolean, error string"


@dataclass(frozen=True)
class Source:
    """One provider (advisories), annotator (ratings) or source of enrichment. load gives its rows: entries as the store
    keeps them; or cve, any columns, and perhaps load_seq, the order of writes within the source. since, until: the
    slice that this run covers; a null since with since_known: from the beginning."""

    name: str
    kind: str
    load: Callable[[SparkSession], DataFrame]
    since: datetime | None = None
    since_known: bool = True
    until: datetime | None = None
    data_as_of: datetime | None = None


def _stream(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The rows of several sources, with their place in the list and the order of their writes."""
    parts = []
    for place, s in enumerate(sources):
        rows = s.load(spark)
        order = F.col("load_seq").cast("long") if "load_seq" in rows.columns else F.lit(None).cast("long")
        named = rows if s.kind == ADVISORIES else rows.withColumn("source", F.lit(s.name))
        parts.append(named.withColumn("load_seq", F.struct(F.lit(place).alias("place"), order.alias("seq"))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _counts(rows: DataFrame) -> dict[str, int]:
    return {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # a row for each source


def _advisories(spark: SparkSession, path: str, sources: list[Source]) -> dict[str, int]:
    """Writes the union; of entries under one key the last provider's stays. How many entries each provider has there."""
    rows = write_table(last_writes(_stream(spark, sources), S.ENTRY, "load_seq").withColumn("source", F.element_at(F.array(*(F.lit(s.name) for s in sources)), F.col("load_seq.place") + 1)).drop("load_seq"), "build-advisories")
    counts = _counts(rows)
    if not counts:
        raise S.StoreError("the sources gave no advisories: the store would look clean for everything")
    S.write_affected(rows.drop("source"), path)
    drop_table(rows)
    return counts


def build(spark: SparkSession, path: str, sources: list[Source], built_at: str, seed: str | None = None, ratings_only: bool = False) -> int:
    """Makes a store of the sources and returns the build's number. StoreError, before anything is written, where two
    sources of a kind share a name, where no provider is there, or where ratings_only has no seed or no annotator."""
    of = {k: [s for s in sources if s.kind == k] for k in (ADVISORIES, RATINGS, ENRICHMENT)}
    if len({(s.kind, s.name) for s in sources}) < len(sources) or sum(map(len, of.values())) < len(sources):
        raise S.StoreError("a source is listed twice or is of no known kind")
    if ratings_only and (seed is None or not of[RATINGS]):
        raise S.StoreError("a build that only rates needs a seed for its advisories and a source of ratings")
    if not ratings_only and not of[ADVISORIES]:
        raise S.StoreError("no source of advisories: the store would look clean for everything")
    old = S.open_store(spark, seed, seed=True) if seed is not None else {}
    S.forget_pending(spark, path)

    listed = [r.asDict() for r in old["sources"].collect()] if "sources" in old else []  # a row for each source
    carried = {(r["kind"], r["source"]): r for r in listed}
    if ratings_only:
        S.write_affected(old["affected"].drop("eco_family"), path)
        entries = {s: r["records"] for (k, s), r in carried.items() if k == ADVISORIES}
    else:
        entries = _advisories(spark, path, of[ADVISORIES])

    plain = F.lit(0).cast("long").alias("load_seq")
    fresh = last_writes(_stream(spark, of[RATINGS]), ["cve", "source"], "load_seq").withColumn("load_seq", plain) if of[RATINGS] else None
    kept = old["ratings"].withColumn("load_seq", plain) if old else None
    if fresh is None:
        fresh = kept.limit(0) if kept is not None else spark.createDataFrame([], "cve string, source string, load_seq long")
    merged = fresh
    if kept is not None:
        missing = lambda a, b: a.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in b.schema if f.name not in a.columns))
        merged = merge_seed(missing(kept, fresh), missing(fresh, kept), ["cve", "source"])
    S.write_ratings(merged, path)

    errors: dict[str, str] = {}
    given = []
    for s in of[ENRICHMENT]:
        try:
            given.append(write_table(_stream(spark, [s]), "build-enrichment"))
        except Exception as e:  # noqa: BLE001  any failure of such a source is a row of the list
            errors[s.name] = " ".join(str(e).split())[:500]
    extra = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), given) if given else spark.createDataFrame([], "cve string, source string, load_seq long")
    S.write_enrichment(extra, path)
    counts = {ADVISORIES: entries, RATINGS: _counts(S.pending_table(spark, path, "ratings")), ENRICHMENT: _counts(S.pending_table(spark, path, "enrichment"))}
    for table in given:
        drop_table(table)

    window = "source string, since timestamp, since_known boolean, until timestamp"
    lasting = {s: r for (k, s), r in carried.items() if k == RATINGS and s not in PERISHABLE}
    seeded = spark.createDataFrame([(s, r["since"], r["since_known"], r["until"]) for s, r in lasting.items()], window)
    fetched = spark.createDataFrame([(s.name, s.since, s.since_known, s.until) for s in of[RATINGS]], window)
    windows = {r["source"]: r.asDict() for r in L.merge_windows(seeded, fetched).collect()}  # a row for each source

    rows: dict[tuple[str, str], dict] = {}
    for (kind, name), r in carried.items():
        if (kind == RATINGS and name in lasting) or (kind == ADVISORIES and ratings_only):
            rows[kind, name] = {**r, "gap": False, "error": None}
    for s in sources:
        if ratings_only and s.kind == ADVISORIES:
            continue
        w = windows[s.name] if s.kind == RATINGS else {"since": s.since, "since_known": s.since_known, "until": s.until, "gap": False}
        rows[s.kind, s.name] = {"kind": s.kind, "source": s.name, "data_as_of": s.data_as_of, "error": errors.get(s.name) if s.kind == ENRICHMENT else None, **w}
    names = [c.split()[0] for c in SOURCES.split(", ")]
    made = [{**r, "records": counts[kind].get(name, 0)} for (kind, name), r in rows.items()]
    S.write_sources(spark.createDataFrame([tuple(r[n] for n in names) for r in made], SOURCES), path)
    covered = spark.createDataFrame([(r["source"], r["since"], r["since_known"]) for r in made if r["kind"] == RATINGS], "source string, since timestamp, since_known boolean")
    return S.write_meta(spark, path, built_at, covered)
