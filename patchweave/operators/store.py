"""The advisory store: Parquet tables in folders of their own, and numbered manifests that say which of them are current.

A write goes to a new folder and changes nothing that is read. write_meta() closes a build: it derives what is covered
and puts down the next manifest, which names the folders of all tables at once. A reader takes the last manifest and so
sees one build, whole, whatever is written meanwhile; a store without a manifest is unfinished. Older builds stay
readable by their number until vacuum().

Entries are keyed by (database, advisory_id, aff_ord), so records of different databases under one id stay apart. Ranges
with their keys, sorted and read once per build, can be kept in buckets of (ecosystem, name), where a join with the
names of an inventory moves the inventory alone.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.operators import lifecycle as L
from patchweave.operators import matching as M
from patchweave.operators.incremental import last_writes

SCHEMA_VERSION = 1
#: Buckets of the keyed ranges: as many as a large store's tasks.
BUCKETS = 64
#: What a table holds at most of one row group's distinct names, for the filters that let a lookup pass groups by.
BLOOM_NAMES = 1_000_000
ENTRY = ["database", "advisory_id", "aff_ord"]


class StoreError(ValueError):
    """The store is missing, unfinished or of another version."""


# ---- folders and manifests ----


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there; fails where the place is taken."""
    p, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(beside, p):
        fs.delete(beside, False)
        raise StoreError(f"{path} is there already: another build was closed meanwhile")


def _get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def builds(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the builds that can be read, in ascending order."""
    p, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-([0-9]+)\.json", n)))


def manifest(spark: SparkSession, path: str, build: int | None = None) -> dict:
    known = builds(spark, path)
    if not known or build not in (None, *known):
        raise StoreError(f"no finished store at {path}")
    return json.loads(_get(spark, f"{path}/manifest-{(known[-1] if build is None else build):08d}.json"))


def _pending(spark: SparkSession, path: str) -> dict[str, dict]:
    """Tables written since the last manifest, the last write of each."""
    p, fs = _fs(spark, f"{path}/pending")
    names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
    return {n.split("~")[1]: json.loads(_get(spark, f"{path}/pending/{n}")) for n in names if n.endswith(".json")}


def forget_pending(spark: SparkSession, path: str) -> None:
    """No later build takes up what an unfinished one wrote; vacuum() deletes it."""
    p, fs = _fs(spark, f"{path}/pending")
    fs.delete(p, True)


def _announce(spark: SparkSession, path: str, table: str, about: dict) -> None:
    p, fs = _fs(spark, f"{path}/pending")
    n = len(fs.listStatus(p)) if fs.exists(p) else 0
    _put(spark, f"{path}/pending/{n:08d}~{table}~{uuid.uuid4().hex}.json", json.dumps(about))


def _write(df: DataFrame, path: str, table: str, partition_by: tuple[str, ...] = (), bloom: tuple[str, ...] = ()) -> None:
    at = f"{path}/data/{table}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(*partition_by)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", BLOOM_NAMES)
    w.parquet(at)
    _announce(df.sparkSession, path, table, {"path": at})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes what only older builds than the last keep ones use, and tables that no build took up; how many folders."""
    numbers = builds(spark, path)
    for n in numbers[:-keep]:
        p, fs = _fs(spark, f"{path}/manifest-{n:08d}.json")
        fs.delete(p, False)
    used = {t["path"].rstrip("/").rsplit("/", 1)[-1] for n in numbers[-keep:] for t in manifest(spark, path, n)["tables"].values()}
    p, fs = _fs(spark, f"{path}/data")
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in used]
    for f in gone:
        fs.delete(f, True)
    return len(gone)


# ---- tables ----


def write_affected(affected: DataFrame, path: str) -> None:
    """Entries clustered by family and sorted by name, with filters on names, so that a lookup reads few row groups."""
    family = F.substring_index("ecosystem", ":", 1)
    rows = affected.withColumn("eco_family", family).repartitionByRange("eco_family", "ecosystem", "name").sortWithinPartitions("ecosystem", "name")
    _write(rows, path, "affected", ("eco_family",), ("name", "advisory_id"))


def write_ratings(ratings: DataFrame, path: str) -> None:
    """The last write of each (cve, source); ratings carry load_seq."""
    _write(last_writes(ratings, ["cve", "source"], "load_seq").repartitionByRange("cve").sortWithinPartitions("cve"), path, "ratings", (), ("cve",))


def write_enrichment(enrichment: DataFrame, path: str) -> None:
    """The last write of each (cve, source); enrichment carries load_seq."""
    _write(last_writes(enrichment, ["cve", "source"], "load_seq"), path, "enrichment")


def write_provenance(provenance: DataFrame, path: str) -> None:
    """What each source's steps read and left out (telemetry.PROVENANCE)."""
    _write(provenance.coalesce(1), path, "provenance")


def write_sources(sources: DataFrame, path: str) -> None:
    """What each source of a build gave (build.SOURCES)."""
    _write(sources.coalesce(1), path, "sources")


def pending_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table that was written since the last manifest."""
    return spark.read.parquet(_pending(spark, path)[table]["path"])


def write_keyed(affected: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The entries' ranges with their keys, in buckets of (ecosystem, name)."""
    spark, at, name = affected.sparkSession, f"{path}/data/keyed-{uuid.uuid4().hex}", f"keyed_{uuid.uuid4().hex}"
    rows = M._keyed_ranges(affected)
    rows.repartition(buckets, *M._NAME).write.format("parquet").bucketBy(buckets, *M._NAME).sortBy(*M._NAME).option("path", at).saveAsTable(name)
    _announce(spark, path, "keyed", {"path": at, "buckets": buckets, "schema": rows._jdf.schema().toDDL()})


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The keyed ranges; the session's catalogue gets to know their buckets."""
    about = manifest(spark, path)["tables"]["keyed"]
    name = about["path"].rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    by = ", ".join(M._NAME)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({about['schema']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{about['path']}'")
    return spark.table(name)


def write_meta(spark: SparkSession, path: str, built_at: str, windows: DataFrame | None = None) -> int:
    """Closes the build and returns its number. windows (source, since, since_known): from when on each rating source is
    covered; null since with since_known: from the beginning."""
    known = builds(spark, path)
    tables, pending = manifest(spark, path)["tables"] if known else {}, _pending(spark, path)
    if "affected" in pending:
        tables.pop("keyed", None)  # the ranges of other entries
    tables = {**tables, **pending}
    lacking = {"affected", "ratings"} - set(tables)
    if lacking:
        raise StoreError(f"no {' and no '.join(sorted(lacking))} were written")
    entries, ratings = (spark.read.parquet(tables[t]["path"]) for t in ("affected", "ratings"))
    e = entries.agg(F.array_sort(F.collect_set("ecosystem")), F.array_sort(F.collect_set("database"))).first()  # catalogues
    counts = {r["source"]: r["count"] for r in ratings.groupBy("source").count().collect()}
    bound = L.narrowest_window(windows).first() if windows is not None else None
    row = [(SCHEMA_VERSION, built_at, e[0], e[1], counts, None if bound is None else bound["since"], bound is not None and bool(bound["since_known"]))]
    at = f"{path}/data/meta-{uuid.uuid4().hex}"
    spark.createDataFrame(row, META).coalesce(1).write.parquet(at)
    number = (known[-1] if known else 0) + 1
    _put(spark, f"{path}/manifest-{number:08d}.json", json.dumps({"build": number, "schema": SCHEMA_VERSION, "tables": {**tables, "meta": {"path": at}}}))
    forget_pending(spark, path)
    return number


META = "schema int, built_at string, ecosystems array<string>, databases array<string>, rating_counts map<string,long>, ratings_since timestamp, ratings_since_known boolean"


def open_store(spark: SparkSession, path: str, build: int | None = None, seed: bool = False) -> dict[str, DataFrame]:
    """The tables of one build, the last one by default. A store that is read for its matches has this version of the
    schema; one that only seeds another may be one version behind."""
    m = manifest(spark, path, build)
    if m["schema"] not in ((SCHEMA_VERSION, SCHEMA_VERSION - 1) if seed else (SCHEMA_VERSION,)):
        raise StoreError(f"schema {m['schema']}, not {SCHEMA_VERSION}")
    return {t: spark.read.parquet(about["path"]) for t, about in m["tables"].items() if t != "keyed"}


def publish(spark: SparkSession, path: str, to: str) -> int:
    """A compact copy of a finished store, without the enrichment, which is never published."""
    tables = open_store(spark, path)
    _write(tables["affected"].repartitionByRange("eco_family", "ecosystem", "name").sortWithinPartitions("ecosystem", "name"), to, "affected", ("eco_family",), ("name", "advisory_id"))
    _write(tables["ratings"].repartitionByRange("cve").sortWithinPartitions("cve"), to, "ratings", (), ("cve",))
    meta = tables["meta"].first()
    window = spark.createDataFrame([("all", meta["ratings_since"], meta["ratings_since_known"])], "source string, since timestamp, since_known boolean")
    return write_meta(spark, to, meta["built_at"], window)


def status(store: dict[str, DataFrame], today: str, most_days: int = 7) -> DataFrame:
    """A store's state by source: ratings, share of all, built_at, age in days and whether it is too old."""
    m = store["meta"].select("built_at", F.explode("rating_counts").alias("source", "ratings"))
    total = store["meta"].select(F.aggregate(F.map_values("rating_counts"), F.lit(0).cast("long"), lambda a, x: a + x)).first()[0]
    built = F.try_to_date(F.substring("built_at", 1, 10))
    return m.select("source", "ratings", (F.col("ratings") / F.lit(float(total or 1))).alias("share"), "built_at", F.date_diff(F.lit(today).cast("date"), built).alias("age_days"), L.too_old(built, F.lit(today), most_days).alias("too_old"))


def lookup(affected: DataFrame, ecosystem: str, name: str) -> DataFrame:
    """The entries of one package; partitions, row groups and their filters let it pass by most of the table."""
    return affected.filter((F.col("eco_family") == ecosystem.split(":")[0]) & (F.col("ecosystem") == ecosystem) & (F.col("name") == name))


# ---- two builds ----


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change ('added', 'removed', 'changed') of what two tables don't share. Rows are told apart by a hash of
    their other columns; rows that repeat a key are compared as a whole. Hashes fold before the shuffle, and no content
    is moved."""
    rest = [F.to_json(F.struct(c)) for c in sorted(set(old.columns) & set(new.columns) - set(keys))]
    # Two hashes of 64 bits each, summed over the rows of a key without regard to their order.
    say = F.concat_ws("\0", *rest) if rest else F.lit("")
    fold = lambda df, n: df.groupBy(*keys).agg(F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(say).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), say).cast("decimal(38,0)"))).alias(n))
    a, b = fold(old, "__a"), fold(new, "__b")
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & a[k].eqNullSafe(b[k])
    both = a.join(b, same_key, "full").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return both.select(*(F.when(F.col("__b").isNull(), a[k]).otherwise(b[k]).alias(k) for k in keys), change.alias("change"))


def diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """relation, key (the parts of the row's key, joined), change of all entries and ratings that two builds don't share."""
    entry = compare(old["affected"], new["affected"], ENTRY).select(F.lit("affected").alias("relation"), F.concat_ws("/", *(F.col(k).cast("string") for k in ENTRY)).alias("key"), "change")
    return entry.unionByName(compare(old["ratings"], new["ratings"], ["cve", "source"]).select(F.lit("ratings").alias("relation"), F.concat_ws("/", "cve", "source").alias("key"), "change"))


def publish_refusals(published: DataFrame, incoming: DataFrame) -> DataFrame:
    """Why a build should not take a published one's place: target, reason; no row: it may. Both have a row per target:
    target, ratings, ratings_since, ratings_since_known. The first rule that holds counts: fewer ratings than published;
    then, where something was published and both record what they cover, a start where the published one had none, or a
    later start (to the second). A target without a published build has nothing to lose."""
    p = published.select("target", *(F.col(c).alias(f"p_{c}") for c in ("ratings", "ratings_since", "ratings_since_known")))
    j = incoming.join(p, "target")
    c, second = F.col, lambda x: F.date_trunc("second", x)
    known = F.coalesce(c("ratings_since_known"), F.lit(False)) & F.coalesce(c("p_ratings_since_known"), F.lit(False)) & (c("p_ratings") > 0)
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    reason = (
        F.when(c("ratings") < c("p_ratings"), F.format_string("the published one holds %d ratings and this one %d", c("p_ratings"), c("ratings")))
        .when(known & c("p_ratings_since").isNull() & c("ratings_since").isNotNull(), F.format_string("the published one covers all of its sources and this one starts at %s", day("ratings_since")))
        .when(known & (second("ratings_since") > second("p_ratings_since")), F.format_string("the published one covers from %s and this one only from %s", day("p_ratings_since"), day("ratings_since")))
    )
    return j.select("target", reason.alias("reason")).filter("reason is not null")


def guard_publish(old: DataFrame, new: DataFrame) -> list[str]:
    """Why a store should not take another's place, both by their meta: a source with fewer ratings than before, fewer
    ratings in all, or a narrower window."""
    a, b = (m.first()["rating_counts"] for m in (old, new))
    per = [f"{s}: {b.get(s, 0)} ratings, {n} before" for s, n in sorted(a.items()) if b.get(s, 0) < n]
    total = F.aggregate(F.map_values("rating_counts"), F.lit(0).cast("long"), lambda x, y: x + y)
    row = lambda m: m.select(F.lit("store").alias("target"), total.alias("ratings"), "ratings_since", "ratings_since_known")
    return per + [r.reason for r in publish_refusals(row(old), row(new)).collect()]
