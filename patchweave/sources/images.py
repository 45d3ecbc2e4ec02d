"""Container images: archives and layouts, what their layers show, and the packages of the database that an image has.

blobs: image_id, layer (ascending), digest, content (a layer's tar, plain or gzip). Layers are read twice: once for the
names alone, from which whiteouts and links are worked out by joins, and once for the few files that are wanted.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.operators import layers as L
from patchweave.sources import archives
from patchweave.sources import inventory as V
from patchweave.tables import write_table

#: Where an image keeps its identity and its package databases, in order of preference, and the kinds.
OS_RELEASE = "etc/os-release"
DATABASES = [
    ("apk", "lib/apk/db/installed"), ("apk", "usr/lib/apk/db/installed"), ("dpkg", "var/lib/dpkg/status"), ("dpkg", "var/lib/dpkg/status.d"),
    ("rpm-sqlite", "usr/lib/sysimage/rpm/rpmdb.sqlite"), ("rpm-sqlite", "var/lib/rpm/rpmdb.sqlite"),
    ("rpm-bdb", "usr/lib/sysimage/rpm/Packages"), ("rpm-ndb", "usr/lib/sysimage/rpm/Packages.db"), ("rpm-bdb", "var/lib/rpm/Packages"), ("rpm-ndb", "var/lib/rpm/Packages.db"),
]
RPM_FAMILIES = ("rhel", "centos", "fedora", "almalinux", "rocky", "ol", "amzn", "openEuler", "sles", "opensuse-leap", "opensuse-tumbleweed", "azurelinux", "mariner")
_READERS = {"apk": V.apk_installed, "dpkg": V.dpkg_status, "rpm-sqlite": V.rpm_sqlite, "rpm-bdb": V.rpm_bdb, "rpm-ndb": V.rpm_ndb}
MAX_HOPS = 8


def _clean(name: str) -> str:
    return "/".join(p for p in name.split("/") if p not in ("", "."))


def _map_rows(df: DataFrame, schema: str, each) -> DataFrame:
    """One row in memory at a time: each(row as a dict) -> tuples of schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(each(b.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def archive_layers(archives: DataFrame) -> DataFrame:
    """blobs of docker-save archives (image_id, content): the layers that manifest.json lists. An archive or a layer
    that can't be read is a layer without content, with the reason as its digest."""

    def each(row: dict) -> Iterator[tuple]:
        n = 0
        try:
            with tarfile.open(fileobj=io.BytesIO(row["content"])) as t:
                members = {_clean(m.name): m for m in t}
                manifest = json.load(t.extractfile(members["manifest.json"]))
                for n, name in enumerate(manifest[0]["Layers"]):
                    yield row["image_id"], n, name, t.extractfile(members[_clean(name)]).read()
        except V.READ_ERRORS as e:
            yield row["image_id"], n, V.why(e), None

    return _map_rows(archives.select("image_id", "content"), "image_id string, layer int, digest string, content binary", each)


_INDEX = "manifests array<struct<mediaType:string,digest:string,platform:struct<os:string,architecture:string>>>"
_MANIFEST = "layers array<struct<digest:string>>, manifests array<struct<mediaType:string,digest:string,platform:struct<os:string,architecture:string>>>"
MAX_INDEX_DEPTH = 4


def layout_layers(files: DataFrame, architecture: str = "amd64") -> DataFrame:
    """blobs of OCI layouts (image_id, path within the layout, content): the first manifest for linux and the
    architecture, in an index of indexes to a depth of MAX_INDEX_DEPTH; an entry without a platform counts where no
    entry has one."""
    name = F.concat(F.lit("sha256:"), F.regexp_extract("path", "blobs/sha256/([0-9a-f]+)$", 1))
    blobs = files.filter("path like '%blobs/sha256/%'").select("image_id", name.alias("digest"), "content")
    at = files.filter("path = 'index.json' or path like '%/index.json'").select("image_id", F.from_json(F.col("content").cast("string"), _INDEX).alias("m")).select("image_id", F.lit(0).alias("rank"), F.col("m.manifests").alias("manifests"))
    chosen = None
    for _ in range(MAX_INDEX_DEPTH):
        fits = F.filter("manifests", lambda d: F.coalesce((d["platform"]["os"] == "linux") & (d["platform"]["architecture"] == architecture), F.lit(True)))
        down = at.select("image_id", "rank", F.posexplode(fits).alias("i", "d")).select("image_id", (F.col("rank") * 1000 + F.col("i")).alias("rank"), F.col("d.digest").alias("digest"))
        read = write_table(down.join(blobs, ["image_id", "digest"]).select("image_id", "rank", F.from_json(F.col("content").cast("string"), _MANIFEST).alias("m")).select("image_id", "rank", "m.*"), "oci-manifests")
        leaf = read.filter("layers is not null").select("image_id", "rank", "layers")
        chosen = leaf if chosen is None else chosen.unionByName(leaf)
        at = read.filter("manifests is not null").select("image_id", "rank", "manifests")
        if not at.limit(1).count():
            break
    first = chosen.groupBy("image_id").agg(F.min_by("layers", "rank").alias("layers"))
    return first.select("image_id", F.posexplode("layers").alias("layer", "l")).select("image_id", "layer", F.col("l.digest").alias("digest")).join(blobs, ["image_id", "digest"]).select("image_id", "layer", "digest", "content")


def entries(blobs: DataFrame) -> DataFrame:
    """image_id, layer, digest, path, kind ('file', 'dir', 'link'), target (of a link) of everything in the layers. A
    layer that can't be read, or not to its end, has a row of kind 'broken' with the reason as target."""

    def each(row: dict) -> Iterator[tuple]:
        head = row["image_id"], row["layer"], row["digest"]
        if row["content"] is None:
            yield (*head, "", "broken", row["digest"])
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(row["content"])) as t:
                for m in t:
                    path = _clean(m.name)
                    if path:
                        target = m.linkname if m.issym() else "/" + m.linkname if m.islnk() else None
                        yield (*head, path, "link" if target is not None else "dir" if m.isdir() else "file", target)
        except V.READ_ERRORS as e:
            yield (*head, "", "broken", V.why(e))

    return _map_rows(blobs, "image_id string, layer int, digest string, path string, kind string, target string", each)


def normal_path(path: Column) -> Column:
    """A path without empty parts, dots and double dots."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(parts, "/")


def follow(shown: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (image_id, wanted) with the file that each leads to: layer, digest, path. Links on the path itself and on
    the folders above it are followed, MAX_HOPS at most; what leads nowhere has no row."""
    at = wanted.select("image_id", "wanted", F.col("wanted").alias("path"))
    links = write_table(shown.filter("kind = 'link'").select("image_id", F.col("path").alias("link"), "target"), "image-links")
    for _ in range(MAX_HOPS):
        parts = F.split("path", "/")
        up = at.withColumn("link", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
        hit = up.join(links, ["image_id", "link"]).groupBy("image_id", "wanted", "path").agg(F.min_by(F.struct("link", "target"), F.length("link")).alias("l"))
        if not hit.limit(1).count():
            break
        onto = F.when(F.col("l.target").startswith("/"), F.col("l.target")).otherwise(F.concat(F.regexp_replace("l.link", "/?[^/]*$", ""), F.lit("/"), "l.target"))
        moved = hit.select("image_id", "wanted", "path", normal_path(F.concat(onto, F.substr("path", F.length("l.link") + 1))).alias("next"))
        at = write_table(at.join(moved, ["image_id", "wanted", "path"], "left").select("image_id", "wanted", F.coalesce("next", "path").alias("path")), "image-hops")
    return at.join(shown.filter("kind = 'file'").select("image_id", "path", "layer", "digest"), ["image_id", "path"])


def contents(blobs: DataFrame, places: DataFrame) -> DataFrame:
    """places (image_id, layer, path, any others) with content."""
    per = places.groupBy("image_id", "layer").agg(F.collect_set("path").alias("paths"))  # the wanted files of one layer

    def each(row: dict) -> Iterator[tuple]:
        want, found = set(row["paths"]), {}
        try:
            with tarfile.open(fileobj=io.BytesIO(row["content"])) as t:
                for m in t:
                    path = _clean(m.name)
                    if path in want and m.isfile():
                        found[path] = t.extractfile(m).read()
        except V.READ_ERRORS:
            pass  # entries() has told what is broken
        for path, content in found.items():
            yield row["image_id"], row["layer"], path, content

    read = _map_rows(blobs.join(per, ["image_id", "layer"]).select("image_id", "layer", "content", "paths"), "image_id string, layer int, path string, content binary", each)
    return places.join(read, ["image_id", "layer", "path"])


def os_ecosystem(text: str = "content") -> Column:
    """struct(id, ecosystem) of the text of an os-release file."""
    value = lambda k: F.trim(F.regexp_extract(F.col(text).cast("string"), rf"(?m)^\s*{k}\s*=\s*[\"']?([^\"'\n\r]*)[\"']?\s*$", 1))
    return F.struct(value("ID").alias("id"), N.distro_ecosystem(value("ID"), value("VERSION_ID"), value("PRETTY_NAME")).alias("ecosystem"))


def databases(blobs: DataFrame) -> DataFrame:
    """image_id, kind, rank, path, digest, content of the files that tell an image's packages: os-release (rank null),
    and the first database in order of preference; a database of single stanzas has a row for each. The log of an
    SQLite database comes along as kind 'wal', a layer that can't be read as kind 'broken', its content the reason."""
    every = write_table(entries(blobs), "image-entries")
    broken = every.filter("kind = 'broken'").select("image_id", "layer", "path", "digest", "kind", F.lit(None).cast("int").alias("rank"), "path", F.col("target").cast("binary").alias("content"))
    shown = write_table(L.visible(every.filter("kind <> 'broken'")), "image-shown")
    order = [(i, kind, path) for i, (kind, path) in enumerate(DATABASES)]
    rules = [(None, "os-release", OS_RELEASE), *order, *((i, "wal", p + "-wal") for i, k, p in order if k == "rpm-sqlite")]
    rule = F.array(*(F.struct(F.lit(r).cast("int").alias("rank"), F.lit(k).alias("kind"), F.lit(p).alias("wanted")) for r, k, p in rules if not p.endswith("/status.d")))
    asked = shown.select("image_id").distinct().select("image_id", F.explode(rule).alias("r")).select("image_id", "r.*")
    single = next(i for i, _, p in order if p.endswith("status.d"))
    stanzas = L.files_under(shown, "var/lib/dpkg/status.d").select("image_id", F.lit(single).alias("rank"), F.lit("dpkg").alias("kind"), F.col("path").alias("wanted")).filter("wanted not like '%.md5sums'")
    asked = asked.unionByName(stanzas)
    found = write_table(follow(shown, asked.select("image_id", "wanted").distinct()).join(asked, ["image_id", "wanted"]), "image-found")
    best = found.filter("kind <> 'wal'").groupBy("image_id").agg(F.min("rank").alias("rank"))
    kept = found.join(best, ["image_id", "rank"], "left_semi").unionByName(found.filter("rank is null"))
    out = contents(blobs, kept.select("image_id", "layer", "path", "digest", "kind", "rank", "wanted"))
    return out.unionByName(broken.toDF("image_id", "layer", "path", "digest", "kind", "rank", "wanted", "content"))


def catalog(blobs: DataFrame) -> DataFrame:
    """The packages of images: rows of inventory.SCHEMA (path is the database's) with image_id and digest. An image
    without any database, or one whose database or a layer can't be read, has a row with a reason."""
    files = write_table(databases(blobs), "image-files")
    system = files.filter("kind = 'os-release'").select("image_id", os_ecosystem().alias("os")).select("image_id", "os.*").dropDuplicates(["image_id"])
    logs = files.filter("kind = 'wal' and length(content) > 0").select("image_id").distinct().withColumn("logged", F.lit(True))
    held = files.filter("rank is not null and kind <> 'wal'").join(logs, "image_id", "left")
    fields = V.FIELDS

    def each(row: dict) -> Iterator[tuple]:
        head, blank = (row["image_id"], row["digest"], row["wanted"], row["kind"]), (None,) * len(fields)
        if row["kind"] == "rpm-sqlite" and row["logged"]:
            yield (*head, "a database with changes in its log", *blank)
            return
        try:
            data = row["content"] or b""
            found = _READERS[row["kind"]](data if row["kind"].startswith("rpm") else data.decode("utf-8", "replace"))
        except V.READ_ERRORS as e:
            yield (*head, V.why(e), *blank)
            return
        for p in found:
            yield (*head, p.reason, *blank) if isinstance(p, V.Note) else (*head, None, *(getattr(p, f) for f in fields))

    rows = _map_rows(held.select("image_id", "digest", "wanted", "kind", "logged", "content"), "image_id string, digest string, path string, kind string, reason string, " + ", ".join(f"{f} string" for f in fields), each)
    rows = rows.drop("ecosystem").join(system.select("image_id", "ecosystem"), "image_id", "left").select("image_id", "digest", "path", "kind", "reason", *fields)
    none = blobs.select("image_id").distinct().join(rows.filter("name is not null").select("image_id").distinct(), "image_id", "left_anti").join(system, "image_id", "left")
    why = F.when(F.col("id").isin(*RPM_FAMILIES), F.format_string("it calls itself %s, but has no rpm database", "id")).otherwise("no package database")
    nothing = none.select("image_id", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("path"), F.lit("image").alias("kind"), why.alias("reason"), *(F.lit(None).cast("string").alias(f) for f in fields))
    lost = files.filter("kind = 'broken'").select("image_id", "digest", F.lit(None).cast("string").alias("path"), F.lit("layer").alias("kind"), F.col("content").cast("string").alias("reason"), *(F.lit(None).cast("string").alias(f) for f in fields))
    return rows.unionByName(nothing).unionByName(lost)


_SAVED = "array<struct<Layers:array<string>>>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """blobs of the docker-save archives that a path names. Their members are rows, so that an archive may be of any
    size and only a layer has to fit into a row. What can't be read is a layer without content, with the reason as its
    digest."""
    members = archives.read_archive(spark, path)
    told = members.filter("reason is not null").select(F.col("path").alias("image_id"), F.lit(0).alias("layer"), F.col("reason").alias("digest"), F.lit(None).cast("binary").alias("content"))
    listed = members.filter("member in ('manifest.json', './manifest.json') and reason is null").select("path", F.from_json(F.col("content").cast("string"), _SAVED).alias("m"))
    layers = listed.select("path", F.posexplode(F.get("m", F.lit(0))["Layers"]).alias("layer", "digest"))
    found = layers.join(members.filter("reason is null").select("path", F.regexp_replace("member", "^[.]/", "").alias("digest"), "content"), ["path", "digest"], "left")
    named = F.when(F.col("content").isNull(), F.concat(F.lit("no layer "), "digest")).otherwise(F.col("digest"))
    none = members.filter("reason is null").select("path").distinct().join(layers.select("path").distinct(), "path", "left_anti").select(F.col("path").alias("image_id"), F.lit(0).alias("layer"), F.lit("no manifest.json that lists layers").alias("digest"), F.lit(None).cast("binary").alias("content"))
    return found.select(F.col("path").alias("image_id"), "layer", named.alias("digest"), "content").unionByName(told).unionByName(none)


def read_layouts(spark: SparkSession, root: str, architecture: str = "amd64") -> DataFrame:
    """blobs of the OCI layouts below a folder; a layout is named by its folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "/(index[.]json|blobs/sha256/[0-9a-f]+)$", "")
    inner = F.filter(F.array(F.lit("index.json"), F.regexp_extract("path", "(blobs/sha256/[0-9a-f]+)$", 1)), lambda x: x != "")
    return layout_layers(files.filter(F.col("path").rlike("/(index[.]json|blobs/sha256/[0-9a-f]+)$")).select(base.alias("image_id"), F.element_at(inner, -1).alias("path"), "content"), architecture)
