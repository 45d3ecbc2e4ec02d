"""Fedora's updates and Ubuntu's tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.operators import matching as M
from patchweave.operators import ranges as R

_BODHI = "updates array<struct<alias:string,title:string,notes:string,severity:string,type:string,release:struct<name:string,id_prefix:string,version:string>,builds:array<struct<nvr:string,epoch:int,type:string>>,date_stable:string>>"
#: Fedora's severity words, Ubuntu's code names and releases, and the tracker's states by what they mean.
_WORDS = ("Urgent", "High", "Medium", "Low")
UBUNTU_RELEASES = {"trusty": "14.04", "xenial": "16.04", "bionic": "18.04", "focal": "20.04", "jammy": "22.04", "noble": "24.04", "oracular": "24.10", "plucky": "25.04", "questing": "25.10", "resolute": "26.04"}
_NOT_FIXED = ("needed", "needs-triage", "pending", "deferred")
_DIGITS = "0123456789"
_NAME_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS + "+.-"


def bodhi_updates(spark: SparkSession, path: str) -> DataFrame:
    """A row per update of a page's JSON."""
    return spark.read.schema(_BODHI).json(path, multiLine=True).select(F.inline("updates"))


def bodhi_affected(updates: DataFrame) -> DataFrame:
    """Affected entries of Fedora's security updates, and cves (from title and notes) and word: each package's first
    build that can be read is the fix. EPEL's updates and other types go."""
    u = updates.filter("type = 'security' and upper(release.id_prefix) = 'FEDORA' and alias <> ''")
    builds = F.filter(F.transform(F.filter(F.coalesce("builds", F.array().cast("array<struct<nvr:string,epoch:int,type:string>>")), lambda b: F.coalesce(F.nullif(F.lower(b["type"]), F.lit("")), F.lit("rpm")) == "rpm"), lambda b: F.struct(N.nvr(b["nvr"]).alias("p"), b["epoch"].alias("epoch"))), lambda b: b["p"].isNotNull())
    u = u.withColumn("built", builds)
    first = F.expr("filter(built, (b, i) -> array_position(transform(built, x -> x.p.name), b.p.name) = i + 1)")
    cves = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "title", "notes"), F.lit("CVE-[0-9]{4}-[0-9]{4,}"), F.lit(0)))
    word = F.initcap(F.trim("severity"))
    e = u.select("alias", F.col("release.version").alias("v"), cves.alias("cves"), F.when(word.isin(*_WORDS), word).alias("word"), F.posexplode(first).alias("aff_ord", "b"))
    null = F.lit(None).cast("string")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), null.alias("last_affected"), null.alias("limit"))
    fix = N.evr(F.col("b.epoch"), F.col("b.p.version"), F.col("b.p.release"))
    ranges = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event(F.lit("0"), null), event(null, fix)).cast(R.EVENTS).alias("events"), null.alias("fix_state")))
    return e.select(N.database_of(F.col("alias")).alias("database"), F.col("alias").alias("advisory_id"), "aff_ord", F.concat(F.lit("Fedora:"), "v").alias("ecosystem"), F.col("b.p.name").alias("name"), ranges.cast(M.RANGES).alias("ranges"), F.array().cast("array<string>").alias("versions"), null.alias("module_stream"), "cves", "word")


def _only(text: Column, characters: str) -> Column:
    return (text != "") & (F.translate(text, characters, "") == "")


def is_cve(text: Column) -> Column:
    """CVE, a year of four digits and a number, set off by dashes."""
    part = F.split(text, "-")
    return (F.size(part) == 3) & (F.get(part, F.lit(0)) == "CVE") & _only(F.get(part, F.lit(1)), _DIGITS) & (F.length(F.get(part, F.lit(1))) == 4) & _only(F.get(part, F.lit(2)), _DIGITS)


def ubuntu_states(files: DataFrame) -> DataFrame:
    """cve, name, release, fix_state of a tracker's files (path, value: the text); states that say nothing of a missing
    fix have a null fix_state, and code names of no release are left out. The last line of a key counts; where several
    files name one CVE, the last path.

    A file's fields are lines of a key, a colon and a value. The field Candidate is the CVE; a key that is a code name,
    an underscore and a package says in the first word of its value how the package stands there, and may add a note in
    parentheses."""
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.rtrim(F.regexp_replace("line", "\r$", "")))
    fields = lines.filter(F.contains("line", F.lit(":"))).select("path", "pos", F.substring_index("line", ":", 1).alias("key"), F.expr("substring(line, instr(line, ':') + 1)").alias("value"))
    own = F.trim("value")
    cves = fields.filter((F.col("key") == "Candidate") & is_cve(own)).groupBy("path").agg(F.max_by(own, "pos").alias("cve"))
    names = F.create_map(*(F.lit(x) for p in UBUNTU_RELEASES.items() for x in p))
    stands = fields.select("path", "pos", F.try_element_at(names, F.substring_index("key", "_", 1)).alias("release"), F.expr("substring(key, instr(key, '_') + 1)").alias("name"), F.expr("substring(value, 2)").alias("said"), F.startswith("value", F.lit(" ")).alias("spaced"), F.contains("key", F.lit("_")).alias("keyed"))
    state, note = F.substring_index("said", " ", 1), F.expr("substring(said, length(substring_index(said, ' ', 1)) + 1)")
    sound = F.col("keyed") & F.col("spaced") & F.col("release").isNotNull() & _only(F.col("name"), _NAME_CHARACTERS) & ~F.substring("name", 1, 1).isin("+", ".", "-") & (state != "") & ((note == "") | (note.startswith(" (") & note.endswith(")")))
    rows = stands.filter(sound).select("path", "pos", "release", "name", state.alias("state")).join(cves, "path")
    last = rows.groupBy("cve", "name", "release").agg(F.max_by("state", F.struct("path", "pos")).alias("state"))
    return last.select("cve", "name", "release", F.when(F.col("state") == "ignored", "wont-fix").when(F.col("state").isin(*_NOT_FIXED), "not-fixed").alias("fix_state"))


def fixless(ranges: str):
    """Whether each of an array of ranges has no fix: an array of booleans."""
    return F.expr(f"transform({ranges}, r -> not exists(r.events, e -> coalesce(e.fixed, '') <> ''))")


def stamp_ubuntu(affected: DataFrame, upstream: DataFrame, states: DataFrame) -> DataFrame:
    """affected with the tracker's fix state on ranges without a fix; upstream: advisory_id, upstream (ids, of which
    the first CVE is looked up)."""
    cve = upstream.select("advisory_id", F.get(F.filter("upstream", is_cve), F.lit(0)).alias("cve"))
    part = F.split("ecosystem", ":")  # Ubuntu, a release and, for some, LTS
    release = F.when((F.get(part, F.lit(0)) == "Ubuntu") & (F.coalesce(F.get(part, F.lit(2)), F.lit("LTS")) == "LTS") & (F.size(part) <= 3), F.get(part, F.lit(1)))
    rows = affected.join(cve, "advisory_id", "left").withColumn("release", release)
    known = rows.join(states.withColumnRenamed("fix_state", "__state"), ["cve", "name", "release"], "left")
    stamped = F.expr("transform(ranges, r -> if(__state is not null and not exists(r.events, e -> coalesce(e.fixed, '') <> ''), named_struct('type', r.type, 'events', r.events, 'fix_state', __state), r))")
    return known.withColumn("ranges", stamped).select(*affected.columns)
