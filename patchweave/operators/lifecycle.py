"""How long things hold: releases until their end of life, feeds by the age and the window of what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.functions import names as N

_DAY = "yyyy-MM-dd"


def eol_status(targets: DataFrame, releases: DataFrame, today: str) -> DataFrame:
    """targets (target_id, distro_id, version_id, pretty_name) with known, eol (its end lies before today), maintained
    (the catalogue says so, or extended support hasn't ended), release and reason (why nothing is known). releases: the
    rows of feeds.eol_releases, a catalogue of some hundred."""
    key = N.distro_ecosystem(F.col("distro_id"), F.col("version_id"), F.col("pretty_name"))
    t = targets.withColumn("__eco", key).withColumn("release", N.eol_cycle(F.col("__eco")))
    r = releases.dropDuplicates(["distro_id", "release"])
    j = t.join(r, ["distro_id", "release"], "left")
    day = F.lit(today).cast("date")
    known = F.col("eol_from").isNotNull()
    reason = (
        F.when(known, None).when(F.coalesce("distro_id", F.lit("")) == "", "the target names no distribution")
        .when(F.col("__eco").isNull(), "the distribution or its release isn't known").when(F.col("release").isNull(), "the distribution has no releases")
        .otherwise("the catalogue doesn't have the release")
    )
    ended = F.coalesce(F.try_to_date("eol_from", _DAY) < day, F.lit(False))
    extended = F.coalesce(F.try_to_date("eoes_from", _DAY) > day, F.lit(False))
    return j.select("target_id", "distro_id", "release", known.alias("known"), (known & ended).alias("eol"), (known & (F.coalesce("is_maintained", F.lit(False)) | extended)).alias("maintained"), reason.alias("reason"))


def data_as_of(provenance: DataFrame, by: list[str]) -> DataFrame:
    """The oldest data_as_of of each group; null, unknown, as soon as one of them is."""
    return provenance.groupBy(*by).agg(F.when(F.bool_and(F.col("data_as_of").isNotNull()), F.min("data_as_of")).alias("data_as_of"))


def too_old(as_of: Column, now: Column, most_days: int) -> Column:
    """Whether data is older than it may be; data of unknown age is."""
    return as_of.isNull() | (F.date_diff(now.cast("date"), as_of.cast("date")) > most_days)


def touches(until: Column, since: Column) -> Column:
    """Whether a window reaches the start of another; one without an end reaches any."""
    return until.isNull() | (until >= since)


def merge_windows(seeded: DataFrame, fetched: DataFrame) -> DataFrame:
    """What two runs of a source cover together, by source. Columns: source, since, since_known, until. A seed that
    covers an unrecorded time makes the whole unrecorded; without a seed, or where this run doesn't know its start, this
    run's window stands. Of two known starts the earlier counts if the windows touch (an unset start is the beginning of
    time), else the seed's, and gap tells that an earlier slice doesn't reach it."""
    s = seeded.select("source", *(F.col(c).alias(f"s_{c}") for c in ("since", "since_known", "until")))
    j = fetched.join(s, "source", "left")
    c = F.col
    start = lambda x: F.coalesce(c(x), F.lit("0001-01-01").cast("timestamp"))
    no_seed, lost = c("s_since_known").isNull(), ~F.coalesce("s_since_known", F.lit(False))
    later = c("since").isNotNull() & (start("s_since") < start("since"))
    earlier = start("since") < start("s_since")
    joined = touches(c("until"), start("s_since"))
    which = F.when(no_seed, "run").when(lost, "unrecorded").when(~c("since_known"), "run").when(later, "seed").when(earlier & joined, "joined").when(earlier, "gap").otherwise("run")
    j = j.withColumn("w", which)
    return j.select(
        "source",
        F.when(c("w").isin("seed", "gap"), c("s_since")).when(c("w") != "unrecorded", c("since")).alias("since"),
        F.when(c("w") == "unrecorded", False).otherwise(c("since_known")).alias("since_known"),
        F.when(c("w").isin("joined", "gap"), c("s_until")).otherwise(c("until")).alias("until"),
        (c("w") == "gap").alias("gap"),
    )


def falls_in_time(changes: DataFrame) -> DataFrame:
    """Changes (feed, pos, changed) of feeds that promise newest first: feed, ordered. A feed that breaks the promise
    can't be cut short at a date. Compared as aggregates over neighbouring positions, not by a window over the feed."""
    after = changes.select("feed", (F.col("pos") - 1).alias("pos"), F.col("changed").alias("next"))
    j = changes.join(after, ["feed", "pos"], "left")
    return j.groupBy("feed").agg(F.bool_and(F.col("next").isNull() | (F.col("next") <= F.col("changed"))).alias("ordered"))


def narrowest_window(sources: DataFrame) -> DataFrame:
    """One row: since, the latest start of what rating sources cover (source, since, since_known), which limits them all;
    sources without a start cover everything and limit nothing. since_known: whether all of them record theirs."""
    return sources.agg(F.max("since").alias("since"), F.coalesce(F.bool_and(F.coalesce("since_known", F.lit(False))), F.lit(True)).alias("since_known"))


def narrowest_rating(ratings: DataFrame) -> DataFrame:
    """source, ratings, cves and the latest start (since) of what its loads cover: what can be said of the source at
    least; loads without a start cover all there was."""
    return ratings.groupBy("source").agg(F.count(F.lit(1)).alias("ratings"), F.count_distinct("cve").alias("cves"), F.max("since").alias("since"))


def stage_shares(stages: DataFrame) -> DataFrame:
    """stage, seconds and share of the run that it took: run, stage, seconds."""
    total = stages.groupBy("run").agg(F.sum("seconds").alias("total"))
    per = stages.groupBy("run", "stage").agg(F.sum("seconds").alias("seconds"))
    return per.join(total, "run").select("run", "stage", "seconds", F.when(F.col("total") > 0, F.col("seconds") / F.col("total")).alias("share"))


def release_order(release: Column) -> Column:
    """A key that sorts releases by number: v3.9 before v3.10, and those that are no numbers after them, as text."""
    parts = F.regexp_extract(release, r"^v?([0-9]+)(?:[.]([0-9]+))?$", 0) != ""
    number = lambda i: F.coalesce(F.regexp_extract(release, r"^v?([0-9]+)(?:[.]([0-9]+))?$", i).try_cast("int"), F.lit(0))
    return F.struct((~parts).alias("text_only"), F.when(parts, number(1)).otherwise(0).alias("major"), F.when(parts, number(2)).otherwise(0).alias("minor"), F.when(parts, "").otherwise(release).alias("text"))
