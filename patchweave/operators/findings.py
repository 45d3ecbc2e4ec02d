"""What a finding gains from other tables: ratings and enrichment by CVE, and what its ratings say together.

findings: finding_id, identifiers (array), score (null: unrated) and any others. ratings: cve, source, severity (array
of type and score), epss, epss_percentile, epss_model, kev, kev_date_added, kev_ransomware, url. enrichment: cve,
source, title, summary, url, claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.functions import severity as S

RATING = "struct<database:string,advisory_id:string,band:string,score:double,fixed:string,fix_state:string,no_opinion:boolean,epss:double,epss_percentile:double,epss_model:string,kev:boolean,kev_date_added:date,kev_ransomware:boolean,url:string>"


def rated(ratings: DataFrame) -> DataFrame:
    """ratings as (cve, rating): the highest scorable vector counts; one without vectors has no opinion on severity."""
    vectors = F.coalesce("severity", F.array().cast("array<struct<type:string,score:string>>"))
    best = S.highest(F.transform(vectors, lambda s: S.vector_score(s["type"], s["score"])))
    r = ratings.withColumns({"__score": best, "__none": F.size(vectors) == 0})
    get = lambda c, t: (F.col(c) if c in ratings.columns else F.lit(None)).cast(t).alias(c)
    rating = F.struct(
        F.col("source").alias("database"), F.col("cve").alias("advisory_id"), S.band_of(F.col("__score")).alias("band"), F.col("__score").alias("score"), F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("fix_state"), F.col("__none").alias("no_opinion"),
        get("epss", "double"), get("epss_percentile", "double"), get("epss_model", "string"), get("kev", "boolean"), get("kev_date_added", "date"), get("kev_ransomware", "boolean"), get("url", "string"),
    )
    return r.select("cve", rating.cast(RATING).alias("rating"))


def _by_finding(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.explode(F.array_distinct(F.filter("identifiers", lambda i: i.startswith("CVE-")))).alias("cve"))


def _opinions(ratings: str) -> Column:
    return F.filter(ratings, lambda r: ~F.coalesce(r["no_opinion"], F.lit(False)))


def rated_cves(ratings: DataFrame) -> DataFrame:
    """What all ratings of a CVE say together, folded once per CVE: rs (all of them, by database and id), raised (the
    highest score), epss (the highest with a model), listed (any KEV), bands (of those with an opinion) and n."""
    r, opinion = F.col("rating"), ~F.coalesce(F.col("rating.no_opinion"), F.lit(False))
    return rated(ratings).groupBy("cve").agg(
        F.sort_array(F.collect_list(r)).alias("rs"), F.max(F.when(opinion, F.col("rating.score"))).alias("raised"), F.max(F.when(F.coalesce("rating.epss_model", F.lit("")) != "", F.col("rating.epss"))).alias("epss"),
        F.max(F.coalesce("rating.kev", F.lit(False))).alias("listed"), F.collect_set(F.when(opinion, F.col("rating.band"))).alias("bands"), F.count(F.lit(1)).alias("n"),
    )


def join_ratings(findings: DataFrame, ratings: DataFrame) -> DataFrame:
    """findings with ratings (their own, if any, and those of their CVEs, by database and id), n_ratings, score and band
    (raised by a rating that is higher, never lowered), max_epss (of ratings with a model), kev and disagree (two ratings
    that have an opinion give different bands).

    Ratings are folded once per CVE, and a finding takes a CVE's summary as it is: only findings with several CVEs merge
    some. Where the column ratings isn't used, no list of ratings leaves the fold, however many a CVE has."""
    none = F.array().cast(f"array<{RATING}>")
    per = rated_cves(ratings)
    f = findings.withColumn("__cves", F.coalesce(F.array_distinct(F.filter("identifiers", lambda i: i.startswith("CVE-"))), F.array().cast("array<string>")))
    summary = ["rs", "raised", "epss", "listed", "bands", "n"]
    one = f.filter(F.size("__cves") <= 1).withColumn("cve", F.get("__cves", F.lit(0))).join(per, "cve", "left").drop("cve")
    several = f.filter(F.size("__cves") > 1)
    merged = several.select("finding_id", F.explode("__cves").alias("cve")).join(per, "cve").groupBy("finding_id").agg(
        F.sort_array(F.flatten(F.collect_list("rs"))).alias("rs"), F.max("raised").alias("raised"), F.max("epss").alias("epss"), F.max("listed").alias("listed"), F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands"), F.sum("n").alias("n"),
    )
    j = one.unionByName(several.join(merged, "finding_id", "left")).drop("__cves")
    joined = {"ratings": F.coalesce("rs", none), "__bands": F.coalesce("bands", F.array().cast("array<string>")), "n_ratings": F.coalesce("n", F.lit(0)).cast("int"), "__raised": F.col("raised"), "max_epss": F.col("epss"), "kev": F.coalesce("listed", F.lit(False))}
    if "ratings" in findings.columns:
        own, opinions = F.coalesce("__own", none), _opinions("__own")
        j = j.withColumn("__own", F.col("ratings").cast(f"array<{RATING}>"))
        joined = {
            "ratings": F.sort_array(F.concat(own, F.coalesce("rs", none))), "__bands": F.array_distinct(F.concat(joined["__bands"], F.coalesce(F.transform(opinions, lambda r: r["band"]), F.array().cast("array<string>")))),
            "n_ratings": (joined["n_ratings"] + F.size(own)).cast("int"), "__raised": F.greatest("raised", F.array_max(F.transform(opinions, lambda r: r["score"]))), "max_epss": F.greatest("epss", max_epss("__own")), "kev": joined["kev"] | F.coalesce(F.exists("__own", lambda r: F.coalesce(r["kev"], F.lit(False))), F.lit(False)),
        }
    j = j.withColumns(joined).withColumn("score", F.greatest("score", "__raised"))
    return j.withColumns({"band": S.band_of(F.col("score")), "disagree": F.size("__bands") > 1}).drop("__bands", "__raised", "__own", *summary)


def join_enrichment(findings: DataFrame, enrichment: DataFrame) -> DataFrame:
    """findings with enrichment, an array without repeats by source, title, url and summary. It changes nothing else."""
    entry = F.struct("source", "title", "url", "summary", "claims")
    per = enrichment.groupBy("cve").agg(F.collect_set(entry).alias("es"))  # as many as a CVE has sources and notices
    joined = _by_finding(findings).join(per, "cve").groupBy("finding_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("es")))).alias("enrichment"))
    empty = F.array().cast(joined.schema["enrichment"].dataType)
    return findings.join(joined, "finding_id", "left").withColumn("enrichment", F.coalesce("enrichment", empty))


def sort_ratings(ratings: Column) -> Column:
    """By database and id; the other fields break ties, so that the order doesn't depend on arrival."""
    return F.sort_array(ratings)


def max_epss(ratings: str) -> Column:
    """The highest EPSS of the ratings that have a model; null where none has, which is not 0."""
    return F.array_max(F.transform(F.filter(ratings, lambda r: F.coalesce(r["epss_model"], F.lit("")) != ""), lambda r: r["epss"]))


def sources_disagree(ratings: str) -> Column:
    """Whether two ratings that have an opinion give different bands."""
    bands = F.transform(_opinions(ratings), lambda r: r["band"])
    return F.size(F.array_distinct(bands)) > 1


def severity_text(band: Column, score: Column) -> Column:
    return F.when(band == "unknown", band).otherwise(F.format_string("%s (%.1f)", band, F.coalesce(score, F.lit(0.0))))


def other_ids(advisory_id: Column, identifiers: Column) -> Column:
    return F.array_distinct(F.filter(identifiers, lambda i: (i != "") & (i != advisory_id)))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """By target, ecosystem, name, version, advisory, package URL and location: a range-partitioned sort."""
    by = ("target_id", "ecosystem", "name", "version", "advisory_id", "purl", "location")
    return findings.orderBy(*(c for c in by if c in findings.columns))


def ordered_skips(skips: DataFrame) -> DataFrame:
    by = ("target_id", "ecosystem", "name", "version", "advisory_id", "reason", "purl", "location")
    return skips.dropDuplicates([c for c in by if c in skips.columns]).orderBy(*(c for c in by if c in skips.columns))
