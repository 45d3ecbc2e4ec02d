"""CVSS v3 base scores, vendor words, bands. CVSS v2 vectors have no score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("none", "low", "medium", "high", "critical")
#: Fixed values of the CVSS v3 specification.
_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
#: vendors' words and the scores that stand for them.
VENDOR_WORDS = {"Critical": 9.0, "Urgent": 9.0, "Important": 7.0, "High": 7.0, "Moderate": 4.0, "Medium": 4.0, "Low": 0.1}


def _pick(value: Column, table: dict[str, float]) -> Column:
    out = None
    for k, w in table.items():
        out = F.when(value == k, F.lit(w)) if out is None else out.when(value == k, F.lit(w))
    return out


def cvss3_score(vector: Column) -> Column:
    """Base score of a CVSS:3.0 or CVSS:3.1 vector; null if it is no such vector or a metric is repeated or unknown."""
    parts = F.filter(F.slice(F.split(vector, "/"), F.lit(2), F.size(F.split(vector, "/"))), lambda p: p != "")
    keys = F.transform(parts, lambda p: F.substring_index(p, ":", 1))
    sound = vector.rlike("^CVSS:3[.][01]/") & F.forall(parts, lambda p: p.rlike("^[^:]+:.+$")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    metric = lambda k: F.regexp_extract(vector, f"/{k}:([^/]*)", 1)
    scope = metric("S")
    w = {k: _pick(metric(k), t) for k, t in _WEIGHTS.items()}
    pr = F.when(scope == "C", _pick(metric("PR"), _PRIVILEGES["C"])).when(scope == "U", _pick(metric("PR"), _PRIVILEGES["U"]))
    isc = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(scope == "C", 7.52 * (isc - 0.029) - 3.25 * F.pow(isc - 0.02, 15)).otherwise(6.42 * isc)
    total = impact + 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    capped = F.least(F.when(scope == "C", 1.08 * total).otherwise(total), F.lit(10.0))
    # The specification rounds up to one decimal, with five decimals counted.
    whole = F.floor(capped * 100_000 + 0.5)
    up = F.when(whole % 10_000 == 0, whole / 100_000).otherwise((F.floor(whole / 10_000) + 1) / 10)
    return F.when(sound, F.when(impact <= 0, F.when(total.isNotNull(), 0.0)).otherwise(up))


def vector_score(kind: Column, vector: Column) -> Column:
    """Score of one rating: a CVSS v3 vector, or a vendor's word."""
    return F.when(kind == "VENDOR_WORD", _pick(vector, VENDOR_WORDS)).otherwise(cvss3_score(vector))


def band_of(score: Column) -> Column:
    """none, low, medium, high or critical; unknown without a score."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").when(score.isNotNull(), "none").otherwise("unknown")


def band_rank(band: Column) -> Column:
    """Position in the order of bands; null for unknown, which lies outside it."""
    return F.when(band.isin(*BANDS), F.array_position(F.array(*map(F.lit, BANDS)), band) - 1)


def threshold_rank(threshold: str) -> int:
    """Position of a band that a user names, in either case; unknown is none to measure against."""
    if threshold.lower() not in BANDS:
        raise ValueError(f"no severity band: {threshold!r}; one of {', '.join(BANDS)} is")
    return BANDS.index(threshold.lower())


def at_or_above(band: Column, threshold: str) -> Column:
    return F.coalesce(band_rank(band) >= threshold_rank(threshold), F.lit(False))


def highest(scores: Column) -> Column:
    """The highest score of an array, null where none is scored."""
    return F.array_max(F.filter(scores, lambda s: s.isNotNull()))
