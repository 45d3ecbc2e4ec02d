"""CVSS v4 base and threat scores as column expressions.

A vector falls into a macrovector of six equivalence classes, whose score is the table's. From it a mean is taken off:
for each class that has a lower neighbour in the table, the step to it times the share of the class's depth that the
vector lies below the class's highest vector. A class with several highest vectors measures from the first that the
vector doesn't exceed; classes are independent of each other, so each picks its own.

The table (macrovector -> score, 270 entries) is published with the specification and is a parameter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the specification: how far each metric's values lie below its highest.
_LEVELS = {
    "AV": {"N": 0, "A": 1, "L": 2, "P": 3}, "PR": {"N": 0, "L": 1, "H": 2}, "UI": {"N": 0, "P": 1, "A": 2}, "AC": {"L": 0, "H": 1}, "AT": {"N": 0, "P": 1},
    "VC": {"H": 0, "L": 1, "N": 2}, "VI": {"H": 0, "L": 1, "N": 2}, "VA": {"H": 0, "L": 1, "N": 2},
    "SC": {"H": 1, "L": 2, "N": 3}, "SI": {"S": 0, "H": 1, "L": 2, "N": 3}, "SA": {"S": 0, "H": 1, "L": 2, "N": 3},
    "CR": {"H": 0, "M": 1, "L": 2}, "IR": {"H": 0, "M": 1, "L": 2}, "AR": {"H": 0, "M": 1, "L": 2},
}
#: Fixed values of the specification: classes, the depth of each, and its highest vectors over the metrics named.
_CLASSES = {
    "1": (("AV", "PR", "UI"), {"0": (1, ["NNN"]), "1": (4, ["ANN", "NLN", "NNP"]), "2": (5, ["PNN", "ALP"])}),
    "2": (("AC", "AT"), {"0": (1, ["LN"]), "1": (2, ["HN", "LP"])}),
    "36": (
        ("VC", "VI", "VA", "CR", "IR", "AR"),
        {
            "00": (7, ["HHHHHH"]), "01": (6, ["HHLMMH", "HHHMMM"]), "10": (8, ["LHHHHH", "HLHHHH"]),
            "11": (8, ["LHLHMH", "LHHHMM", "HLHMHM", "HLLMHH", "LLHHHM"]), "21": (10, ["LLLHHH"]),
        },
    ),
    "4": (("SC", "SI", "SA"), {"0": (6, ["HSS"]), "1": (5, ["HHH"]), "2": (4, ["LLL"])}),
}
_REQUIRED = ("AV", "AC", "AT", "PR", "UI", "VC", "VI", "VA", "SC", "SI", "SA")
_WORST = {"E": "A", "CR": "H", "IR": "H", "AR": "H"}


def _metrics(vector: str) -> str:
    """SQL of a map of a sound vector's metrics, null for any other."""
    pairs = f"filter(split(substring({vector}, 10), '/'), p -> p <> '')"
    keys = f"transform({pairs}, p -> substring_index(p, ':', 1))"
    sound = f"startswith({vector}, 'CVSS:4.0/') and forall({pairs}, p -> p rlike '^[^:]+:.+$') and size(array_distinct({keys})) = size({keys}) and size(array_intersect({keys}, array({', '.join(repr(k) for k in _REQUIRED)}))) = {len(_REQUIRED)}"
    return f"case when {sound} then map_from_entries(transform({pairs}, p -> struct(substring_index(p, ':', 1), substring(p, instr(p, ':') + 1)))) end"


def _value(metric: str) -> str:
    """SQL of a metric's effective value: the modified one where given; a threat or requirement left open is the worst."""
    modified = f"nullif(m['M{metric}'], 'X')"
    if metric in _WORST:
        return f"case when coalesce(m['{metric}'], 'X') = 'X' then '{_WORST[metric]}' else coalesce({modified}, m['{metric}']) end"
    return f"coalesce({modified}, m['{metric}'], 'X')"


def with_score(vectors: DataFrame, vector: str, table: dict[str, float], out: str = "score") -> DataFrame:
    """vectors with the score of a column; null where it is no scorable CVSS:4.0 vector. Score distinct vectors."""
    base = vectors.columns
    d = vectors.withColumn("m", F.expr(_metrics(f"`{vector}`")))
    for k in (*_LEVELS, "E"):
        d = d.withColumn(f"v_{k}", F.expr(_value(k)))
    v = lambda k: F.col(f"v_{k}")
    # Levels as numbers once per metric; null for a value that isn't defined.
    d = d.withColumns({f"l_{k}": F.expr(f"case v_{k} " + " ".join(f"when '{x}' then {n / 10}D" for x, n in levels.items()) + " end") for k, levels in _LEVELS.items()})
    depth_of = lambda k: F.col(f"l_{k}")
    defined = F.col("m").isNotNull() & v("E").isin("A", "P", "U") & F.forall(F.array(*map(depth_of, _LEVELS)), lambda x: x.isNotNull())
    easy = [v("AV") == "N", v("PR") == "N", v("UI") == "N"]
    safest = lambda k: F.coalesce(F.col("m")[f"M{k}"], F.lit("X")) == "S"
    high = lambda *ks: [v(k) == "H" for k in ks]
    vc, vi, va = high("VC", "VI", "VA")
    eq = {
        "eq1": F.when(easy[0] & easy[1] & easy[2], 0).when((easy[0] | easy[1] | easy[2]) & (v("AV") != "P"), 1).otherwise(2),
        "eq2": F.when((v("AC") == "L") & (v("AT") == "N"), 0).otherwise(1),
        "eq3": F.when(vc & vi, 0).when(vc | vi | va, 1).otherwise(2),
        "eq4": F.when(safest("SI") | safest("SA"), 0).when((v("SC") == "H") | (v("SI") == "H") | (v("SA") == "H"), 1).otherwise(2),
        "eq5": F.when(v("E") == "A", 0).when(v("E") == "P", 1).otherwise(2),
        "eq6": F.when(((v("CR") == "H") & vc) | ((v("IR") == "H") & vi) | ((v("AR") == "H") & va), 0).otherwise(1),
    }
    d = d.withColumns(eq)
    scores = F.from_json(F.lit(json.dumps(table)), "map<string,double>")  # a constant

    def at(**step: int) -> Column:
        digits = [(F.col(f"eq{i}") + step.get(f"eq{i}", 0)).cast("string") for i in range(1, 7)]
        return F.try_element_at(scores, F.concat(*digits))

    # The two joint classes step down in the one that can; where both can, to the higher score.
    both = F.when((F.col("eq3") == 0) & (F.col("eq6") == 0), F.greatest(at(eq6=1), at(eq3=1))).when(F.col("eq6") == 1, F.when(F.col("eq3") < 2, at(eq3=1))).when(F.col("eq3") == 1, at(eq6=1))
    d = d.withColumns({"s": at(), "s1": at(eq1=1), "s2": at(eq2=1), "s36": both, "s4": at(eq4=1), "s5": at(eq5=1)})

    def share(name: str, level: Column) -> Column:
        """How deep the vector lies in its class, from 0 to 1; null where no highest vector fits."""
        metrics, levels = _CLASSES[name]
        out = None
        for digit, (depth, tops) in levels.items():
            inner = None
            for top in tops:
                # The specification's own arithmetic, in steps of a tenth: sums of floats decide ties of rounding.
                below = [depth_of(k) - _LEVELS[k][t] / 10 for k, t in zip(metrics, top, strict=True)]
                fits, total = below[0] >= 0, below[0]
                for x in below[1:]:
                    fits, total = fits & (x >= 0), total + x
                share_of = total / (depth * 0.1)
                inner = F.when(fits, share_of) if inner is None else inner.when(fits, share_of)
            out = F.when(level == digit, inner) if out is None else out.when(level == digit, inner)
        return out

    d = d.withColumns({"d1": share("1", F.col("eq1").cast("string")), "d2": share("2", F.col("eq2").cast("string")), "d36": share("36", F.concat(F.col("eq3").cast("string"), F.col("eq6").cast("string"))), "d4": share("4", F.col("eq4").cast("string"))})
    steps = [F.when(F.col(f"s{i}").isNotNull(), (F.col("s") - F.col(f"s{i}")) * F.col(f"d{i}")) for i in ("1", "2", "36", "4")]
    lower = sum((F.col(f"s{i}").isNotNull().cast("int") for i in ("1", "2", "36", "4", "5")), F.lit(0))
    off = sum((F.coalesce(s, F.lit(0.0)) for s in steps), F.lit(0.0))
    whole = F.col("d1").isNotNull() & F.col("d2").isNotNull() & F.col("d36").isNotNull() & F.col("d4").isNotNull() & F.col("s").isNotNull()
    value = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("s") - F.when(lower > 0, off / lower).otherwise(0.0)))
    harmless = F.lit(True)
    for k in ("VC", "VI", "VA", "SC", "SI", "SA"):
        harmless = harmless & (v(k) == "N")
    result = F.when(defined, F.when(harmless, 0.0).when(whole, F.floor(value * 10 + 0.5) / 10))
    return d.withColumn("__score", result.cast("double")).select(*base, F.col("__score").alias(out))
