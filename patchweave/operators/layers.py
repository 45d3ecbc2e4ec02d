"""What an image shows of its layers: newest entries first, whiteouts and opaque directories applied.

entries: image_id, layer (ascending), path (without a leading slash), kind ('file', 'dir', 'link'), and any further
columns. A whiteout .wh.x hides x, and all below it, of lower layers; .wh..wh..opq hides what lower layers have in its
directory. Both are equi-joins on a path's ancestors, of which it has as many as components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPAQUE = ".wh..wh..opq"


def _directory(path: str = "path") -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def visible(entries: DataFrame) -> DataFrame:
    """The entries that the image shows, one per path."""
    base = F.regexp_extract("path", "[^/]*$", 0)
    rows = entries.withColumn("__base", base)
    marks = rows.filter(F.col("__base").startswith(".wh."))
    hidden = F.when(F.col("__base") == OPAQUE, _directory()).otherwise(F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.substring("__base", 5, 1_000_000)))
    marks = marks.select("image_id", hidden.alias("__target"), (F.col("__base") == OPAQUE).alias("__opaque"), "layer")
    marks = marks.groupBy("image_id", "__target", "__opaque").agg(F.max("layer").alias("__from"))
    plain = rows.filter(~F.col("__base").startswith(".wh.")).drop("__base")
    newest = plain.groupBy("image_id", "path").agg(F.max_by(F.struct(*[c for c in plain.columns if c not in ("image_id", "path")]), "layer").alias("x")).select("image_id", "path", "x.*")
    parts = F.split("path", "/")
    # The path itself and every directory above it; "" is the root.
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    reach = newest.select("image_id", "path", "layer", F.explode(above).alias("__target"))
    gone = reach.join(marks, ["image_id", "__target"]).filter((F.col("__from") > F.col("layer")) & ~(F.col("__opaque") & (F.col("__target") == F.col("path"))))
    return newest.join(gone.select("image_id", "path").distinct(), ["image_id", "path"], "left_anti").select(*entries.columns)


def files_under(shown: DataFrame, directory: str) -> DataFrame:
    """Files right in a directory; links are not followed."""
    return shown.filter((_directory() == directory.strip("/")) & (F.col("kind") == "file"))
