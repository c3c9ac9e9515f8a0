"""Name templates learned from the names.

Names are cut into parts, and names with the same number of parts form a
tree: level by level, the values that stand at the next place under one template
are counted, and where there are more than ``most`` different ones the place
becomes ``*``.  A place with few values keeps them, each with a branch of its own.  The
tree has a fixed depth; places beyond it are ``*``.  Each level is one aggregation of
distinct names (equal names are counted once, before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.operators.joins import materialize

ANY = "*"
# More different values than this at one place make it a variable.
MOST_VALUES = 8
DEPTH = 6


def url_parts(url: Column) -> Column:
    """Host and path segments of a url, without query and fragment."""
    return F.split(F.regexp_replace(F.regexp_replace(url, r"^[^:/?#]*://", ""), r"[?#].*$", ""), "/")


def learned_templates(df: DataFrame, parts: Column, most: int = MOST_VALUES, depth: int = DEPTH) -> DataFrame:
    """(template, n_parts, n): the templates and how many rows follow each.
    Rows without parts (null) are left out."""
    if most < 1 or depth < 1:
        raise ValueError("most and depth must be at least 1")
    names = df.select(parts.alias("p")).where(F.col("p").isNotNull()).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    level = materialize(names.select("p", "n", F.size("p").alias("n_parts"), F.array().cast("array<string>").alias("t")))
    for at in range(depth):
        here = F.get("p", F.lit(at))
        values = level.where(F.col("n_parts") > at).groupBy("n_parts", "t", here.alias("v")).agg(F.lit(1).alias("one")).groupBy("n_parts", "t").agg(F.count(F.lit(1)).alias("kinds"))
        j = level.join(values, ["n_parts", "t"], "left")
        step = F.when(F.col("kinds") > most, F.lit(ANY)).otherwise(here)
        level = materialize(j.select("p", "n", "n_parts", F.when(F.col("n_parts") > at, F.concat("t", F.array(step))).otherwise(F.col("t")).alias("t")))
    rest = F.array_repeat(F.lit(ANY), F.greatest(F.col("n_parts") - depth, F.lit(0)))
    return level.groupBy(F.array_join(F.concat("t", rest), "/").alias("template"), "n_parts").agg(F.sum("n").alias("n"))
