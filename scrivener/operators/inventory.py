"""Inventories over path-like names (S10, A13) and declared-vs-observed
drift (A14).

All three are aggregations keyed by a derived column (directory, template,
component/tensor), so the shuffle carries one partial count per key per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dir_and_file(path: Column) -> tuple[Column, Column]:
    """Split a path or URL at its last '/'."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)


def directory_inventory(df: DataFrame, path_col: str, file_pattern: str) -> DataFrame:
    """Directories holding at least one file whose name matches
    ``file_pattern``, with the number of matching files."""
    d, f = dir_and_file(F.col(path_col))
    hits = df.select(d.alias("dir"), f.rlike(file_pattern).alias("hit"))
    counts = hits.groupBy("dir").agg(F.sum(F.col("hit").cast("long")).alias("n_files"))
    return counts.where(F.col("n_files") > 0)


def binary_file_inventory(spark, root: str, file_pattern: str) -> DataFrame:
    """S10 over a real file tree: only path and length are read (no content)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    return directory_inventory(files, "path", file_pattern)


def name_templates(df: DataFrame, name_col: str) -> DataFrame:
    """Numbers in a name become '*'; count names per template."""
    t = F.regexp_replace(F.col(name_col), "[0-9]+", "*")
    return df.groupBy(t.alias("template")).agg(F.count(F.lit(1)).alias("n"))


def shape_drift(declared: DataFrame, observed: DataFrame, keys=("component", "tensor")) -> DataFrame:
    """Full outer join on the keys; status match / mismatch / missing
    (declared only) / extra (observed only)."""
    d = declared.select(*keys, F.col("shape").alias("declared"))
    o = observed.select(*keys, F.col("shape").alias("observed"))
    j = d.join(o, list(keys), "full_outer")
    status = (
        F.when(F.col("observed").isNull(), "missing")
        .when(F.col("declared").isNull(), "extra")
        .when(F.col("declared").eqNullSafe(F.col("observed")), "match")
        .otherwise("mismatch")
    )
    return j.select(*keys, "declared", "observed", status.alias("status"))
