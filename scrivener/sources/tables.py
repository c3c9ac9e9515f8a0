"""Parquet table sources.

Tables are read lazily; Catalyst prunes columns and pushes filters into the
scan, so callers just ``select`` what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small_scan(df) if spread else df


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a single file (a table may be that, or a folder of files)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


# A scan with fewer splits than this (and than the cluster's cores) is
# spread; with at most this many splits of at most maxPartitionBytes each,
# the extra shuffle moves a few GB at most.
SPREAD_MAX_SPLITS = 64


def spread_small_scan(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that has only a handful of splits.

    The row-local work after the scan (line splitting, regexes) runs in the
    scan's tasks; a small file with one row group would put all of it in one
    task.  The check is made at plan time from the file splits: an input with
    many splits is left as it is, so no shuffle is added at scale.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except (AttributeError, NotImplementedError):  # a Spark Connect session has no RDD view
        return df
    if splits >= min(target, SPREAD_MAX_SPLITS):
        return df
    return df.repartition(target)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text source (S4): one row per file, the whole file as ``text``.

    Returns ``(doc_id BIGINT, path STRING, text STRING)``; ``doc_id`` is a
    hash of the file path, so reruns and streams agree without a global
    index.  Lines are cut later by ``operators.lines.explode_lines``, which
    keeps their order as ``line_no``.
    """
    from pyspark.sql import functions as F

    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.select(F.xxhash64("path").alias("doc_id"), "path", F.col("value").alias("text"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text source by line (S4): ``(doc_id STRING, line_no BIGINT, text
    STRING)``, where ``doc_id`` is the file's path and ``line_no`` counts its
    lines from 0, blank ones included.

    A large file is read in several splits.  Lines are numbered within a split
    (a window of one split's rows) and the splits' line counts, one row each,
    become offsets; no task holds a file."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("_block"),
                                       F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("text"))
    inside = Window.partitionBy("doc_id", "_block").orderBy("_seq")
    lines = raw.withColumn("_n", F.row_number().over(inside).cast("long") - 1)
    counts = raw.groupBy("doc_id", "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    joined = lines.join(offsets, ["doc_id", "_block"])
    return joined.select("doc_id", (F.col("_off") + F.col("_n")).alias("line_no"), "text")


def running_line_no(lines: DataFrame) -> DataFrame:
    """The lines of ``read_text_lines`` with ``line_no`` counted on over all
    files in order of path.  Only a row per file meets in the window that turns
    line counts into offsets."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return lines.join(offsets, "doc_id").withColumn("line_no", F.col("line_no") + F.col("_off")).drop("_off")
