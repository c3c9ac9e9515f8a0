"""Helpers shared by the training-data operators: stored tables, global
running sums, broadcast tokenizer files and text batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrivener.session import scratch_path

#: A word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Removes the shuffle files of a query when it ends; ours write a table and
#: later steps read that table, never the shuffle files.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a table that a join may still broadcast, a few tens of MB.
BROADCAST_ROWS = 250_000

_STORED: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside release their shuffle files."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the folder all executors share
    (``spark.checkpoint.dir``) and read it back: later steps depend on the
    files alone, so a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{uuid.uuid4().hex}")
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _STORED[path] = spark
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._stored_at = path
    return out


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that deals both sides out by their keys, unless
    it is known to have at most ``BROADCAST_ROWS`` rows.  Spark sizes an exploded
    table as the one it came from and a stored one as its compressed file, and
    would send tables of many times its limit through the driver."""
    return df if rows is not None and rows <= BROADCAST_ROWS else df.hint("merge")


def drop(*stored: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in stored:
        _delete(df._stored_at)


def _delete(path: str) -> None:
    spark = _STORED.pop(path, None)
    if spark is None:
        return
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    """Result tables go when the application ends (the driver's own exit; a
    session that is stopped already leaves them to the platform's clean-up)."""
    from pyspark import SparkContext

    for path, spark in list(_STORED.items()):
        if SparkContext._active_spark_context is not None and spark._jsc is not None:
            try:
                _delete(path)
            except Exception:  # noqa: BLE001 - the JVM may be gone at exit
                return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_running(df: DataFrame, order: list[Column], sums: dict[str, Column], prefix: str = "__") -> tuple[DataFrame, DataFrame]:
    """Running sums over a total order without a single-task window.

    ``df`` is range-partitioned by ``order`` and stored with its partition
    number; only one row per partition meets in the window that turns
    partition totals into offsets.  Adds a column per entry of ``sums``: its
    sum over all rows up to and including this one.  Returns (result, stored
    table to drop when the result is no longer read)."""
    spark = df.sparkSession
    keys = [f"{prefix}o{i}" for i in range(len(order))]
    vals = {name: f"{prefix}v_{name}" for name in sums}
    pid = f"{prefix}pid"
    part = df.select("*", *[c.alias(k) for c, k in zip(_bare(order), keys)], *[e.alias(vals[n]) for n, e in sums.items()])
    by = [_like(c, F.col(k)) for c, k in zip(order, keys)]
    stored = store(part.repartitionByRange(partitions(spark), *by).withColumn(pid, F.spark_partition_id()))
    totals = stored.groupBy(pid).agg(*[F.sum(v).alias(v) for v in vals.values()])
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(pid), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_off") for v in vals.values()])
    inside = Window.partitionBy(pid).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = stored.join(F.broadcast(offsets), pid)  # one row per partition of the shuffle
    out = out.select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"{v}_off")).alias(n) for n, v in vals.items()])
    return out, stored


def row_tag(df: DataFrame) -> Column:
    """A struct of two 64-bit hashes over all columns that tells rows apart,
    also rows that differ only in which column is null (``xxhash64`` alone
    skips nulls, so it is given each column's null flag; nested columns are
    hashed as JSON with their nulls)."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        parts += [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c]
    return F.struct(F.xxhash64(*parts).alias("one"), F.xxhash64(F.lit(1), *reversed(parts)).alias("two"))


def _bare(order: list) -> list[Column]:
    return [c[0] if isinstance(c, tuple) else c for c in order]


def _like(c, col: Column) -> Column:
    """``c`` is a column or (column, "desc" | "asc_nulls_last" ...)."""
    return getattr(col, c[1])() if isinstance(c, tuple) else col.asc()


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows with about ``most`` bytes of text
    (a longer text stands alone), so that work space follows ``most`` and the
    longest single text, not the batch."""
    import numpy as np

    col = batch.column(text)
    if len(col) == 0:
        return
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype("int64")
    group = np.cumsum(size + 16) // most
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
    for a, b in zip(starts, [*starts[1:], len(col)]):
        yield batch.slice(a, b - a)
