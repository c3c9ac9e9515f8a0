"""Join helpers.

``bounded_broadcast`` broadcasts a side only after proving its row count is
under a bound; beyond the bound the plain DataFrame is returned and Spark
plans a shuffle join (AQE may still switch it to a broadcast at run time
from the measured shuffle size, which is a size check of its own).
"""

from __future__ import annotations

import atexit
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 100_000

_STORED: dict[str, SparkSession] = {}
_SCOPE = threading.local()


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.  A plain parallel count:
    a limited one would send up to max_rows rows of every partition to one task."""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def materialize(df: DataFrame) -> DataFrame:
    """Write a derived table once, as Parquet, under the shared checkpoint
    folder (named by ``spark.checkpoint.dir``) and read it back.

    This cuts the lineage in one job (``Dataset.checkpoint`` on an uncached
    plan computes it twice: once to count, once to write), later size checks
    and joins read the stored rows instead of recomputing the upstream plan, the
    planner sees the real file sizes, and a lost executor does not send the
    job back to the source.  The table is deleted at the end of the enclosing
    ``temporary_tables`` block, else when the application ends."""
    import uuid

    from scrivener.session import scratch_path

    if getattr(df, "_scrivener_stored", False):
        return df
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    _STORED[path] = spark
    for scope in getattr(_SCOPE, "open", []):
        scope.append(path)
    stored = spark.read.parquet(path)
    stored._scrivener_stored = True
    return stored


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system it lies; none is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end: for
    steps that write their result elsewhere, again and again (a stream's batches)."""
    mine: list[str] = []
    _SCOPE.open = [*getattr(_SCOPE, "open", []), mine]
    try:
        yield
    finally:
        _SCOPE.open = _SCOPE.open[:-1]
        for path in mine:
            if path in _STORED:
                delete_path(_STORED.pop(path), path)


@atexit.register
def _delete_stored() -> None:
    """Result tables go when the application ends; a session that is stopped
    before leaves them to the platform's clean-up."""
    for path, spark in list(_STORED.items()):
        if SparkContext._active_spark_context is not None and spark._jsc is not None:
            try:
                delete_path(spark, path)
            except Exception:  # noqa: BLE001 - the JVM may be gone at exit
                return
