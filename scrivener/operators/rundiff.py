"""Two runs compared by fingerprints (A5).

A run is stored with a fingerprint: its rows fall into ranges of a hash of their
key, and each range has its number of rows and order-free sums of two hashes over
all columns (nulls marked), so equal ranges hold equal multisets of rows.  Two runs
are compared by joining those few rows; the tables themselves are read only in the
ranges that differ, and only rows of those ranges are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.operators.joins import materialize

RANGES = 1024


def _marked(df: DataFrame) -> list[Column]:
    """Every column and whether it is null; nested ones as JSON with their nulls."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        out += [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c]
    return out


def _range(keys, ranges: int) -> Column:
    return F.pmod(F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))]), F.lit(ranges)).cast("int")


def fingerprint(df: DataFrame, keys=("doc_id", "line_no"), ranges: int = RANGES) -> DataFrame:
    """(range, n, one, two): one row per range that holds rows."""
    marked = _marked(df)
    hashes = df.select(_range(keys, ranges).alias("range"), F.xxhash64(*marked).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *reversed(marked)).cast("decimal(38,0)").alias("b"))
    return hashes.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("one"), F.sum("b").alias("two"))


@dataclass
class Run:
    """A stored run and its fingerprint."""

    rows: DataFrame
    prints: DataFrame
    keys: tuple[str, ...]
    ranges: int


def store_run(df: DataFrame, keys=("doc_id", "line_no"), ranges: int = RANGES) -> Run:
    rows = materialize(df)
    return Run(rows, materialize(fingerprint(rows, keys, ranges)), tuple(keys), ranges)


def differing_ranges(a: Run, b: Run) -> DataFrame:
    """(range) where the runs do not hold the same rows."""
    if (a.keys, a.ranges) != (b.keys, b.ranges) or a.rows.columns != b.rows.columns:
        raise ValueError("the runs have other columns, keys or ranges")
    one, two = a.prints.alias("a"), b.prints.alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.one").eqNullSafe(F.col("b.one")) & F.col("a.two").eqNullSafe(F.col("b.two"))
    return one.join(two, F.col("a.range") == F.col("b.range"), "full_outer").where(~same).select(F.coalesce("a.range", "b.range").alias("range"))


def run_diff(a: Run, b: Run) -> DataFrame:
    """(all columns, n_a, n_b): the rows that one run holds more often than the
    other, and how often each holds them."""
    ranges = materialize(differing_ranges(a, b))  # at most a.ranges rows

    def inside(run: Run, mine: int, other: int) -> DataFrame:
        at = run.rows.withColumn("__range", _range(run.keys, run.ranges)).join(F.broadcast(ranges), F.col("__range") == F.col("range"), "left_semi").drop("__range")
        return at.withColumn("__a", F.lit(mine)).withColumn("__b", F.lit(other))

    both = inside(a, 1, 0).unionByName(inside(b, 0, 1))
    sums = both.groupBy(*a.rows.columns).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"))
    return sums.where("n_a <> n_b")
