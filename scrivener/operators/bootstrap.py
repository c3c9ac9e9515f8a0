"""How sure an accuracy, or the difference of two, is.

Poisson bootstrap: in every replica each row counts a Poisson(1) number of
times.  The counts come from md5 of the row's key, so a rerun on any engine and
any partitioning draws the same; one md5 gives eight replicas 16 bits each.  The
replicas are drawn and summed batch by batch in a worker: one pass over the rows,
no row is multiplied, and a row per group and replica leaves a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from scrivener.operators.counts import _groups, _one
from scrivener.operators.generate import _package_by_value

REPLICAS = 96
PER_HASH = 8
# 65536 times the chance of at most 0, 1, 2 ... sightings under Poisson(1), rounded down.
POISSON = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)


def poisson_weights(key: Column, replicas: int = REPLICAS) -> Column:
    """An array of ``replicas`` counts, from md5 of "key|block"."""
    def block(i):
        h = F.md5(F.concat(key, F.lit("|"), i.cast("string")))
        draws = F.transform(F.sequence(F.lit(0), F.lit(PER_HASH - 1)), lambda j: F.conv(F.substr(h, j * 4 + 1, F.lit(4)), 16, 10).cast("int"))
        return F.transform(draws, lambda u: sum(F.when(u >= t, 1).otherwise(0) for t in POISSON))

    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-replicas // PER_HASH) - 1)), block)
    return F.slice(F.flatten(blocks), 1, replicas)


def _drawn(keys: list, replicas: int) -> np.ndarray:
    """``poisson_weights`` of each key, a row each, after a column of ones; a null key is never drawn."""
    blocks = [f"|{i}".encode() for i in range(-(-replicas // PER_HASH))]
    named = [k.encode() if k is not None else b"" for k in keys]
    bits = np.frombuffer(b"".join([md5(k + b, usedforsecurity=False).digest() for k in named for b in blocks]), ">u2")
    of = np.searchsorted(POISSON, np.arange(1 << 16), side="right")
    out = np.ones((len(keys), replicas + 1), np.int64)
    out[:, 1:] = of[bits].reshape(len(keys), -1)[:, :replicas]
    out[[i for i, k in enumerate(keys) if k is None], 1:] = 0
    return out


def _summed(rows: DataFrame, by: list[str], replicas: int) -> DataFrame:
    """(by..., replica, n, s) of each batch of ``rows`` (by..., v, k): how often the
    replica counts its rows, and the sum of ``v`` over them.  Replica 0 counts every row once."""
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields[:-2]],
                         StructField("replica", IntegerType()), StructField("n", LongType()), StructField("s", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            _, first, group = np.unique(_groups(table.drop_columns(["v"])), return_index=True, return_inverse=True)
            n, s = np.zeros((len(first), replicas + 1), np.int64), np.zeros((len(first), replicas + 1))
            v, keys = _one(table.column("v")).to_numpy(), _one(table.column("k")).to_pylist()
            for lo in range(0, len(keys), 4096):
                part = slice(lo, lo + 4096)
                w = _drawn(keys[part], replicas)
                np.add.at(n, group.reshape(-1)[part], w)
                np.add.at(s, group.reshape(-1)[part], w * v[part, None])
            of, replica = np.nonzero(n)
            own = [_one(table.column(b)).take(pa.array(first[of])) for b in by]
            yield pa.RecordBatch.from_arrays([*own, pa.array(replica.astype(np.int32)), pa.array(n[of, replica]), pa.array(s[of, replica])], names=schema.names)

    with _package_by_value():
        return rows.mapInArrow(run, schema)


def mean_interval(df: DataFrame, value: Column, key: Column, by=("lang",), replicas: int = REPLICAS, level: float = 0.95) -> DataFrame:
    """(by..., n, mean, lo, hi): the mean of ``value`` and the bounds between
    which ``level`` of the replicas' means lie.  Null values are left out; ``key``
    names a row."""
    if replicas < 2 or not 0 < level < 1:
        raise ValueError("at least two replicas and a level between 0 and 1 are needed")
    rows = df.select(*by, value.cast("double").alias("v"), key.cast("string").alias("k")).where(F.col("v").isNotNull())
    sums = _summed(rows, list(by), replicas).groupBy(*by, "replica").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    own = F.col("replica") == 0
    per = sums.groupBy(*by).agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("s") / F.col("n"))).alias("mean"),
                                F.array_sort(F.collect_list(F.when(~own, F.col("s") / F.col("n")))).alias("m"))  # one entry per replica
    skip = (1 - level) / 2
    lo = F.floor(F.lit(skip) * F.size("m")).cast("int")
    return per.select(*by, "n", F.round("mean", 6).alias("mean"), F.round(F.get("m", lo), 6).alias("lo"), F.round(F.get("m", F.size("m") - 1 - lo), 6).alias("hi"))


def accuracy_interval(df: DataFrame, output_col: str = "corrected", expected_col: str = "expected", keys=("doc_id", "line_no"), by=("lang",),
                      replicas: int = REPLICAS) -> DataFrame:
    """A3 with its bounds: the share of rows whose output is as expected."""
    right = F.coalesce(F.col(output_col) == F.col(expected_col), F.lit(False)).cast("int")
    return mean_interval(df, right, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), by, replicas)


def win_interval(df: DataFrame, out_a: str, out_b: str, expected_col: str = "expected", keys=("doc_id", "line_no"), by=(), replicas: int = REPLICAS) -> DataFrame:
    """A6 with its bounds: the share of rows that only a gets right less the share
    that only b gets right; bounds on one side of 0 tell a real difference."""
    right = lambda c: F.coalesce(F.col(c) == F.col(expected_col), F.lit(False)).cast("int")
    return mean_interval(df, right(out_a) - right(out_b), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), by, replicas)
