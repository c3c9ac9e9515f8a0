"""Connected components by alternating large-star and small-star steps.

Both steps need only the smallest neighbour of each node (an aggregate that
combines map-side) and one join with the links; no neighbour list is ever
gathered, so a node with very many links is split like any skewed join.  Each
round is written to the shared folder, which cuts the lineage; a round
replaces the one before.  The number of rounds grows with the logarithm of
the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import drop, spread, store


def _digest(df: DataFrame):
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return tuple(r)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another node; root is the
    smallest node of its component.  The result is a stored table.

    Links may repeat, run either way or join a node to itself; rows with a
    null end are ignored.  No links give an empty table."""
    big, small = F.greatest(a, b), F.least(a, b)
    now = store(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.alias("u"), small.alias("v")).distinct())
    mark = _digest(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(least, 2 * mark[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(spread(lowest, 2 * mark[0]), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(small_star.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        drop(now, large)
        now, before, mark = after, mark, _digest(after)
        if mark == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = store(roots.union(tops))
    drop(now)
    return out
