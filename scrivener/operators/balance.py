"""Tasks of equal cost (G1: length balance).

The model's time follows the tokens of a prompt, not the number of rows, and
prompts differ by orders of magnitude.  Rows are dealt to tasks by the running
sum of their cost, so every task gets about the total divided by the number of
tasks; a task passes that mean by one row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.joins import materialize


def equal_tasks(df: DataFrame, order: str, cost: str, tasks: int, out: str = "task") -> DataFrame:
    """Adds ``out``, 0 to tasks - 1: runs of rows, in the order of the unique
    column ``order``, whose costs (whole numbers, 0 or more) add up alike.

    The running sum needs no single-task window: ranges of ``order`` are summed
    one by one, and only one row per range meets for the ranges' offsets."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(F.sum(cost).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    total = per.agg(F.sum("_s")).first()[0] or 0
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(cost).over(inside) + F.col("_start")
    # One row per range: as many as the shuffle has partitions.
    placed = ranged.join(F.broadcast(starts), "_range")
    # A row goes where the middle of its cost falls.
    share = F.floor((upto - F.col(cost) / 2) * tasks / F.lit(max(float(total), 1.0)))
    return placed.withColumn(out, F.least(share, F.lit(tasks - 1)).cast("int")).drop("_range", "_start")
