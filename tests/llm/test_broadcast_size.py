"""What is exploded or grows with the input is dealt out, however small Spark takes it to be."""

from pyspark.sql import functions as F

from scrivener.llm import common
from scrivener.llm.op2_simhash import links


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def _sent(df):
    """The build sides of the broadcast joins that are planned."""
    for node in _nodes(df._jdf.queryExecution().sparkPlan()):
        if node.nodeName().startswith("Broadcast"):
            yield (node.right() if node.buildSide().toString() == "BuildRight" else node.left()).toString()


def test_cells_are_not_broadcast(spark):
    made = spark.range(3000).select(F.xxhash64("id").alias("fp")).union(spark.range(60).select((F.lit(1) + F.col("id")).alias("fp")))
    classes = common.store(made)
    for distance in (2, 3):
        found = links(classes, distance, crowd=8)
        assert not [side for side in _sent(found) if "Generate" in side]
        fps = [r.fp for r in classes.collect()]
        near = {(a, b) for a in fps[3000:] for b in fps[3000:] if a < b and (a ^ b).bit_count() <= distance}
        got = {(min(r), max(r)) for r in found.collect()}
        assert got <= near and {x for r in got for x in r} == {x for r in near for x in r}
    common.drop(classes)


def test_a_table_of_known_size_is_spread_past_the_bound(spark):
    one = spark.range(10)
    plan = lambda rows: one.join(common.spread(one.withColumn("x", F.lit(1)), rows), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(common.BROADCAST_ROWS)
    assert "SortMergeJoin" in plan(common.BROADCAST_ROWS + 1) and "SortMergeJoin" in plan(None)
