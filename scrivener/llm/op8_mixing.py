"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order (by a hash of the id),
over and over, up to ``most`` times.  A copy's virtual finish time is the
words its source has queued up to and including it, divided by the source's
target.  All copies are put in order of finish time and taken until the next
one would pass the budget (the sum of the targets).

Targets: sources in code point order, null last, weigh ``weights`` in turn and
share the total of all sizes; a target stops at ``most`` times its source's
size and the excess is shared again by weight.  That is one water level L
with target = min(weight * L, most * size), found from running sums over the
sources ordered by most * size / weight.

Only built-in DataFrame functions run here.  No source, time range or table
meets in one task: a source's running sum is split by buckets of the shuffle
hash (uniform, so a source with a third of all rows is many buckets), the
order by finish time by equal slices of virtual time, and the sources by
range partitions; only one row per bucket, slice or partition meets elsewhere.

Rows: one per input row.  Null text has size 0; documents of size 0 are taken
0 times.  A null source is a source of its own.  Null ids queue as the text
``null``; repeated rows are separate documents (rows alike in id, source and
size may swap places, which changes no output).  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.llm.common import WORD, drop, global_running, row_tag, store

#: Documents per bucket of a source's queue and copies per slice of virtual time.
PER_BUCKET = 2_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col):
    """60 uniform bits from the id: the first 15 hex digits of md5("mix:" + id)."""
    name = F.coalesce(id_col.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """(source, source_size, target double, time_rank) per source, and stored tables."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, s1 = global_running(per, [(F.col("source"), "asc_nulls_last")], {"rank": F.lit(1)})
    turn = (F.col("rank") - 1) % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(w)).otherwise(weight)
    ranked = ranked.withColumn("weight", weight.cast("long"))
    fill = F.col("source_size") * most / F.col("weight")
    levels, s2 = global_running(ranked, [fill, F.col("rank")], {"cap_sum": F.col("source_size") * most, "weight_sum": F.col("weight")})
    levels = store(levels)
    drop(s1, s2)
    total = levels.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    t, w = total["t"] or 0, total["w"] or 1
    # The water level if just the sources before this one (in order of fill) stop at their caps.
    before_cap, before_w = F.col("cap_sum") - F.col("source_size") * most, F.col("weight_sum") - F.col("weight")
    level = (F.lit(t) - before_cap).cast("double") / (F.lit(w) - before_w)
    fits = levels.select(level.alias("level"), fill.alias("fill"), "rank").where("level <= fill")
    found = fits.orderBy("fill", "rank").select("level").first()
    water = found["level"] if found else 0.0
    target = F.least(F.col("weight") * F.lit(float(water)), (F.col("source_size") * most).cast("double"))
    return levels.select("source", "source_size", target.alias("target"), F.col("rank").alias("time_rank")), [levels]


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = (5, 2, 1), most: int = 3, tag: Column | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies long, taken long, tag) per
    row; ``tag`` (any type that sorts) tells apart rows with one id."""
    spark = df.sparkSession
    sizes = store(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                            shuffle_key(F.col(id_col)).alias("key"), (F.lit(0).cast("long") if tag is None else tag).alias("tag")))
    targets, held = source_targets(sizes, weights, most)
    n = sizes.count()
    buckets = max(1, n // PER_BUCKET)
    bucketed = sizes.withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << 60)) * buckets))
    per_bucket = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "tag").rowsBetween(Window.unboundedPreceding, 0)
    queue = bucketed.withColumn("cum", F.sum("size").over(inside)).alias("q").join(
        starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
    queue = store(queue.select("q.id", "q.tag", "q.source", "q.size", "s.source_size", "s.target", "s.time_rank", (F.col("cum") + F.col("start")).alias("cum")))
    drop(sizes, *held)

    def finish(turn):
        return (F.col("cum") + F.col("source_size") * turn) / F.col("target")

    copies = queue.where("size > 0 and target > 0").select(
        "size", "time_rank", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"), "cum", "source_size", "target")
    copies = copies.select("size", "time_rank", (F.col("cum") + F.col("source_size") * F.col("turn")).alias("at"), finish(F.col("turn")).alias("time"))
    budget = queue.select("source", "target").distinct().agg(F.sum("target").alias("t")).first()["t"] or 0.0
    budget = round(budget)  # the targets share a whole number of words
    cut = _cut(copies, budget, max(1, n // PER_BUCKET))
    if cut is None:
        taken = F.lit(0)
    else:
        time, rank, at = cut
        taken = sum((F.when((finish(F.lit(i)) < time) | ((finish(F.lit(i)) == time) & (
            (F.col("time_rank") < rank) | ((F.col("time_rank") == rank) & (F.col("cum") + F.col("source_size") * i <= at)))), 1).otherwise(0)
            for i in range(most)), F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    copies_taken = taken.cast("long")
    return queue.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                        copies_taken.alias("copies"), (copies_taken * F.col("size")).alias("taken"), "tag")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (not at all, once
    or up to ``most`` times)."""
    every = [F.col(f"`{c}`") for c in df.columns]
    tag = row_tag(df)
    found = mix(df, id_col, source_col, text_col, weights, most, tag)
    # Rows alike in all columns share id and tag; one of them stands for all.
    same = F.struct(F.col(f"`{id_col}`").alias("id"), F.col("tag"))
    copies = found.groupBy(same.alias("__same")).agg(F.sum("copies").cast("int").alias("__n")).where("__n > 0")
    rows = df.select(F.struct(*every).alias("__row"), F.struct(F.col(f"`{id_col}`").alias("id"), tag.alias("tag")).alias("__key"))
    rows = rows.join(copies, F.col("__key").eqNullSafe(F.col("__same"))).dropDuplicates(["__key"])
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def _cut(copies: DataFrame, budget: int, slices: int):
    """(time, source rank, words queued) of the last copy that fits the budget.

    Slices of virtual time of equal width (each holds about budget / slices
    words, as every source is served at its target rate) are summed first;
    running sums over copies are needed in one slice only."""
    cut = copies.withColumn("slice", F.floor(F.col("time") * slices))
    per = cut.groupBy("slice").agg(F.sum("size").alias("s"))
    upto = per.select("slice", F.sum("s").over(Window.orderBy("slice")).alias("upto"), "s")
    over = upto.where(F.col("upto") > budget).orderBy("slice").first()
    if over is None:  # all copies fit
        last = copies.agg(F.max(F.struct("time", "time_rank", "at")).alias("m")).first()["m"]
        return tuple(last) if last else None
    # The first slice that passes the budget: what fits in it, else the end of what precedes it.
    running = Window.partitionBy("slice").orderBy("time", "time_rank", "at").rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.where(F.col("slice") == over["slice"]).withColumn("run", F.sum("size").over(running))
    best = inside.where(F.col("run") <= budget - (over["upto"] - over["s"]))
    earlier = cut.where(F.col("slice") < over["slice"])
    for part in (best, earlier):
        last = part.agg(F.max(F.struct("time", "time_rank", "at")).alias("m")).first()["m"]
        if last:
            return tuple(last)
    return None


#: DuckDB SQL of the same mix.  The water level is searched among the sources
#: in order of the level at which each stops.
ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM ranked),
filled AS (SELECT *, (source_size * 3)::DOUBLE / weight AS fill, (SELECT sum(source_size) FROM src) AS t, sum(weight) OVER () AS w FROM weighed),
levels AS (SELECT *, (t - coalesce(sum(source_size * 3) OVER b, 0))::DOUBLE / (w - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level FROM filled
           WINDOW b AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT coalesce((SELECT level FROM levels WHERE level <= fill ORDER BY fill, rank LIMIT 1), 0.0) AS level),
tgt AS (SELECT source, source_size, rank, least(weight * (SELECT level FROM water), (source_size * 3)::DOUBLE) AS target FROM levels),
q AS (SELECT d.doc_id, d.size, tgt.source_size, tgt.target, tgt.rank,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum,
             row_number() OVER () AS rid
      FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source),
copies AS (SELECT rid, size, rank, cum + source_size * turn AS queued, (cum + source_size * turn)::DOUBLE / target AS time
           FROM q, (VALUES (0), (1), (2)) AS p(turn) WHERE size > 0 AND target > 0),
run AS (SELECT rid, sum(size) OVER (ORDER BY time, rank, queued ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies),
got AS (SELECT rid, count(*) AS copies FROM run WHERE upto <= (SELECT sum(source_size) FROM src) GROUP BY rid)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN got USING (rid)
"""
