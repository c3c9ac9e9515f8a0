"""Token sequences and vector arrays (T1-T8, A10-A12, V5, V8, V9 helpers).

Word-level encoding looks the words of a line up row by row in a vocabulary
of proven size (``operators.lookup``).  Of a larger vocabulary the frequent words
are looked up so and the rest, a few hundredths of the tokens, are joined.  The
plain join form rebuilds the sequence per line by a ``groupBy`` on the line key with
the positions sorted inside the aggregate (so no global order is ever needed).

Vocabulary ids are dense ranks by (frequency desc, word).  A global
``row_number`` would pull the whole vocabulary into one task; ``dense_ids``
instead range-partitions and sorts, takes each partition's row count (a table
with one row per partition), turns the counts into offsets, and adds the
position within the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.joins import bounded_broadcast, materialize, row_count_at_most
from scrivener.operators.lexicon import WORD_PATTERN, words
from scrivener.operators.lookup import MAX_BYTES, log_rank, look_up, look_up_large, small_table

UNK_ID = 0
PAD_ID = 0
# Fixed value: the fixed-length (64-token) form is only built for sequences of
# at least this many tokens.
MIN_BATCH_TOKENS = 10
UNK_TOKEN = "<unk>"


def dense_ids(df: DataFrame, order: list[Column], out: str = "id", start: int = 1,
              partitions: int | None = None) -> DataFrame:
    """Dense ids ``start..start+n-1`` in ``order`` without a single-task window.
    ``order`` must be a total order (unique) for the ids to be repeatable.

    The range-partitioned, sorted rows are stored once together with their
    partition id and position in the partition, so the per-partition counts
    and the final ids are both derived from the same stored rows (two
    evaluations of the range exchange could sample different bounds)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    s = materialize(s.withColumn("_pid", F.spark_partition_id()).withColumn("_local", local))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per partition: the size is bounded by the partition count n.
    j = s.join(F.broadcast(offsets), "_pid")
    return j.withColumn(out, (F.col("_off") + F.col("_local") + F.lit(start)).cast("int")).drop("_pid", "_local", "_off")


def build_vocab(df: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """(word, freq, id): words seen ``min_count`` times (all, unless given), id 1..
    by frequency desc then word; id 0 is the unknown word."""
    counts = words(df, text_col, by=()).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    counts = counts.where(F.col("freq") >= min_count)
    # dense_ids stores the sorted rows once; the ids are that stored table
    # joined to one offset per partition, cheap to read again.
    return dense_ids(counts, [F.col("freq").desc(), F.col("word").asc()], "id", start=1)


def encode(df: DataFrame, vocab: DataFrame, text_col: str = "text", key_cols=("doc_id", "line_no"),
           out: str = "ids", max_broadcast_rows: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Words of each line → id sequence (unknown → 0).

    A vocabulary of at most ``max_bytes`` is looked up row by row, and so are the
    words of least id, the most frequent ones, of a larger one; the others are
    joined.  If ``max_broadcast_rows`` is given, all are joined, and then
    ``key_cols`` must tell the lines apart."""
    keys = list(key_cols)
    if max_broadcast_rows is None:
        known = small_table(vocab, "word", "id", max_bytes)
        found = F.coalesce(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))
        if known is not None:
            ids = df.select(*keys, look_up(df, known, found).alias(out))
        else:
            ids = look_up_large(df, vocab, "word", "id", log_rank(F.col("id")), found, keys, out, max_bytes)
        return ids.select(*keys, F.transform(out, lambda x: F.coalesce(x, F.lit(UNK_ID))).alias(out))
    toks = df.select(
        *keys,
        F.posexplode_outer(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0)).alias("pos", "word"),
    )
    v = vocab.select("word", "id")
    if row_count_at_most(v, max_broadcast_rows):
        v = F.broadcast(v)
    else:
        # Past the bound: only the vocabulary words that occur in the input
        # can be looked up, so cut the table to them (distinct words are
        # pre-aggregated map-side) and broadcast that if it fits; otherwise
        # the lookup is a shuffle join whose hot words AQE splits.
        present = toks.select("word").where(F.col("word").isNotNull()).distinct()
        v = bounded_broadcast(materialize(v.join(present, "word", "left_semi")), max_broadcast_rows)
    j = toks.join(v, "word", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return g.select(*keys, F.transform("_s", lambda x: x["id"]).alias(out))


def decode(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", key_cols=("doc_id", "line_no"),
           out: str = "decoded", max_broadcast_rows: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Id sequence → space-joined words (unknown → '<unk>'); forms as in ``encode``."""
    keys = list(key_cols)
    if max_broadcast_rows is None:
        known = small_table(vocab, "id", "word", max_bytes)
        asked = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
        if known is not None:
            found = df.select(*keys, look_up(df, known, asked).alias(out))
        else:
            found = look_up_large(df, vocab, "id", "word", log_rank(F.col("id")), asked, keys, out, max_bytes)
        return found.select(*keys, F.array_join(F.transform(out, lambda x: F.coalesce(x, F.lit(UNK_TOKEN))), " ").alias(out))
    toks = df.select(*keys, F.posexplode_outer(ids_col).alias("pos", "id"))
    v = vocab.select("id", "word")
    if row_count_at_most(v, max_broadcast_rows):
        v = F.broadcast(v)
    else:
        # As in encode: cut the vocabulary to the ids that occur.
        present = toks.select("id").where(F.col("id").isNotNull()).distinct()
        v = bounded_broadcast(materialize(v.join(present, "id", "left_semi")), max_broadcast_rows)
    j = toks.join(v, "id", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("word", F.lit(UNK_TOKEN)).alias("w")))
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return g.select(*keys, F.array_join(F.transform("_s", lambda x: x["w"]), " ").alias(out))


def truncate(ids: Column, n: int) -> Column:
    """T3."""
    return F.slice(ids, 1, n)


def pad_to(ids: Column, n: int, pad: int = PAD_ID, min_len: int = 0) -> Column:
    """T4: pad with ``pad`` or cut to exactly ``n``; sequences shorter than
    ``min_len`` get NULL (the fixed-length form is only built for sequences
    of at least that many tokens)."""
    fixed = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)
    return fixed if min_len <= 0 else F.when(F.size(ids) >= min_len, fixed)


def preview(ids: Column, n: int = 10) -> Column:
    """T5."""
    return F.slice(ids, 1, n)


def append_tokens(a: Column, b: Column) -> Column:
    """T8."""
    return F.concat(a, b)


def concat_parts(parts: DataFrame, key: str = "vec_id", part_col: str = "part_no", vals: str = "vals") -> DataFrame:
    """T6 + A12: parts of one vector in part order, concatenated; part count
    and total size.  One group is one vector (bounded by its size)."""
    ordered = F.array_sort(F.collect_list(F.struct(part_col, vals)))
    return parts.groupBy(key).agg(
        F.flatten(F.transform(ordered, lambda x: x[vals])).alias("vals"),
        F.count(F.lit(1)).alias("n_parts"),
        F.sum(F.size(vals)).alias("total_size"),
    )


def top_k_indices(v: Column, k: int = 5) -> Column:
    """0-based indices of the k largest values, ties → lower index."""
    keyed = F.transform(v, lambda x, i: F.struct((-x).alias("nx"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])


def shape_profile(df: DataFrame, array_col: str, by: str = "label") -> DataFrame:
    """Min, max and most common array size per group (ties → smaller size)."""
    sized = df.select(by, F.size(array_col).alias("size"))
    per_size = sized.groupBy(by, "size").agg(F.count(F.lit(1)).alias("c"))
    return per_size.groupBy(by).agg(
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.min(F.struct((-F.col("c")).alias("nc"), "size"))["size"].alias("common_size"),
    )


def value_range(df: DataFrame, array_col: str, by: str = "label") -> DataFrame:
    """A10: per-row array_min/array_max rolled up per group."""
    r = df.select(by, F.array_min(array_col).alias("lo"), F.array_max(array_col).alias("hi"))
    return r.groupBy(by).agg(F.min("lo").alias("min_val"), F.max("hi").alias("max_val"),
                             F.count(F.lit(1)).alias("n"))
