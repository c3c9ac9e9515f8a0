"""Corrections learned from a stream (ST1 on the corpus backend).

Every micro-batch adds its word counts to a versioned table; version N holds
the counts of batches 0 .. N, so the corrections of the last version are those
that the batch job learns from all files at once.

Layout under ``folder`` (a shared folder):

* ``deltas/batch_id=N`` — word counts of batch N alone.
* ``bases/upto=N`` — counts of batches 0 .. N, written for every
  ``merge_every``-th batch from the base before it and the deltas since.  A
  batch therefore costs its own distinct words, and the whole table is rewritten
  once in ``merge_every`` batches only.
* ``versions/batch_id=N`` — one row, written last: version N is whole.
* ``settings`` — one row: the column names and ``merge_every``.

Each step depends on the batch number and on files of earlier batches alone and
overwrites its own folder, so a batch that Spark replays after a failure gives
the same files again (exactly once).  A base and the deltas in it go one
merge later, when no replay can ask for them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivener.operators.joins import delete_path, materialize, temporary_tables
from scrivener.operators.lexicon import DEFAULT_RATIO, apply_corrections, build_lexicon, corrections_from_counts
from scrivener.session import scratch_path


def _base_before(batch_id: int, merge_every: int) -> int:
    """The newest base that a version needs: the last merged batch up to it, -1 for none."""
    return (batch_id + 1) // merge_every * merge_every - 1


def _sum(parts: list[DataFrame], by) -> DataFrame:
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*by, "word").agg(F.sum("freq").alias("freq"))


def _pieces(spark: SparkSession, folder: str, base: int, last: int) -> list[DataFrame]:
    paths = [f"{folder}/bases/upto={base}"] if base >= 0 else []
    paths += [f"{folder}/deltas/batch_id={i}" for i in range(base + 1, last + 1)]
    return [spark.read.parquet(p) for p in paths]


def add_batch(batch: DataFrame, batch_id: int, folder: str, text_col: str = "text", by=("lang",), merge_every: int = 8) -> None:
    """Adds the word counts of one micro-batch as version ``batch_id``."""
    spark = batch.sparkSession
    settings = (",".join(by), merge_every)
    if batch_id == 0:
        spark.createDataFrame([settings], "by string, merge_every int").write.mode("overwrite").parquet(f"{folder}/settings")
    elif (kept := _settings(spark, folder)) != settings:
        raise ValueError(f"the table in {folder} was begun with (by, merge_every) = {kept}, not {settings}")
    build_lexicon(batch, text_col, by).write.mode("overwrite").parquet(f"{folder}/deltas/batch_id={batch_id}")
    if (batch_id + 1) % merge_every == 0:
        before = batch_id - merge_every
        merged = _sum(_pieces(spark, folder, before, batch_id), by)
        merged.write.mode("overwrite").parquet(f"{folder}/bases/upto={batch_id}")
        # Batch ``before`` ended long ago: what it was made of is never read again.
        delete_path(spark, f"{folder}/bases/upto={before - merge_every}")
        for i in range(max(before - merge_every + 1, 0), before + 1):
            delete_path(spark, f"{folder}/deltas/batch_id={i}")
    counts = spark.read.parquet(f"{folder}/deltas/batch_id={batch_id}")
    done = counts.agg(F.count(F.lit(1)).alias("new_words"), F.coalesce(F.sum("freq"), F.lit(0)).alias("occurrences"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/batch_id={batch_id}")


def _settings(spark: SparkSession, folder: str) -> tuple[str, int]:
    row = spark.read.parquet(f"{folder}/settings").first()
    return row["by"], row["merge_every"]


def last_version(spark: SparkSession, folder: str) -> int:
    """The newest whole version."""
    return int(spark.read.parquet(f"{folder}/versions").agg(F.max("batch_id")).first()[0])


def word_counts(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(by..., word, freq) of a version, the newest if none is named.  Versions
    before the last base but one are gone."""
    version = last_version(spark, folder) if version is None else version
    by, merge_every = _settings(spark, folder)
    return _sum(_pieces(spark, folder, _base_before(version, merge_every), version), [b for b in by.split(",") if b])


def learned_corrections(spark: SparkSession, folder: str, version: int | None = None, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """(by..., word, cand, dist, freq): what ``train_corrections`` learns from
    all lines of batches 0 .. version."""
    by = [b for b in _settings(spark, folder)[0].split(",") if b]
    return corrections_from_counts(materialize(word_counts(spark, folder, version)), ratio, by)


def start_learned_stream(lines: DataFrame, folder: str, checkpoint: str, text_col: str = "text", by=("lang",), merge_every: int = 8,
                         sink: str | None = None, ratio: float = DEFAULT_RATIO, available_now: bool = True) -> StreamingQuery:
    """Learns from a stream of lines; with ``sink``, also writes each batch's
    lines, corrected by all that was learned up to and with that batch, to
    ``sink/batch_id=N`` (column ``corrected``; replays overwrite)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if not sink:
            add_batch(batch, batch_id, folder, text_col, by, merge_every)
            return
        with temporary_tables():
            # Counted and corrected from one read of the source.
            numbered = materialize(batch.withColumn("__row", F.monotonically_increasing_id()))
            add_batch(numbered, batch_id, folder, text_col, by, merge_every)
            picks = learned_corrections(batch.sparkSession, folder, batch_id, ratio)
            fixed = apply_corrections(numbered, picks, text_col, by, ("__row",))
            keep = [c for c in batch.columns if c != "corrected"]
            numbered.join(fixed, "__row").select(*keep, "corrected").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def learn_files(spark: SparkSession, source: str, schema, prepare, text_col: str = "text", by=("lang",), files_per_batch: int = 64,
                merge_every: int = 8, glob: str | None = None) -> DataFrame:
    """Streams every file now in ``source`` through ``start_learned_stream``
    and returns the corrections of the last version; ``prepare`` makes lines
    of the raw rows."""
    base = scratch_path(spark, f"learned-{uuid.uuid4().hex}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # A batch of few files is few tasks: its rows are dealt to all before they are cut.
    rows = reader.parquet(source).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    query = start_learned_stream(prepare(rows), f"{base}/counts", f"{base}/checkpoint", text_col, by, merge_every)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return learned_corrections(spark, f"{base}/counts")
