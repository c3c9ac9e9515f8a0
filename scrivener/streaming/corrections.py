"""Streaming correction (ST1).

The same DataFrame functions as the batch job run on a file stream: new
document files arriving in a folder are split into lines, corrected with the
dictionary backend, and appended to a Parquet sink.  The job is stateless
(each line is independent), so it needs no watermark; exactly-once output
comes from the checkpoint plus the file sink's commit log.  Per-batch counts
are published with ``observe`` (no extra pass over the data).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivener.operators.lines import explode_lines
from scrivener.plans.correct import correct_lines
from scrivener.session import scratch_path
from scrivener.sources.tables import is_file


def correct_stream(stream: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   keep: list[str] | None = None, add_typos=None) -> DataFrame:
    """Streaming DataFrame of corrected lines (same columns as the batch job)."""
    lines = explode_lines(stream, id_col, text_col, keep=keep)
    src = "text"
    if add_typos is not None:
        lines = lines.withColumn("typo_text", add_typos(F.col("text")))
        src = "typo_text"
    out = correct_lines(lines, text_col=src)
    out = out.observe("run_counts", F.count(F.lit(1)).alias("lines"),
                      F.sum(F.col("changed").cast("long")).alias("changed"))
    return out


def start_file_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                      prepare=None, trigger_available_now: bool = True, glob: str | None = None,
                      **kw) -> StreamingQuery:
    """Read Parquet files arriving in the folder ``source`` (optionally only
    names matching ``glob``) as a stream and append corrected lines to
    ``sink``.  ``source`` may also name a single file.  ``prepare`` may add
    derived columns to the raw stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if is_file(spark, source):
        # A stream reads folders: the one that holds the file, and of it this name alone.
        source, glob = source.rstrip("/").rsplit("/", 1)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source)
    if prepare is not None:
        stream = prepare(stream)
    out = correct_stream(stream, **kw)
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    writer = writer.trigger(availableNow=True) if trigger_available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_to_table(spark: SparkSession, source: str, schema, prepare=None, **kw) -> DataFrame:
    """Run the stream over everything now in ``source`` and return the sink
    as a table.  Sink and checkpoint live under the shared checkpoint folder."""
    tag = uuid.uuid4().hex
    sink = scratch_path(spark, f"stream-{tag}/out")
    ckpt = scratch_path(spark, f"stream-{tag}/checkpoint")
    q = start_file_stream(spark, source, schema, sink, ckpt, prepare=prepare, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink)


__all__ = ["correct_stream", "start_file_stream", "run_to_table", "Observation"]
