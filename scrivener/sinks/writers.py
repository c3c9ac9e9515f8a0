"""Sinks and output shapes.

Output order is carried by ``(doc_id, line_no)``.  JSON goes out as JSON
Lines (one record per line, or one envelope per document) or as one envelope
spread over ordered part files, written in parallel by the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(df: DataFrame, path: str, col: str = "corrected", mode: str = "overwrite") -> None:
    """Corrected text, one per line, in input order.  A range sort keeps
    order across the written part files without funnelling into one task."""
    df.orderBy("doc_id", "line_no").select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def json_records(df: DataFrame, model: str, temperature: float, max_tokens: int,
                 input_col: str = "text", output_col: str = "corrected") -> DataFrame:
    """One JSON object per line with the run settings."""
    rec = F.struct(
        F.col(input_col).alias("input"),
        F.col(output_col).alias("output"),
        F.lit(model).alias("model"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(int(max_tokens)).alias("max_tokens"),
    )
    return df.select("doc_id", "line_no", F.to_json(rec, {"ignoreNullFields": "false"}).alias("json"))


def json_per_document(df: DataFrame, model: str, temperature: float, max_tokens: int,
                      input_col: str = "text", output_col: str = "corrected") -> DataFrame:
    """One batch envelope per document, results in line order.  A
    document's lines came from one cell of the input, so its envelope is as
    large as that cell, by a constant; the shape does not depend on size."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.col(input_col).alias("input"),
                                                   F.col(output_col).alias("output"))))
    results = F.transform(ordered, lambda r: F.struct(r["input"].alias("input"), r["output"].alias("output")))
    env = F.struct(
        results.alias("results"),
        F.lit(model).alias("model"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(int(max_tokens)).alias("max_tokens"),
    )
    return df.groupBy("doc_id").agg(F.to_json(env, {"ignoreNullFields": "false"}).alias("json"))


def json_envelope(df: DataFrame, model: str, temperature: float, max_tokens: int,
                  input_col: str = "text", output_col: str = "corrected") -> DataFrame:
    """The single-envelope form of a whole run, as ordered lines ``value``: an
    opening line, one line per result (a comma before all but the first), and
    a closing line with the settings.  Written as text, the part files in
    order are one JSON document of any size; no task holds it whole."""
    spark = df.sparkSession
    record = F.struct(F.col(input_col).alias("input"), F.col(output_col).alias("output"))
    rows = df.select(F.lit(1).alias("part"), "doc_id", "line_no", F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    first = df.agg(F.min(F.struct("doc_id", "line_no")).alias("m")).first()["m"]
    if first is not None:
        is_first = F.col("doc_id").eqNullSafe(F.lit(first["doc_id"])) & F.col("line_no").eqNullSafe(F.lit(first["line_no"]))
        rows = rows.withColumn("value", F.when(is_first, F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    settings = json.dumps({"model": model, "temperature": float(temperature), "max_tokens": int(max_tokens)})
    frame = spark.createDataFrame([(0, '{"results":['), (2, "]," + settings[1:])], "part int, value string")
    keys = {f.name: f.dataType for f in df.schema.fields}
    ends = frame.select("part", *[F.lit(None).cast(keys[k]).alias(k) for k in ("doc_id", "line_no")], "value")
    return rows.union(ends).orderBy("part", "doc_id", "line_no").select("value")


def render_report(df: DataFrame, input_col: str = "text", output_col: str = "corrected") -> DataFrame:
    """before/after block per line.  A line without output keeps its input
    and shows its status in brackets; the status column, if there is one, goes along."""
    status = ["status"] if "status" in df.columns else []
    missing = F.concat(F.lit("["), F.coalesce(F.col("status"), F.lit("no output")), F.lit("]")) if status else F.lit("[no output]")
    block = F.concat(F.lit("Input:  "), F.coalesce(F.col(input_col), F.lit("")), F.lit("\nOutput: "), F.coalesce(F.col(output_col), missing), F.lit("\n---"))
    return df.select("doc_id", "line_no", *status, block.alias("report"))


def render_single_report(df: DataFrame, model: str, input_col: str = "text", output_col: str = "corrected") -> DataFrame:
    """S8, single mode: the block of ``render_report`` closed by the model's name."""
    out = render_report(df, input_col, output_col)
    return out.withColumn("report", F.concat(F.regexp_replace("report", "\n---$", "\nModel:  "), F.lit(model)))


def render_batch_report(df: DataFrame, lines: DataFrame, model: str, input_col: str = "text", output_col: str = "corrected") -> DataFrame:
    """S8, batch mode: the blocks of ``df`` and, per document of ``lines`` (all
    lines of the input, blank ones too), a closing row that counts its lines;
    its ``line_no`` is that count, so it sorts last."""
    footers = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    closing = F.concat(F.lit("Processed "), F.col("n").cast("string"), F.lit(" lines with model: "), F.lit(model))
    blocks = render_report(df, input_col, output_col)
    kind = df.schema["line_no"].dataType
    return blocks.unionByName(footers.select("doc_id", F.col("n").cast(kind).alias("line_no"), closing.alias("report")), allowMissingColumns=True)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.col("json").alias("value")).write.mode(mode).text(path)
