"""One JSON document for a whole run (S7), written in parallel and committed
by manifest.

Tasks write their records to a staging folder, one file an attempt, and report
it; only when all are done does the commit step order the reported files, add
the header, the commas between files and the footer, and write the manifest
last.  What a failed or superseded attempt wrote is never listed and goes with
the staging folder, so a retried task gives the same bytes, and a failed job
leaves the folder as it was.  The driver handles file names and counts only.

The files of the folder, in order of name, are one JSON document
(``{"results":[{"input":…,"output":…},…],"model":…,"temperature":…,"max_tokens":…}``)
of any size.

Rows: one result per row of the input, in the input's order (nulls as JSON
null; repeated keys in any order among themselves); no rows give an empty list.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scrivener.operators.generate import _package_by_value
from scrivener.operators.joins import materialize
from scrivener.sources.tables import read_text_lines

FORMAT = "json_envelope_file"
MANIFEST = "_manifest.json"
OWN_FILES = re.compile(r"envelope-\d{8}-(head|part|sep|foot)$")


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder named as Spark names it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path).rstrip("/"))


def _put(fs: pafs.FileSystem, name: str, data: bytes) -> None:
    with fs.open_output_stream(name) as out:
        out.write(data)


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class EnvelopeWriter(DataSourceArrowWriter):
    """Writes the text column ``value``, a JSON record per row."""

    def __init__(self, path: str, head: str, foot: str, overwrite: bool):
        self.path, self.head, self.foot, self.overwrite = path, head, foot, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        return self.write_part(iterator, task.partitionId(), task.taskAttemptId())

    def write_part(self, batches: Iterator[pa.RecordBatch], number: int, attempt: int) -> Part:
        fs, root = _file_system(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        name, rows = f"{number}-{attempt}", 0
        with fs.open_output_stream(f"{root}/{self.staging}/{name}") as out:
            for batch in batches:
                for cell in batch.column(0):
                    out.write((b",\n" if rows else b"") + cell.as_buffer().to_pybytes())
                    rows += 1
        return Part(number, name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        ours = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name == MANIFEST or OWN_FILES.match(f.base_name)]
        if ours and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds an envelope already")
        # The manifest goes first: without it there is no envelope.
        for f in sorted(ours, key=lambda f: f.base_name != MANIFEST):
            fs.delete_file(f.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        _put(fs, f"{root}/envelope-{0:08d}-head", self.head.encode())
        for i, p in enumerate(parts, 1):
            fs.move(f"{root}/{self.staging}/{p.name}", f"{root}/envelope-{i:08d}-part")
            if i < len(parts):
                _put(fs, f"{root}/envelope-{i:08d}-sep", b",\n")
        _put(fs, f"{root}/envelope-{len(parts) + 1:08d}-foot", self.foot.encode())
        self._clear(fs, root)
        _put(fs, f"{root}/{MANIFEST}", json.dumps({"parts": [{"name": f"envelope-{i:08d}-part", "rows": p.rows} for i, p in enumerate(parts, 1)]}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class EnvelopeFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> EnvelopeWriter:
        return EnvelopeWriter(self.options["path"], self.options["head"], self.options["foot"], overwrite)


def write_envelope(df: DataFrame, path: str, model: str, temperature: float, max_tokens: int, input_col: str = "text",
                   output_col: str = "corrected", order=("doc_id", "line_no"), overwrite: bool = True) -> None:
    """Write ``df`` as one envelope under ``path``, in order of ``order`` (a range
    sort: no task holds more than its range)."""
    record = F.struct(F.col(input_col).alias("input"), F.col(output_col).alias("output"))
    value = F.to_json(record, {"ignoreNullFields": "false"}).alias("value")
    settings = json.dumps({"model": model, "temperature": float(temperature), "max_tokens": int(max_tokens)})
    with _package_by_value():
        df.sparkSession.dataSource.register(EnvelopeFile)
        # Stored once: the range sort reads its input twice, first for the ranges.
        records = materialize(df.select(*order, value))
        writer = records.orderBy(*order).select("value").write.format(FORMAT).mode("overwrite" if overwrite else "append")
        writer.option("path", path).option("head", '{"results":[\n').option("foot", "\n]," + settings[1:] + "\n").save()


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """(pos BIGINT, input, output) of a committed envelope; ``pos`` counts its
    results from 0.  Read in parallel: the manifest's counts, a row per part,
    become offsets."""
    fs, root = _file_system(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    offsets, before = [], 0
    for p in parts:
        offsets.append((p["name"], before))
        before += p["rows"]
    if not parts:
        return spark.createDataFrame([], "pos bigint, input string, output string")
    lines = read_text_lines(spark, f"{path}/envelope-*-part").withColumn("name", F.element_at(F.split("doc_id", "/"), -1))
    record = F.from_json(F.regexp_replace("text", ",$", ""), "input string, output string")
    known = F.broadcast(spark.createDataFrame(offsets, "name string, _before bigint"))  # a row per part
    return lines.join(known, "name").select((F.col("_before") + F.col("line_no")).alias("pos"), record.alias("r")).select("pos", "r.input", "r.output")
