"""The committing envelope sink: one JSON document, whatever tasks fail."""

import json
import os
import subprocess
import sys
import textwrap

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivener.sinks.envelope_file import EnvelopeWriter, read_envelope, write_envelope

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def document(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("envelope-"))
    return b"".join(open(f"{path}/{n}", "rb").read() for n in names)


def rows(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("doc_id"), "id", F.format_string("l\u00efne \"%d\"\n,", "id").alias("text"))
    return df.select("doc_id", F.col("id").alias("line_no"), "text", F.when(F.col("id") % 5 > 0, F.upper("text")).alias("corrected"))


@pytest.mark.parametrize("n", [0, 1, 50])
def test_the_folder_is_one_document(spark, tmp_path, n):
    path = str(tmp_path / "out")
    df = rows(spark, n)
    write_envelope(df, f"file:{path}", "m", 0.5, 25)
    env = json.loads(document(path))
    expect = [{"input": r["text"], "output": r["corrected"]} for r in df.orderBy("doc_id", "line_no").collect()]
    assert env == {"results": expect, "model": "m", "temperature": 0.5, "max_tokens": 25}
    back = [(r["pos"], r["input"], r["output"]) for r in read_envelope(spark, path).orderBy("pos").collect()]
    assert back == [(i, e["input"], e["output"]) for i, e in enumerate(expect)]
    assert not any(f.startswith("_staging") for f in os.listdir(path))


def test_repeated_keys_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "mine.txt").write_text("kept")
    same = spark.createDataFrame([(None, 0, "a", "b")] * 4, "doc_id long, line_no int, text string, corrected string")
    write_envelope(same.repartition(4), path, "m", 0.0, 1)
    assert len(json.loads(document(path))["results"]) == 4
    with pytest.raises(Exception, match="already"):
        write_envelope(same, path, "m", 0.0, 1, overwrite=False)
    write_envelope(same.limit(1), path, "m", 0.0, 1)
    assert len(json.loads(document(path))["results"]) == 1 and (tmp_path / "out" / "mine.txt").read_text() == "kept"


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    write_envelope(rows(spark, 9), path, "m", 0.0, 1)
    before = document(path)
    bad = rows(spark, 40).withColumn("corrected", F.when(F.col("line_no") == 33, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception):
        write_envelope(bad, path, "m", 0.0, 1)
    assert document(path) == before and not any(f.startswith("_staging") for f in os.listdir(path))


def test_attempts_that_are_not_reported_are_not_in_the_document(tmp_path):
    path = str(tmp_path / "out")
    w = EnvelopeWriter(path, "[", "]", True)
    batches = lambda *v: iter([pa.RecordBatch.from_arrays([pa.array(list(v))], ["value"])])

    def fails():
        yield from batches("1")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write_part(fails(), 1, 7)
    second, first = w.write_part(batches("2", "3"), 1, 8), w.write_part(batches("1"), 0, 9)
    w.commit([second, None, first, w.write_part(batches(), 2, 10)])
    assert json.loads(document(path)) == [1, 2, 3]


def test_a_retried_task_gives_the_same_bytes(tmp_path):
    """Real task retries, in a session that allows them."""
    code = textwrap.dedent("""
        import os, sys
        from pyspark.sql import SparkSession, functions as F
        from scrivener.sinks.envelope_file import write_envelope
        base = sys.argv[1]
        spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
                 .config("spark.checkpoint.dir", base + "/ckpt").getOrCreate())
        rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.col("id").cast("string").alias("text"))

        def fails_once(mark):
            def run(x):
                if x % 1000 == 999 and mark and not os.path.exists(f"{mark}-{x}"):
                    open(f"{mark}-{x}", "w").close()
                    raise RuntimeError("lost")
                return str(x)
            return F.udf(run)

        plan = lambda mark: rows.orderBy("doc_id").withColumn("corrected", fails_once(mark)("doc_id"))
        write_envelope(plan(None), base + "/calm", "m", 0.0, 1)
        write_envelope(plan(base + "/mark"), base + "/stormy", "m", 0.0, 1)
    """)
    run = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env={**os.environ, "PYTHONPATH": REPO}, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len([f for f in os.listdir(tmp_path) if f.startswith("mark-")]) == 4
    assert document(tmp_path / "calm") == document(tmp_path / "stormy") and len(json.loads(document(tmp_path / "calm"))["results"]) == 4000
