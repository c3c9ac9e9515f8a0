"""Corrections learned from a stream: versions, replays, restarts, corrected batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from scrivener.operators.lexicon import apply_corrections, build_lexicon, train_corrections
from scrivener.operators.lines import drop_blank
from scrivener.session import scratch_path
from scrivener.sources import fixtures as FX
from scrivener.streaming import learned as L

FILES = 7


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def arrivals(spark):
    lines = drop_blank(FX.typo_lines(spark, SMALL), "typo_text").select("doc_id", "line_no", "lang", "typo_text")
    path = scratch_path(spark, f"t-{uuid.uuid4().hex}")
    lines.repartition(FILES, "doc_id").write.option("maxRecordsPerFile", 0).parquet(path)
    return path


def stream(spark, arrivals):
    return spark.readStream.schema(spark.read.parquet(arrivals).schema).option("maxFilesPerTrigger", 1).parquet(arrivals)


def folders(spark):
    base = scratch_path(spark, f"t-{uuid.uuid4().hex}")
    return f"{base}/counts", f"{base}/ckpt", f"{base}/out"


def run(spark, arrivals, folder, ckpt, **kw):
    q = L.start_learned_stream(stream(spark, arrivals), folder, ckpt, "typo_text", **kw)
    q.awaitTermination()
    assert q.exception() is None


def test_last_version_equals_the_batch_job_also_after_a_restart(spark, arrivals, monkeypatch):
    folder, ckpt, _ = folders(spark)
    real, calls = L.add_batch, []

    def fails_after_its_files_are_written(batch, batch_id, *rest):
        real(batch, batch_id, *rest)
        calls.append(batch_id)
        if batch_id == 3 and calls.count(3) == 1:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(L, "add_batch", fails_after_its_files_are_written)
    q = L.start_learned_stream(stream(spark, arrivals), folder, ckpt, "typo_text", merge_every=2)
    with pytest.raises(Exception, match="executor lost"):
        q.awaitTermination()
    run(spark, arrivals, folder, ckpt, merge_every=2)
    assert calls.count(3) == 2 and calls[-1] == FILES - 1
    batch = spark.read.parquet(arrivals)
    assert same(L.word_counts(spark, folder), build_lexicon(batch, "typo_text"))
    assert same(L.learned_corrections(spark, folder), train_corrections(batch, "typo_text"))
    run(spark, arrivals, folder, ckpt, merge_every=2)  # nothing new: nothing changes
    assert L.last_version(spark, folder) == FILES - 1


def test_batches_are_corrected_by_what_was_learned_so_far(spark, arrivals):
    folder, ckpt, out = folders(spark)
    run(spark, arrivals, folder, ckpt, merge_every=3, sink=out)
    written = spark.read.parquet(out)
    last = written.where(F.col("batch_id") == FILES - 1).drop("batch_id")
    assert written.count() == spark.read.parquet(arrivals).count()
    picks = train_corrections(spark.read.parquet(arrivals), "typo_text")
    assert same(last.select("doc_id", "line_no", "corrected"), apply_corrections(last.drop("corrected"), picks, "typo_text"))
    assert last.where("corrected <> typo_text").count() > 0


@pytest.mark.parametrize("merge_every", [1, 2, 5])
def test_every_version_since_the_last_base_but_one(spark, merge_every):
    """Empty batches, null texts and null groups included; a replayed batch changes nothing."""
    folder = folders(spark)[0]
    rows = [[("en", "a b b")], [], [("en", None), (None, "c a")], [("de", "b")], [("en", "a a")]]
    frames = [spark.createDataFrame(r, "lang string, text string") for r in rows]
    for i, f in enumerate(frames):
        for _ in range(2):
            L.add_batch(f, i, folder, merge_every=merge_every)
        so_far = spark.createDataFrame(sum(rows[: i + 1], []), "lang string, text string")
        assert same(L.word_counts(spark, folder), build_lexicon(so_far))
    assert same(L.word_counts(spark, folder, 3), build_lexicon(spark.createDataFrame(sum(rows[:4], []), "lang string, text string")))
    with pytest.raises(ValueError, match="begun with"):
        L.add_batch(frames[0], 5, folder, merge_every=9)
