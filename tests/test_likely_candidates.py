"""Candidates met on hashes of their variants, pruned by frequency where they meet; replicas drawn in a worker."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from scrivener.operators import bootstrap as BS
from scrivener.operators import lexicon as LX
from scrivener.operators.dictionary import apply_dictionary_join
from scrivener.plans.correct import corpus_outputs


def test_variants_have_one_hash_each():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé\U0001d518") for _ in range(rng.randint(1, 30))) for _ in range(500)] + ["", "a", "zzzz", "x" * 3000]
    known = {}
    for w, got in zip(words, LX._variant_hashes(pa.array(words)).to_pylist()):
        variants = [w] + [w[:i] + w[i + 1:] for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
        assert len(got) == len(set(variants))
        for v, h in zip(variants, got):
            assert known.setdefault(h, v) == v
    assert len(known) == len(set(known.values()))
    assert LX._variant_hashes(pa.array([], pa.string())).to_pylist() == []


def test_likely_candidates_are_those_of_more_frequent(spark):
    rng = random.Random(4)
    rows = {("en", "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))): rng.choice([1, 2, 19, 20, 400, 401, 8000]) for _ in range(60)}
    rows |= {(None, "ab"): 1, (None, "abb"): 500}
    counts = spark.createDataFrame([(g, w, n) for (g, w), n in rows.items()], "lang string, word string, freq long")
    for ratio in (20.0, 0.5):
        seen = counts.where(F.col("freq") >= ratio)
        plain = LX.more_frequent(LX.candidates(counts.select("lang", "word"), seen), counts.select("lang", "word", F.col("freq").alias("own")), ratio)
        likely = LX.candidates(counts.select("lang", "word", F.col("freq").alias("own")), seen, ratio=ratio)
        assert likely.columns == plain.columns == ["lang", "word", "cand", "freq", "dist"]
        got = sorted(map(tuple, likely.collect()))
        assert got == sorted(map(tuple, plain.collect())) and got


def test_replicas_are_drawn_as_the_weights_say(spark):
    keys = ["a|1", "é", "", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1)
    weights = [r.w for r in df.select(BS.poisson_weights(F.col("k"), 20).alias("w")).collect()]
    assert BS._drawn(keys, 20).tolist() == [[1, *w] for w in weights]
    rows = spark.createDataFrame([("x", 1, "a"), ("x", 0, "b"), (None, 1, "c"), (None, None, "d"), ("x", 1, None)], "g string, v int, k string")
    plan = BS.mean_interval(rows, F.col("v"), F.col("k"), by=("g",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row is multiplied
    got = {r.g: (r.n, r["mean"]) for r in BS.mean_interval(rows, F.col("v"), F.col("k"), by=("g",)).collect()}
    assert got == {"x": (3, 0.666667), None: (1, 1.0)}


def test_corrected_lines_are_not_joined_back(spark):
    df = spark.createDataFrame([(1, "en", "the cat"), (1, "en", "the cat"), (None, "en", "thee"), (2, None, "thee"), (3, "en", None)] + [(9, "en", "the " * 30)],
                               "doc_id long, lang string, text string").withColumn("other", F.col("text"))
    out = corpus_outputs(df, "text", F.col("text"))
    assert out.columns == ["doc_id", "lang", "text", "other", "raw_output"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, out.select("doc_id", "raw_output").collect())) == sorted(map(str, df.select("doc_id", F.when((F.col("text") == "thee") & F.col("lang").isNotNull(), "the").otherwise(F.col("text")).alias("raw_output")).collect()))
    rules = spark.createDataFrame([("en", "thee", "the")], "lang string, typo string, fixed string")
    numbered = df.withColumn("n", F.monotonically_increasing_id()).localCheckpoint()
    forms = [sorted(map(str, apply_dictionary_join(numbered, rules, "text", "out", ("n",), by=("lang",), words_only=True, keep=["doc_id", "other", "text"], **how).collect()))
             for how in ({}, {"max_bytes": 0}, {"max_broadcast_rows": 10})]
    assert forms[0] == forms[1] == forms[2] and len(forms[0]) == 6
