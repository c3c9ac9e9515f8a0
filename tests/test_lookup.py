"""Row-local lookups equal the join forms and shuffle nothing."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from scrivener.operators import lexicon as LX
from scrivener.operators import tokens as TK
from scrivener.operators.dictionary import apply_dictionary_join, apply_dictionary_lookup, normalise_rules
from scrivener.operators.joins import materialize
from scrivener.operators.lookup import look_up, rewrite, small_table
from scrivener.sources import fixtures as FX

ROWS = [(1, "en", "Teh cat, teh DOG"), (2, None, "teh"), (3, "de", "teh cat"), (4, "en", None), (5, "en", ""), (5, "en", "  \n"), (5, "en", "  teh"), (None, "en", "ok null")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, lang string, text string")


@pytest.mark.parametrize("by,fixed", [(("lang",), "the"), ((), "the")])
def test_rewritten_row_by_row(spark, frame, by, fixed):
    rules = spark.createDataFrame([("en", "TEH", "the"), ("en", "dog", None), (None, "cat", "x"), ("en", None, "y")], "lang string, typo string, fixed string")
    if not by:
        rules = rules.drop("lang")
    got = [r.corrected for r in apply_dictionary_lookup(frame, normalise_rules(rules, by=by), "text", "corrected", by).collect()]
    grouped = ["the cat, the DOG", "teh", "teh cat", None, "", "  \n", "  the", "ok null"]
    plain = ["the x, the DOG", "the", "the x", None, "", "  \n", "  the", "ok null"]
    assert got == (grouped if by else plain)


def test_no_rules_and_no_rows(spark, frame):
    none = spark.createDataFrame([], "typo string, fixed string")
    assert [r.corrected for r in apply_dictionary_lookup(frame, normalise_rules(none), "text", "corrected").collect()] == [t for _, _, t in ROWS]
    one = pa.table({"key": ["a"], "value": ["b"]})
    assert frame.limit(0).select(rewrite(frame, one, F.split("text", ""), F.lit(""))).collect() == []


def test_elements_looked_up(spark):
    df = spark.createDataFrame([([3, None, 9, 3],), ([],), (None,)], "ids array<int>")
    table = small_table(spark.createDataFrame([(3, "c"), (None, "n"), (4, None)], "id int, word string"), "id", "word")
    assert [r[0] for r in df.select(look_up(df, table, F.col("ids"))).collect()] == [["c", None, None, "c"], [], None]


def test_the_bound_counts_bytes(spark):
    table = spark.createDataFrame([("a" * 50, 1)], "word string, id int")
    assert small_table(table, "word", "id", 66) is None and small_table(table, "word", "id", 67).num_rows == 1


def test_corrections_and_ids_equal_the_joins_without_an_exchange(spark):
    lines = materialize(FX.typo_lines(spark, SMALL))
    picks = LX.train_corrections(lines, "typo_text").select("lang", "word", "cand")
    args = dict(by=("lang",), typo="word", fixed="cand", unique_keys=True, words_only=True)
    local = apply_dictionary_join(lines, picks, "typo_text", **args)
    joined = apply_dictionary_join(lines, picks, "typo_text", max_broadcast_rows=1_000_000, **args)
    assert local.exceptAll(joined).count() == 0 and joined.exceptAll(local).count() == 0
    vocab = TK.build_vocab(lines, "text", 3)
    encoded = TK.encode(lines, vocab)
    for df in (local, encoded, TK.decode(materialize(encoded), vocab)):
        assert "ArrowEvalPython" in plan(df) and "Exchange" not in plan(df) and "Join" not in plan(df)


def test_texts_without_words_encode_to_nothing(spark, frame):
    vocab = spark.createDataFrame([("teh", 1), ("cat", 2)], "word string, id int")
    ids = [r.ids for r in TK.encode(frame, vocab, key_cols=("id",)).collect()]
    assert ids == [[1, 2, 1, 0], [1], [1, 2], [], [], [], [1], [0, 0]]


def test_a_large_table_is_looked_up_at_its_head_and_joined_for_the_rest(spark, frame):
    """Neither all tokens are shuffled nor repeated or null keys lost."""
    lines = materialize(FX.typo_lines(spark, SMALL))
    vocab = materialize(TK.build_vocab(lines, "text"))
    rows = materialize(lines.unionByName(lines.limit(30)).unionByName(lines.limit(5).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("zzz unseen Word"))))
    small, large = TK.encode(rows, vocab), TK.encode(rows, vocab, max_bytes=20_000)
    assert large.schema["ids"].dataType == small.schema["ids"].dataType
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    ids = materialize(small)
    one, two = TK.decode(ids, vocab), TK.decode(ids, vocab, max_bytes=20_000)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    text = plan(large)
    assert "Generate explode(__lack" in text and "posexplode" not in text


@pytest.mark.parametrize("max_bytes", [0, 3_000, 60_000])
@pytest.mark.parametrize("words_only", [False, True])
def test_frequent_words_are_rewritten_in_place_and_rare_ones_by_a_join(spark, frame, max_bytes, words_only):
    lines = FX.typo_lines(spark, SMALL).select("lang", F.col("typo_text").alias("text")).unionByName(frame.select("lang", "text"))
    lines = materialize(lines.withColumn("__row", F.monotonically_increasing_id()))
    picks = LX.train_corrections(lines).select("lang", "word", "cand").unionByName(spark.createDataFrame([("en", "dog", None), (None, "cat", "x")], "lang string, word string, cand string"))
    picks = materialize(picks)
    args = dict(key_cols=("__row",), by=("lang",), typo="word", fixed="cand", unique_keys=True, words_only=words_only)
    whole, cut = apply_dictionary_join(lines, picks, **args), apply_dictionary_join(lines, picks, max_bytes=max_bytes, **args)
    assert cut.count() == lines.count()
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0
