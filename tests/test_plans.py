"""Plan shape: pruning and pushdown reach the scan, no cartesian products,
broadcasts only where intended."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from scrivener.plans.catalog import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


STREAMS = {"stream_equals_batch", "stream_trained_corrections"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    if name in STREAMS:
        pytest.skip("runs a stream while planning")
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["validate_requests"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan


def test_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F

    from scrivener.sources.tables import read_table

    df = read_table(spark, SMALL, "pages", spread=False).where(F.col("page_id") > 10).select("url")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,10)]" in plan


def test_dictionary_join_broadcasts_small_rules(spark):
    from scrivener.operators.dictionary import apply_dictionary_join
    from scrivener.sources import fixtures as FX

    plan = _plan(E.queries()["dictionary_join"](spark, SMALL))
    assert "ArrowEvalPython" in plan and "Join" not in plan
    # The join form, for rules past the lookup's bytes.
    rules = spark.createDataFrame([("teh", "the")], "typo string, fixed string")
    assert "BroadcastHashJoin" in _plan(apply_dictionary_join(FX.typo_lines(spark, SMALL), rules, "typo_text", max_broadcast_rows=10))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "line_no", "text", "corrected", "changed"]
    assert df.count() > 0


def test_filter_on_key_reaches_scan_through_fences(spark):
    from pyspark.sql import functions as F

    df = E.queries()["correct_corpus"](spark, SMALL).where(F.col("doc_id") == 5)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    assert df.count() == E.queries()["correct_corpus"](spark, SMALL).where("doc_id = 5").count()


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


# The automaton and the row-local lookups run in Arrow-batched Python.
AUTOMATON = {"dictionary_phrases", "rule_hits_table", "dictionary_join", "apply_corrections", "encode", "decode", "pad_truncate",
             "correct_corpus_trained", "win_interval"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - AUTOMATON - STREAMS))
def test_only_the_automaton_runs_python(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert not any(node in plan for node in PYTHON_NODES), name


def test_model_step_is_arrow_batched(spark):
    from scrivener.operators.generate import generate

    df = spark.createDataFrame([(1, "Input: a\nOutput:", "other")], "id long, prompt string, wide string")
    plan = _plan(generate(df, "prompt", dict))
    assert "MapInPandas" in plan and "BatchEvalPython" not in plan
    python = plan[plan.index("MapInPandas"):].splitlines()[0]
    assert "prompt" in python and "wide" not in python


def test_phrases_cross_only_the_text_and_shuffle_nothing(spark):
    from scrivener.operators.phrases import apply_phrases

    df = spark.createDataFrame([(1, "alot of", "x")], "id long, text string, wide string")
    rules = spark.createDataFrame([("alot of", "a lot of")], "typo string, fixed string")
    plan = _plan(apply_phrases(df, rules))
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan and "Exchange" not in plan
