"""Golden rows for answer extraction and sanitising (FIXTURES.md F4)."""

import json
import os

from pyspark.sql import functions as F

from scrivener.functions.extract import extract_answers
from scrivener.functions.sanitize import sanitize_steps

GOLDEN = json.load(open(os.path.join(os.path.dirname(__file__), "golden_extract_sanitize.json")))


def _run(spark, form):
    df = spark.createDataFrame([(g["id"], g["raw"]) for g in GOLDEN], "id int, raw string")
    df = extract_answers(df, "raw", "extracted")
    df = sanitize_steps(df, "extracted", "corrected", form=form)
    return {r["id"]: r for r in df.collect()}


def test_extract_and_sanitize_regex_form(spark):
    got = _run(spark, "regex")
    for g in GOLDEN:
        r = got[g["id"]]
        assert r["extracted"] == g["extracted"], (g["id"], r["extracted"], g["extracted"])
        assert r["corrected"] == g["corrected"], (g["id"], r["corrected"], g["corrected"])
        assert r["status"] == ("empty_output" if g["extracted"] is None else "ok")


def test_extract_and_sanitize_map_form(spark):
    got = _run(spark, "map")
    for g in GOLDEN:
        assert got[g["id"]]["corrected"] == g["corrected"], g["id"]


def test_dictionary_join_form_matches_regex(spark):
    from scrivener.operators.dictionary import apply_dictionary_join
    from scrivener.sources.fixed import rules_df

    rows = [(g["id"], 0, g["extracted"]) for g in GOLDEN]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string")
    joined = {r["doc_id"]: r["corrected"] for r in apply_dictionary_join(df, rules_df(spark)).collect()}
    from scrivener.functions.sanitize import rules_regex_chain

    chained = {r["doc_id"]: r["c"] for r in df.select("doc_id", rules_regex_chain(F.col("text")).alias("c")).collect()}
    assert joined == chained


def test_null_input_status(spark):
    df = spark.createDataFrame([(1, None)], "id int, raw string")
    r = extract_answers(df, "raw", "extracted").first()
    assert r["extracted"] is None and r["status"] == "null_input"


def test_regex_forms_fold_case_like_the_regex(spark):
    from scrivener.functions.sanitize import apply_rules_staged, rules_regex_chain

    texts = ["ſeperate ſentance", "Keep TEH quik", "İtmes"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    chain = [r["c"] for r in df.select("i", rules_regex_chain(F.col("text")).alias("c")).orderBy("i").collect()]
    staged = [r["c"] for r in apply_rules_staged(df, "text", "c").orderBy("i").collect()]
    assert chain == staged
    assert chain[0] == "separate sentence" and chain[1].endswith("the quick")


def test_non_ascii_rules_use_the_regex_match(spark):
    from scrivener.functions.sanitize import apply_rules_staged, rules_regex_chain

    rules = [("résumé", "resume"), ("teh", "the")]
    texts = ["RÉSUMÉ teh", "résumés", "ſome teh"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    chain = [r["c"] for r in df.select("i", rules_regex_chain(F.col("text"), rules).alias("c")).orderBy("i").collect()]
    staged = [r["c"] for r in apply_rules_staged(df, "text", "c", rules).orderBy("i").collect()]
    assert chain == staged == ["resume the", "résumés", "ſome the"]


def test_join_form_without_broadcast_keeps_only_present_rules(spark):
    from scrivener.operators.dictionary import apply_dictionary_join
    from scrivener.sources.fixed import rules_df

    rows = [(g["id"], 0, g["extracted"]) for g in GOLDEN]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string")
    small = {r["doc_id"]: r["corrected"] for r in apply_dictionary_join(df, rules_df(spark)).collect()}
    forced = {r["doc_id"]: r["corrected"]
              for r in apply_dictionary_join(df, rules_df(spark), max_broadcast_rows=2).collect()}
    assert small == forced
