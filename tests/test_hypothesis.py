"""Randomised checks of the string expressions against plain Python
statements of the same rules (one Spark job per batch of strings)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrivener.functions.text import WHITE_SPACE, collapse_ws, utrim
from scrivener.operators.lines import split_lines

ALPHABET = [" ", "\t", "\n", "\r", " ", "　", " ", "\u0085", "​", "\x1c", "a", "b", "é", "."]
SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", expr(F.col("s")).alias("o")).orderBy("i").collect()]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=20, max_size=40))
def test_utrim_is_strip_of_white_space(spark, values):
    assert _column(spark, values, utrim) == [v.strip(WHITE_SPACE) for v in values]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=20, max_size=40))
def test_collapse_ws(spark, values):
    ws = "[" + re.escape(WHITE_SPACE) + "]+"
    assert _column(spark, values, collapse_ws) == [re.sub(ws, " ", v.strip(WHITE_SPACE)) for v in values]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=["a", "\r", "\n", " "], max_size=10), min_size=20, max_size=40))
def test_split_lines(spark, values):
    def model(s):
        parts = re.split(r"\r?\n", s)
        return parts[:-1] if parts[-1] == "" else parts

    assert _column(spark, values, split_lines) == [model(v) for v in values]


WORDS = ["teh", "TEH", "Teh", "cant", "itmes", "quik", "tehran", "écant", "teh_x", "a", "sentance", "Typoes",
         "\u017feperate", "qui\u212a", "\u0130tmes", "\u0131tmes"]
SEPS = [" ", "-", ", ", "'", "\n", "é"]


@settings(**SETTINGS)
@given(st.lists(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SEPS)), max_size=8), min_size=20, max_size=30))
def test_rule_forms_agree(spark, rows):
    from scrivener.functions.sanitize import apply_rules_staged, rules_regex_chain, rules_token_map
    from scrivener.operators.dictionary import apply_dictionary_join
    from scrivener.sources.fixed import rules_df

    texts = ["".join(w + s for w, s in r) for r in rows]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, line_no int, text string")
    chain = {r["doc_id"]: r["c"] for r in df.select("doc_id", rules_regex_chain(F.col("text")).alias("c")).collect()}
    tmap = {r["doc_id"]: r["c"] for r in df.select("doc_id", rules_token_map(F.col("text")).alias("c")).collect()}
    staged = {r["doc_id"]: r["c"] for r in apply_rules_staged(df, "text", "c").collect()}
    joined = {r["doc_id"]: r["corrected"] for r in apply_dictionary_join(df, rules_df(spark)).collect()}
    assert chain == tmap == staged == joined


PIECES = ["Input:", "Output:", "\n", " ", "<|endoftext|>", "teh", "cant", '"', "'", "(Note:", "(", ")", "abc",
          "éé", "Fix typos", "I believe this is the answer.", " ", "\r", "x.", "quik"]


@settings(**SETTINGS)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), min_size=30, max_size=40))
def test_extraction_and_sanitising_agree_with_oracle_sql(spark, raws):
    import duckdb
    import pandas as pd

    from scrivener.functions.extract import extract_answers
    from scrivener.functions.sanitize import sanitize_steps
    from scrivener.plans import oracle_parts as O

    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    out = sanitize_steps(extract_answers(df, "raw", "extracted"), "extracted", "corrected")
    got = {r["id"]: (r["extracted"], r["status"], r["corrected"]) for r in out.collect()}

    con = duckdb.connect()
    con.register("raws_df", pd.DataFrame({"id": range(len(raws)), "raw": raws}))
    ex, ex_t = O.extract_ctes("raws_df", "raw", "extracted")
    sz, sz_t = O.sanitize_ctes(ex_t, "extracted", "corrected")
    rows = con.execute(f"WITH {ex.strip()}, {sz.strip()} SELECT id, extracted, status, corrected FROM {sz_t}").fetchall()
    want = {i: (e, s, c) for i, e, s, c in rows}
    assert got == want
