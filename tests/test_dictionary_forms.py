"""Both forms of the dictionary operator give the same text."""

import pytest

from scrivener.operators.dictionary import apply_dictionary

RULES = [("..", "."), (" ", "_"), ("teh", "the"), ("Teh", "them"), (None, "never"), ("gone", None)]
TEXTS = ["teh end..now", "..teh  gone", " teh", "", None, "a..b..c...d"]
WANT = ["the_end.now", ".the  gone", "_the", "", None, "a.b.c...d"]


@pytest.mark.parametrize("bound", [1_000, len(RULES), len(RULES) - 1])
def test_forms_agree_on_rules_of_any_kind(spark, bound):
    rules = spark.createDataFrame(RULES, "typo string, fixed string")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    got = apply_dictionary(df, rules, "text", max_map_rules=bound).orderBy("n").collect()
    assert [r.corrected for r in got] == WANT


@pytest.mark.parametrize("bound", [1_000, 0])
def test_no_rules_change_nothing(spark, bound):
    rules = spark.createDataFrame([(None, "x")], "typo string, fixed string")
    df = spark.createDataFrame([(1, "definately")], "n int, text string")
    assert [r.corrected for r in apply_dictionary(df, rules, "text", max_map_rules=bound).collect()] == ["definately"]
