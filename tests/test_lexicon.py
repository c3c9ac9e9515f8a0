"""Corpus corrections from a reference table."""

import pytest


@pytest.mark.parametrize("times", [1, 3])
def test_corpus_corrections_do_not_depend_on_table_size(spark, times):
    """Short words and misspellings that the reference holds are corrected too."""
    from scrivener.operators import lexicon as LX

    text = " ".join(["the"] * 400 + ["of"] * 400 + ["receive"] * 19 + ["teh"] * (20 // times))
    reference = spark.createDataFrame([("en", text)] * times, "lang string, text string")
    df = spark.createDataFrame([(1, 1, "en", "Teh fo recieve"), (1, 2, "en", None)], "doc_id long, line_no int, lang string, text string")
    # 'teh' is two edits from 'the', so it needs the ratio squared.
    out = LX.correct_with_corpus(df, reference, ratio=4.0)
    assert [r.corrected for r in out.orderBy("line_no").collect()] == ["the of receive", None]
    lex = LX.build_lexicon(reference)
    assert lex.where("word = 'receive'").count() == 1
    assert {r.word for r in LX.find_oov(df, lex).collect()} == {"fo", "recieve"}
