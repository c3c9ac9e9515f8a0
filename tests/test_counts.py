"""Words, pairs and places in Arrow batches against the JVM's own cutting of words."""

from collections import Counter

from pyspark.sql import functions as F

from scrivener.operators import counts as C
from scrivener.operators.boundaries import neighbours
from scrivener.operators.lexicon import build_lexicon, words
from scrivener.operators.ngram import END, START, line_words, spaced_words, train_bigrams

TEXTS = [
    "The cat, the CAT.", None, "", " . ", "one", "ΑΣ'Α ΟΔΟΣ. ΣΑΣ", "étude Étude—İstanbul KKM", "a1b_c\tc d\x00e f", "日本語 テキスト𝒳𠀀", "the the the",
    "µ ª º ² ½ ⅷ Ⓐ", "ẞ ﬁ ŉ ǆ ა Ა",
]
LANGS = ["en", "de", None]


def _df(spark):
    rows = [(i, LANGS[i % 3], t) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "k long, lang string, text string").repartition(3)


def _lists(spark):
    return [(r.lang, r.ws or []) for r in _df(spark).select("lang", line_words(F.col("text")).alias("ws")).collect()]


def test_word_counts(spark):
    want = Counter((r.lang, r.word) for r in words(_df(spark)).collect())
    got = {(r.lang, r.word): r.freq for r in build_lexicon(_df(spark)).collect()}
    assert got == dict(want)
    assert {r.word: r.freq for r in build_lexicon(_df(spark), by=()).collect()} == dict(Counter(w for _, w in want.elements()))


def test_pairs(spark):
    lists = _lists(spark)
    want = Counter((g, u, w) for g, ws in lists if ws for u, w in zip([START, *ws], [*ws, END]))
    assert {(r.lang, r.u, r.w): r.c for r in train_bigrams(_df(spark)).pairs.collect()} == dict(want)
    near = Counter((g, u, w) for g, ws in lists for u, w in zip(ws, ws[1:]))
    assert {(r.lang, r.u, r.v): r.n for r in neighbours(_df(spark)).collect()} == dict(near)


def test_words_in_place(spark):
    rows = _df(spark).select("k", line_words(F.col("text")).alias("ws")).collect()
    for most in (None, 0, 2):
        want = sorted((r.k, i, w, ([START, *r.ws])[i], ([*r.ws, END])[i + 1]) for r in rows for i, w in enumerate(r.ws or []) if most is None or i < most)
        got = C.words_in_place(_df(spark), spaced_words(F.col("text")), ["k"], (START, END), most).collect()
        assert sorted(tuple(r) for r in got) == want


def test_gathered_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"t": ["a b", "b"]}).slice(i, 1) for i in (0, 1, 0)]
    monkeypatch.setattr(C, "HELD_BYTES", 1)
    assert [C._cut(t)[0].to_pylist() for t in C._gathered(iter(batches))] == [["a", "b"], ["b"], ["a", "b"]]
    monkeypatch.setattr(C, "HELD_BYTES", 1 << 20)
    (table,) = C._gathered(iter(batches))
    assert C._cut(table)[1].tolist() == [0, 0, 1, 2, 2]
