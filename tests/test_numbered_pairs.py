"""Islands and pairs are gathered by number; words are left out and put in place in the worker."""

import pyarrow as pa
from pyspark.sql import functions as F

from scrivener.operators import counts as C
from scrivener.operators import ngram as NG


def test_words_are_put_in_place(spark):
    texts = ["a b c", "Ünï – “b” c, d", "", None, "\U0001d518x-é 1 y", "no change"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    changes = spark.createDataFrame([(0, 0, "x"), (0, 2, "zz"), (1, 1, "B"), (1, 3, ""), (4, 1, "é"), (4, 2, "z")], "n int, pos int, word string")
    got = {r.n: r.out for r in NG.rewrite_words(df, changes, "text", ("n",), "out").collect()}
    assert got == {0: "x b zz", 1: "Ünï – “B” c, ", 2: "", 3: None, 4: "\U0001d518x-é 1 z", 5: "no change"}
    words = {r.n: r.w for r in df.select("n", F.regexp_extract_all("text", F.lit(NG.WORD_PATTERN), F.lit(0)).alias("w")).collect()}
    for n, t in enumerate(texts):
        signs = df.where(F.col("n") == n).select(C.spaced(F.col("text"))).first()[0]
        assert t is None or [t[m.start():m.end()] for m in NG._LETTERS.finditer(signs)] == words[n]


def test_no_word_of_the_set_is_left_out(spark):
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{'x' * (i // 26)}" for i in range(5000)]
    bits = C.word_bits(spark.createDataFrame([(w,) for w in words], "word string"), "word")
    assert C._among(bits, pa.array(words)).all()
    others = C._among(bits, pa.array([w + "q" for w in words]))
    assert others.mean() < 0.1
    df = spark.createDataFrame([(1, "wa other words wa"), (2, ""), (3, "none")], "k long, text string")
    few = C.word_bits(spark.createDataFrame([("wa",)], "word string"), "word")
    got = sorted(map(tuple, C.words_in_place(df, F.col("text"), ["k"], ("<s>", "</s>"), None, few).collect()))
    assert got == [(1, 0, "wa", "<s>", "other"), (1, 3, "wa", "words", "</s>")]
    assert [r.pos for r in C.words_in_place(df, F.col("text"), ["k"], ("<s>", "</s>"), 2, few).collect()] == [0]


def test_costs_of_a_pair_are_those_of_bigram_costs(spark):
    lines = spark.createDataFrame([("en", "the cat sat"), ("en", "the cat ran"), ("en", "a cat sat"), (None, "the cat")], "lang string, text string")
    model = NG.train_bigrams(lines)
    options = NG.lattice_options(spark.createDataFrame([("en", "teh", "the", 2), ("en", "kat", "cat", 1), ("en", "kat", "new", 1)], "lang string, word string, cand string, dist int"))
    pairs = spark.createDataFrame([(7, "en", "<s>", False, "teh", True), (8, "en", "teh", True, "kat", True), (9, "en", "kat", True, "never", False), (10, "en", "teh", False, "cat", True)],
                                  "pid long, lang string, u string, free_u boolean, v string, free_v boolean")
    got = {r.pid: [(s.i, s.cand, s.emit, s.costs) for s in r.step] for r in NG._pair_matrices(pairs, options, model).collect()}
    of = {"teh": ["teh", "the"], "kat": ["kat", "cat", "new"]}
    emit = {("teh", "the"): 2 * NG.EDIT_COST, ("kat", "cat"): NG.EDIT_COST, ("kat", "new"): NG.EDIT_COST}
    for r in pairs.collect():
        us, vs = of[r.u] if r.free_u and r.u in of else [r.u], of[r.v] if r.free_v and r.v in of else [r.v]
        need = spark.createDataFrame([("en", u, w) for u in us for w in vs], "lang string, u string, w string")
        cost = {(c.u, c.w): c.cost for c in NG.bigram_costs(model, need).collect()}
        assert got[r.pid] == [(i, w, emit.get((r.v, w), 0), [cost[u, w] for u in us]) for i, w in enumerate(vs)]
