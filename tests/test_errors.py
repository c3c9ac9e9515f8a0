"""The learned error model against its definition."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scrivener.operators import errors as ER
from scrivener.operators import lexicon as LX

EDITS = [  # typed, meant, edits
    ("teh", "the", [("he", "eh")]), ("cat", "cart", [("ar", "a")]), ("at", "cat", [("^c", "^")]), ("caat", "cat", [("a", "aa")]), ("xcat", "cat", [("^", "^x")]),
    ("cot", "cat", [("a", "o")]), ("été", "éte", [("e", "é")]), ("bcda", "abcd", [("^a", "^"), ("d", "da")]), ("dabc", "abcd", [("^", "^d"), ("cd", "c")]),
    ("b", "a", [("a", "b")]), ("ab", "ba", [("ba", "ab")]), ("aa", "a", [("a", "aa")]), ("bc", "ab", [("^a", "^"), ("b", "bc")]), ("a", "ab", [("ab", "a")]),
]


def test_edits_of_pairs(spark):
    df = spark.createDataFrame([(w, c) for w, c, _ in EDITS], "word string, cand string")
    got = {(r.word, r.cand): [tuple(o) for o in r.ops] for r in ER.edit_ops(df).collect()}
    assert got == {(w, c): ops for w, c, ops in EDITS}


def brute_em(pairs, lexicon, rounds):
    seen = Counter()
    for w, f in lexicon.items():
        l = ["^", *w]
        for x in [*l, *(a + b for a, b in zip(l, l[1:]))]:
            seen[x] += f
    cost = defaultdict(lambda: ER.FIRST_COST)
    for _ in range(rounds):
        of = defaultdict(list)
        for w, n, c, f, ops in pairs:
            of[w].append((n, f * math.exp(-sum(cost[o] for o in ops) / 1000.0), ops))
        made = Counter()
        for found in of.values():
            total = sum(x for _, x, _ in found)
            for n, x, ops in found:
                for o in ops:
                    made[o] += n * x / total
        cost, counts = {}, {}
        for o in {o for *_, ops in pairs for o in ops}:
            counts[o] = math.floor(made[o] * 1000 + 0.5)
            k = counts[o] / 1000.0
            cost[o] = math.floor(-1000 * math.log((k + 0.5) / (max(seen[o[0]], k) + 1)) + 0.5)
    return cost, counts


@pytest.mark.parametrize("rounds", [1, 3])
def test_em_equals_brute_force_and_learns(spark, rounds):
    rng = random.Random(rounds)
    lexicon = {"".join(rng.choice("abeiost") for _ in range(rng.randrange(3, 7))): rng.randrange(1, 200) for _ in range(150)}
    typed = Counter()
    for w in lexicon:
        for _ in range(3):
            typed[w.replace("e", "i", 1) if rng.random() < 0.7 else w[:1] + w[2:]] += 1
    typed = {w: n for w, n in typed.items() if w not in lexicon and w}
    lex = spark.createDataFrame([("x", w, f) for w, f in lexicon.items()], "lang string, word string, freq long")
    seen = spark.createDataFrame([("x", w, n) for w, n in typed.items()], "lang string, word string, n long")
    pairs = ER.prepare_pairs(LX.candidates(seen.select("lang", "word"), lex), seen)
    plain = [(r.word, r.n, r.cand, r.freq, [tuple(o) for o in r.ops]) for r in pairs.collect()]
    conf = ER.learn_confusions(pairs, lex, rounds)
    cost, counts = brute_em(plain, lexicon, rounds)
    got = {(r.was, r.typed): (r.n, r.cost) for r in conf.collect()}
    assert got.keys() == cost.keys()
    # Sums in another order may round the other way: one thousandth.
    assert all(abs(got[o][0] - counts[o]) <= 1 and abs(got[o][1] - cost[o]) <= 1 for o in cost)
    assert got["e", "i"][1] < got["a", "o"][1] if ("a", "o") in got else got["e", "i"][0] > 0
    best = {r.word: r.cand for r in ER.best_learned(pairs, conf).collect()}
    assert best.keys() == {w for w, *_ in plain}


def test_learned_costs_beat_plain_distance(spark):
    import __spark_entry__ as E
    from conftest import SMALL

    r = E.queries()["error_model_accuracy"](spark, SMALL).agg(F.sum("n_typed"), F.sum("right_learned"), F.sum("right_distance")).first()
    assert r[1] > 1.2 * r[2] and r[1] <= r[0]


def test_no_pairs(spark):
    lex = spark.createDataFrame([("x", "abc", 3)], "lang string, word string, freq long")
    none = spark.createDataFrame([], "lang string, word string, n long")
    pairs = ER.prepare_pairs(LX.candidates(none.select("lang", "word"), lex), none)
    conf = ER.learn_confusions(pairs, lex)
    assert conf.count() == 0 and ER.best_learned(pairs, conf).count() == 0
    with pytest.raises(ValueError):
        ER.learn_confusions(pairs, lex, 0)


def test_learned_costs_feed_the_generator(spark):
    from scrivener.operators.ngram import generate_ngram

    clean = spark.createDataFrame([(i, 0, "x", "the cat met the rat") for i in range(30)], "doc_id long, line_no int, lang string, text string")
    typed = spark.createDataFrame([(1, 0, "x", "the cit met the rit")], "doc_id long, line_no int, lang string, text string")
    lex = LX.build_lexicon(clean)
    seen = LX.find_oov(typed, lex).withColumn("n", F.lit(1).cast("long"))
    pairs = ER.prepare_pairs(LX.candidates(seen, lex), seen)
    cands = ER.learned_costs(pairs, ER.learn_confusions(pairs, lex))
    assert [r.raw_output for r in generate_ngram(typed, reference=clean, cands=cands).collect()] == ["the cat met the rat"]
