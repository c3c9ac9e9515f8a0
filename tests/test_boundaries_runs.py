"""Moved word limits, run fingerprints, bootstrap bounds and learned templates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import bootstrap as BS
from scrivener.operators import boundaries as BD
from scrivener.operators import rundiff as RD
from scrivener.operators import templates as TP
from scrivener.operators.lexicon import build_lexicon

LINES = "doc_id long, line_no int, lang string, text string"


def test_moved_limits_equal_brute_force(spark):
    clean = ["in the house", "a lot of also", "the house in a lot", "été là in", "al go of"]
    typed = ["inthe house", "al ot ofa lso", "th e house", "étélà", "i nthe", "x", "", None, " ., ", "in the house"]
    c = spark.createDataFrame([(i, 0, "x", t) for i, t in enumerate(clean)], LINES)
    t = spark.createDataFrame([(i, 0, "x" if i != 5 else None, t) for i, t in enumerate(typed)], LINES)
    got = {tuple(r)[1:] for r in BD.split_merge_candidates(t, build_lexicon(c), reference=c, ref_col="text").collect()}
    words = lambda s: ["".join(ch for ch in w if ch.isalpha()) for w in (s or "").split() if any(ch.isalpha() for ch in w)]
    freq, seen = {}, {}
    for s in clean:
        ws = words(s)
        for w in ws:
            freq[w] = freq.get(w, 0) + 1
        for p in zip(ws, ws[1:]):
            seen[p] = seen.get(p, 0) + 1
    want = set()
    cuts = lambda s: [(i, s[:i], s[i:]) for i in range(1, len(s)) if s[:i] in freq and s[i:] in freq]
    for k, s in enumerate(typed):
        ws = words(s) if k != 5 else []
        want |= {(w, "split", f"{a} {b}", min(freq[a], freq[b]), seen.get((a, b), 0)) for w in ws if w not in freq for _, a, b in cuts(w)}
        for u, v in zip(ws, ws[1:]):
            if u not in freq or v not in freq:
                want |= {(f"{u} {v}", "shift", f"{a} {b}", min(freq[a], freq[b]), seen.get((a, b), 0)) for i, a, b in cuts(u + v) if i != len(u)}
                if u + v in freq:
                    want.add((f"{u} {v}", "merge", u + v, freq[u + v], 0))
    assert got == want and {k for _, k, *_ in got} == {"split", "merge", "shift"}
    best = {r.typed: (r.kind, r.cand) for r in BD.best_boundary(BD.split_merge_candidates(t, build_lexicon(c), reference=c)).collect()}
    assert best["inthe"] == ("split", "in the") and best["al ot"] == ("shift", "a lot") and best["th e"] == ("merge", "the") and best["i nthe"] == ("shift", "in the")
    assert BD.split_merge_candidates(t, build_lexicon(c)).where("seen > 0").count() == 0
    assert BD.split_merge_candidates(t.limit(0), build_lexicon(c)).count() == 0


def test_runs_that_differ(spark):
    rows = [(i, i % 3, f"t{i}", [i, None]) for i in range(500)] + [(7, 1, "t7", [7, None])] * 2 + [(None, None, None, None)]
    schema = "doc_id long, line_no int, corrected string, extra array<int>"
    a = RD.store_run(spark.createDataFrame(rows, schema), ranges=16)
    again = RD.store_run(spark.createDataFrame(rows[::-1], schema).repartition(3), ranges=16)
    assert RD.differing_ranges(a, again).count() == 0 and RD.run_diff(a, again).count() == 0
    other = [r for r in rows if r[0] != 5] + [(9, 0, None, [9]), (None, None, None, [None]), (7, 1, "t7", [7, None])]
    b = RD.store_run(spark.createDataFrame(other, schema), ranges=16)
    assert 0 < RD.differing_ranges(a, b).count() < 16
    got = sorted(((r.doc_id, r.line_no, r.corrected, r.extra), r.n_a, r.n_b) for r in RD.run_diff(a, b).where("doc_id is not null").collect())
    assert got == [((5, 2, "t5", [5, None]), 1, 0), ((7, 1, "t7", [7, None]), 3, 4), ((9, 0, None, [9]), 0, 1)]
    assert [(r.extra, r.n_a, r.n_b) for r in RD.run_diff(a, b).where("doc_id is null").collect()] == [([None], 0, 1)]
    with pytest.raises(ValueError):
        RD.run_diff(a, RD.store_run(spark.createDataFrame(rows, schema), ranges=8))


def test_a_null_that_moves_is_seen(spark):
    one = spark.createDataFrame([(1, 1, "x", None)], "doc_id long, line_no int, p string, q string")
    two = spark.createDataFrame([(1, 1, None, "x")], "doc_id long, line_no int, p string, q string")
    assert RD.run_diff(RD.store_run(one), RD.store_run(two)).count() == 2


def test_differing_ranges_alone_are_shuffled(spark):
    rows = [(i, 0, "t") for i in range(100)]
    a, b = (RD.store_run(spark.createDataFrame(r, "doc_id long, line_no int, corrected string"), ranges=64) for r in (rows, rows[:-1] + [(99, 0, "u")]))
    plan = RD.run_diff(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_poisson_weights_are_poisson(spark):
    p, total = math.exp(-1), 0.0
    for k, t in enumerate(BS.POISSON):
        total += p / math.factorial(k)
        assert t == math.floor(65536 * total)
    w = spark.range(4000).select(F.explode(BS.poisson_weights(F.col("id").cast("string"), 20)).alias("w"))
    got = w.agg(F.avg("w"), F.variance("w"), F.count("w")).first()
    assert abs(got[0] - 1) < 0.02 and abs(got[1] - 1) < 0.04 and got[2] == 80_000


def test_bounds_hold_the_mean_and_narrow(spark):
    rng = random.Random(5)
    rows = [(i, "big", int(rng.random() < 0.7)) for i in range(4000)] + [(i, "small", int(rng.random() < 0.7)) for i in range(60)] + [(1, "one", 1), (2, "none", None)]
    df = spark.createDataFrame(rows, "id long, lang string, v int").repartition(4)
    got = {r.lang: r for r in BS.mean_interval(df, F.col("v"), F.col("id")).collect()}
    assert set(got) == {"big", "small", "one"}
    for r in got.values():
        assert r.lo <= r.mean <= r.hi
    assert abs((got["big"].hi - got["big"].lo) - 2 * 1.96 * math.sqrt(0.21 / 4000)) < 0.01
    assert got["small"].hi - got["small"].lo > 3 * (got["big"].hi - got["big"].lo)
    same = {r.lang: r for r in BS.mean_interval(df.repartition(9), F.col("v"), F.col("id")).collect()}
    assert same == got
    with pytest.raises(ValueError):
        BS.mean_interval(df, F.col("v"), F.col("id"), level=1.0)


def test_templates_of_a_tree(spark):
    urls = [f"http://h{i}.org/user/{i}/edit" for i in range(20)] + [f"http://h{i}.org/user/{i}/view?x=1" for i in range(20)] + ["https://h1.org/about#t"] * 3 + ["http://h2.org/about"] + [None, ""]
    urls += [f"http://h3.org/a/b/c/d/e/f{i}/g" for i in range(2)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.template: (r.n_parts, r.n) for r in TP.learned_templates(df, TP.url_parts(F.col("url")), most=3).collect()}
    assert got == {"*/user/*/edit": (4, 20), "*/user/*/view": (4, 20), "h1.org/about": (2, 3), "h2.org/about": (2, 1), "": (1, 1), "h3.org/a/b/c/d/e/*/*": (8, 2)}
    assert TP.learned_templates(df.limit(0), TP.url_parts(F.col("url"))).count() == 0


def test_many_unknown_words_give_the_same_candidates(spark, monkeypatch):
    from scrivener.operators import boundaries as B
    from scrivener.operators.lexicon import build_lexicon

    clean = spark.createDataFrame([("en", "in the house of the king"), ("en", "a lot of"), (None, "in the")], "lang string, text string")
    moved = spark.createDataFrame([("en", "inthe hou se ofthe king"), ("en", "al ot of"), ("en", "inthe house"), (None, "inthe")], "lang string, text string")

    def rows():
        return sorted(map(tuple, B.split_merge_candidates(moved, build_lexicon(clean, "text"), reference=clean).collect()))

    few = rows()
    assert ("en", "inthe", "split", "in the", 1, 1) in few and ("en", "al ot", "shift", "a lot", 1, 1) in few and ("en", "hou se", "merge", "house", 1, 0) in few
    monkeypatch.setattr(B, "FEW_ROWS", 0)
    assert rows() == few
