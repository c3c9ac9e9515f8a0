"""Substring operators against brute force, and the index structures alone."""

import random

import numpy as np
import pytest

from scrivener.llm import op5_suffix_automata as words5
from scrivener.llm import op7_suffix_array as bytes7

SCHEMA = "doc_id long, text string, lang string, row string, ord int, tag int"


def rows(seed=0):
    """Copies, near copies, shared passages, runs of one byte, ties and nulls."""
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "été", "naïve", "日本", "x", "of", "the"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = text(40), text(120)
    out = [(i, text(rng.randrange(200))) for i in range(30)]
    out += [(100 + i, f"{text(10)}\n{shared}\t {text(7)}") for i in range(12)]
    near = base.split()
    for i in range(12):
        near[rng.randrange(len(near))] = f"new{i}"
        out.append((200 + i, " ".join(near)))
    out += [(300, base), (301, base), (301, base), (301, base + " more"), (302, "a" * 700), (303, "b" + "a" * 300), (304, "\0" * 120), (305, "\0" * 130)]
    out += [(400, None), (401, ""), (402, " \n\t "), (None, base), (None, shared), (50, shared), (-7, shared + " tail"), (403, "word " * 400), (404, "word " * 90)]
    rng.shuffle(out)
    return out


def brute(data, window):
    """Per row the covered positions of a sequence, by the definition."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, s in data:
        for a in range(len(s) - window + 1):
            w = s[a: a + window]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, s in data:
        gone = set()
        for a in range(len(s) - window + 1):
            if first[s[a: a + window]] < key(i):
                gone.update(range(a, a + window))
        out.append(gone)
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 2) for i, t in data], SCHEMA)


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_bytes_removed_equal_brute_force(spark, crowd):
    data = rows(1)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bytes7.remove_repeats(frame(spark, data), window=50, crowd=crowd).collect())
    want = []
    for (i, t), gone in zip(data, brute([(i, (t or "").encode()) for i, t in data], 50)):
        b = (t or "").encode()
        spans = sum(1 for p in gone if p - 1 not in gone)
        want.append((str(i), len(b), len(gone), spans, bytes(x for p, x in enumerate(b) if p not in gone)))
    assert got == sorted(want)


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_words_removed_equal_brute_force(spark, crowd):
    data = rows(2)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in words5.remove_repeats(frame(spark, data), window=13, crowd=crowd).collect())
    split = [(i, tuple((t or "").encode().split())) for i, t in data]
    want = []
    for (i, w), gone in zip(split, brute(split, 13)):
        want.append((str(i), len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    assert got == sorted(want)


def test_empty_table(spark):
    assert bytes7.remove_repeats(frame(spark, [])).count() == 0
    assert words5.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_two_stage_order_is_the_suffix_order(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, [2, 3, 5, 256][seed % 4], 600).astype(np.uint8)
    if seed > 4:
        text[100:400] = 7
    depth = 50
    order = bytes7.two_stage_order(text, depth)
    assert sorted(order.tolist()) == list(range(600))
    raw = text.tobytes()
    cut = [raw[i: i + depth] for i in order.tolist()]
    assert cut == sorted(cut)
    want = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(cut, cut[1:])]
    got = bytes7.common_prefixes(text, order, depth).tolist()
    # Past the end of the text common_prefixes reads zeros.
    assert all(g == w or (g > w and min(len(a), len(b)) < depth) for g, w, a, b in zip(got[1:], want[1:], cut, cut[1:]))


def test_automaton_streams_matching_statistics():
    rng = random.Random(5)
    refs = [[rng.randrange(3) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    automaton = words5.SuffixAutomaton()
    for owner, words in enumerate(refs):
        automaton.add(words, owner)
    automaton.finish()
    for window in (1, 4, 9):
        query = [rng.randrange(4) for _ in range(300)]
        for at, got in enumerate(automaton.stream(query, window)):
            tail = query[max(0, at - window + 1): at + 1]
            owners = [o for o, r in enumerate(refs) if len(tail) == window and any(r[k: k + window] == tail for k in range(len(r)))]
            assert got == (min(owners) if owners else None)
