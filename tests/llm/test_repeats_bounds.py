"""Substring operators with settings past their packing and block sizes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_repeats import brute, frame, rows

from scrivener.llm import op7_suffix_array as bytes7
from scrivener.llm import repeats


def test_a_place_holds_the_windows_of_a_segment():
    symbols = np.zeros(2000, np.uint8)
    _, first, count, _, _ = repeats.segments([symbols], 300, 16, True)
    assert count.max() < repeats.PLACE and count.sum() == 2000 - 300 + 1
    assert (np.cumsum(count) - count == first).all()


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_wide_windows_equal_brute_force(spark, crowd):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(900)
    data = [(1, shared), (2, text(50) + shared[100:800] + text(30)), (3, "x" * 900), (4, "y" + "x" * 700), (5, shared[:299]), (6, shared[3:]), (7, None)]
    got = sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in bytes7.remove_repeats(frame(spark, data), window=300, crowd=crowd).collect())
    want = []
    for (i, t), gone in zip(data, brute([(i, (t or "").encode()) for i, t in data], 300)):
        want.append((i, len(gone), bytes(x for p, x in enumerate((t or "").encode()) if p not in gone)))
    assert got == sorted(want)


def test_the_index_decides_every_window(spark):
    """Copies and passages of one content are no exception: an index that finds nothing removes nothing."""
    data = [(1, "some text of a fair length " * 5), (2, "some text of a fair length " * 5), (3, None)]
    docs = repeats.keyed(frame(spark, data), "doc_id", "text")
    blind = lambda body, n, first: np.full(n.sum(), repeats.LAST)
    spans = lambda resolve: repeats.repeated_spans(docs, bytes7._symbols, bytes7._pieces, resolve, windows=bytes7._windows(50), window=50, gram=16)
    assert [r.ord for r in spans(bytes7.resolver(50)).collect()] == [2]
    assert spans(blind).count() == 0


@pytest.mark.parametrize("block", [1, 64])
def test_texts_longer_than_a_block_equal_brute_force(spark, block):
    data = [(i, t) for i, t in rows(3) if i not in (301, None)]  # one row an id
    docs = repeats.keyed(frame(spark, data), "doc_id", "text")
    spans = repeats.repeated_spans(docs, bytes7._symbols, bytes7._pieces, bytes7.resolver(50), bytes7._windows(50), 50, 16, block=block)
    got = {r.ord: {p for s in r.spans for p in range(s.lo, s.hi)} for r in spans.collect()}
    gone = brute([(i, (t or "").encode()) for i, t in data], 50)
    assert got == {i: g for (i, _), g in zip(data, gone) if g}


@pytest.mark.parametrize("seed", range(4))
def test_merged_ranges_are_maximal_runs(seed):
    rng = random.Random(seed)
    spans = lambda: [{"lo": lo, "hi": lo + rng.randrange(1, 9)} for lo in (rng.randrange(60) for _ in range(rng.randrange(8)))]
    data = [None, [], [{"lo": 0, "hi": 90}, {"lo": 3, "hi": 5}, {"lo": 6, "hi": 7}, {"lo": 90, "hi": 91}]] + [spans() for _ in range(40)]
    column = pa.array(data, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    for part, rows_of in ((column, data), (column.slice(2, 17), data[2:19])):
        for runs, found in zip(repeats.merged(part), rows_of, strict=True):
            held = sorted({p for s in found or () for p in range(s["lo"], s["hi"])})
            assert [p for lo, hi in runs for p in range(lo, hi)] == held
            assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_order_of_wanted_suffixes_only(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, [2, 3, 256][seed % 3], 900).astype(np.uint8)
    text[300:420] = 1
    wanted = np.zeros(900, bool)
    for a in rng.integers(0, 890, 12):
        wanted[a: a + 10] = True
    order = bytes7.two_stage_order(text, 50, wanted)
    raw = text.tobytes()
    cut = [raw[i: i + 50] for i in order.tolist()]
    assert cut == sorted(cut) and len(set(order.tolist())) == len(order)
    assert set(np.flatnonzero(wanted).tolist()) <= set(order.tolist())
    assert bytes7.two_stage_order(text, 50, np.zeros(900, bool)).size == 0


def test_steps_without_sorts_or_a_second_shuffle_of_all_contents(spark, monkeypatch):
    """Places meet the shared anchors, and the runs their places, by hash; contents are
    grouped by hash; a content's last holder comes with it, not by a join."""
    plans, keep = [], repeats.store

    def store(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df)

    monkeypatch.setattr(repeats, "store", store)
    data = [(i, f"{i} an own beginning, then a passage of fifty bytes and more that is shared") for i in range(5)]
    docs = repeats.keyed(frame(spark, data), "doc_id", "text")
    spans = repeats.repeated_spans(docs, bytes7._symbols, bytes7._pieces, bytes7.resolver(50), bytes7._windows(50), 50, 16)
    assert sorted(r.ord for r in spans.collect()) == [1, 2, 3, 4]
    by = {tuple(c): p for c, p in plans}
    assert "ShuffledHashJoin" in by["anchor", "same", "ord", "tag", "place"] and "SortMergeJoin" not in by["anchor", "same", "ord", "tag", "place"]
    assert "ShuffledHashJoin" in by["ord", "tag", "spans"]
    assert not any("SortAggregate" in p for c, p in plans if "rep_place" in c) and any("rep_place" in c for c, _ in plans)
    assert not any("Join" in p for c, p in plans if c == ["anchor", "same", "runs"])
