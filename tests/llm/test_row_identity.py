"""Rows are told apart by more than an id or a hash that may collide."""

import xxhash

from scrivener.llm import op2_simhash, op8_mixing
from scrivener.llm import op5_suffix_automata as words5
from scrivener.llm import op7_suffix_array as bytes7
from scrivener.llm.units import Memo

DOCS = "doc_id long, text string, lang string, source string"


def colliding():
    """Two texts whose 64-bit hashes (seed 42) agree in the low 31 bits."""
    seen = {}
    for i in range(400_000):
        text = " ".join(f"word{i}x{k}" for k in range(14))
        low = xxhash.xxh64_intdigest(text.encode(), 42) & 0x7FFFFFFF
        if low in seen:
            return seen[low], text
        seen[low] = text
    raise AssertionError("no pair found")


def test_rows_without_id_keep_their_own_text(spark):
    a, b = colliding()
    df = spark.createDataFrame([(1, a, "en", "s"), (None, a, "en", "s"), (None, b, "en", "s")], DOCS)
    got = sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in bytes7.remove_repeats(df).collect())
    assert got == [(0, 0, b.encode()), (0, len(a), b""), (1, 0, a.encode())]
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in words5.remove_repeats(df).collect())
    assert got == [(0, 0, b), (0, 14, ""), (1, 0, a)]


def test_many_rows_under_one_id(spark):
    text = "a passage of some length that stands in many rows of the table, again and again and again"
    df = spark.createDataFrame([(7, text, "en", "s")] * 40 + [(7, "own " + text, "en", "s"), (3, text, "en", "s")], DOCS)
    got = [(r.doc_id, r.n_removed) for r in bytes7.remove_repeats(df).collect()]
    assert sorted(got) == [(3, 0)] + [(7, len(text))] * 41
    assert words5.remove_repeats(df).where("doc_id = 7 and n_removed = 0").count() == 0


def test_mix_keeps_rows_that_differ_in_which_column_is_null(spark):
    rows = [(1, "one two three", "x", None), (1, "one two three", None, "x"), (None, "one two three", "x", None), (None, "one two three", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = op8_mixing.mix(df, tag=op8_mixing.row_tag(df)).collect()
    got = [tuple(r) for r in op8_mixing.mixed_rows(df).collect()]
    assert len(got) == sum(r.copies for r in taken)
    for row in set(rows):
        want = [r.copies for r in taken if (r.doc_id, r.source) == (row[0], row[3])]
        assert got.count(row) == sum(want)


def test_near_duplicates_keep_one_of_rows_that_differ_in_a_null(spark):
    rows = [(1, "one two three four", "x", None), (1, "one two three four", None, "x"), (1, "another text of more words", None, "x")]
    got = [tuple(r) for r in op2_simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(got) == 2 and rows[2] in got and len({rows[0], rows[1]} & set(got)) == 1


def test_memo_is_bounded_in_bytes():
    memo = Memo(lambda xs: [x.upper() for x in xs], len, most=2000, long=8)
    lists = [[f"u{i}" for i in range(300)], ["longer than eight", "u1"]]
    get = memo.lookup(lists)
    assert all(get(u) == u.upper() for xs in lists for u in xs)
    assert memo.held <= 2000 + 400 and "longer than eight" not in memo.known
    assert [memo.lookup([["u250"]])("u250"), memo.lookup([["u2"]])("u2")] == ["U250", "U2"]
