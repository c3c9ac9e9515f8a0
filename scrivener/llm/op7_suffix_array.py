"""Suffix-array dedup: bytes of passages that an earlier document holds too.

A shard's segments (see ``repeats``) are laid end to end and the suffixes that
start a window of their segment are sorted in two stages (a segment's last
``window`` - 1 bytes start none).  Suffixes smaller than their successors (the one
that starts a byte later) are sorted directly by their first ``window`` bytes.
All others are induced: buckets of equal first bytes are scanned in order, and
each suffix met puts its predecessor, if that is larger than it, at the next
place of the predecessor's bucket.  Common prefixes of neighbours in the order
are computed next; neighbours with ``window`` bytes in common hold equal
windows, and each run of them takes the smallest document id among its
members.

Rows: one per input row.  A null or empty text has 0 bytes and nothing is
removed; so has a text shorter than ``window``.  Null ids count as larger than
any other; rows that share an id do not remove from each other; rows alike in
id and text get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from scrivener.llm.common import slices
from scrivener.llm.repeats import LAST, gram_hashes, keyed, merged, repeated_spans


def two_stage_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None, eight: np.ndarray | None = None) -> np.ndarray:
    """Start places of all suffixes of ``text`` (bytes), in order of their first
    ``depth`` bytes at least; further ties are in any order.  With ``wanted`` (a
    flag per place) of those suffixes only, and of those they are induced from.
    ``eight``: the ``eights`` of the text, unless they are to be made."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if the next differing byte is larger.
    change = np.flatnonzero(text[1:] != text[:-1])
    run = np.cumsum(np.append(False, text[1:] != text[:-1]))
    known = run < len(change)
    smaller = np.zeros(n, bool)
    at = change[run[known]]
    smaller[known] = text[at + 1] > text[at]
    if wanted is None:
        wanted = np.ones(n, bool)
    else:
        # A suffix that is induced needs its successor, and so on up to one that is sorted (or the last one).
        ends = np.flatnonzero(smaller | (np.arange(n) == n - 1))
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        upto = ends[np.searchsorted(ends, last)]
        depths = np.zeros(n + 1, np.int64)
        np.add.at(depths, last, 1)
        np.add.at(depths, upto + 1, -1)
        wanted = wanted | (np.cumsum(depths[:n]) > 0)
    direct = np.flatnonzero(smaller & wanted)
    larger = wanted & ~smaller
    direct = direct[_sorted(eights(text, depth) if eight is None else eight, direct, depth)]
    bounds = np.searchsorted(text[direct], np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))  # it ends first, so it comes first in its bucket
    out: list[np.ndarray] = []

    def put(met: np.ndarray, byte: int) -> np.ndarray:
        """Place the predecessors of suffixes in order; returns those of this bucket."""
        before = met[met > 0] - 1
        before = before[larger[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        ends = np.flatnonzero(np.append(first[1:] != first[:-1], True)) + 1 if len(first) else []
        own, lo = before[:0], 0
        for hi in ends:
            if first[lo] == byte:
                own = before[lo:hi]
            else:
                induced[first[lo]].append(before[lo:hi])
            lo = hi
        return own

    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = put(wave, byte)
        some = direct[bounds[byte]: bounds[byte + 1]]
        if len(some):
            out.append(some)
            put(some, byte)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sorted(eight: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The order of places by their first ``depth`` bytes: by the first eight, then ties alone by the next ones."""
    key = eight_at(eight, at, 0, depth)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    # Places in the order whose group of equals so far has more than one, and their groups.
    left = np.flatnonzero(~(new & np.append(new[1:], True)))
    group = np.cumsum(new)[left]
    for k in range(8, depth, 8):
        if not len(left):
            break
        some = order[left]
        value = eight_at(eight, at[some], k, depth)
        by = np.lexsort((value, group))
        order[left], value = some[by], value[by]
        new = np.append(True, (value[1:] != value[:-1]) | (group[1:] != group[:-1]))
        tied = ~(new & np.append(new[1:], True))
        left, group = left[tied], np.cumsum(new)[tied]
    return order


def eights(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place up to ``depth`` past the end as a number (zeros past the end)."""
    key = np.concatenate([text, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        key = (key[:-size] << np.uint64(8 * size)) | key[size:]
    return key[: len(text) + depth]


def eight_at(eight: np.ndarray, at: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Bytes ``k`` to ``k`` + 7 from each place, those from ``depth`` on as zeros."""
    key = eight[at + k]
    return key & ~np.uint64((1 << (8 * (8 - depth + k))) - 1) if depth - k < 8 else key


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, eight: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each suffix in order has in common with the one before (0 for
    the first), up to ``depth``."""
    out, eight = np.zeros(len(order), np.int64), eights(text, depth) if eight is None else eight
    live = np.arange(1, len(order))  # those that are equal to the one before so far
    for k in range(0, depth, 8):
        differ = eight[order[live] + k] ^ eight[order[live - 1] + k]
        lead = np.zeros(len(differ), np.int64)
        for byte in range(1, 9):
            lead += differ < np.uint64(1 << (64 - 8 * byte)) if byte < 8 else differ == 0
        out[live] += np.minimum(lead, depth - k)
        live = live[differ == 0]
    return out


def resolver(window: int):
    def resolve(body: list[bytes], n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The smallest ``first`` among the segments that hold each window."""
        text = np.frombuffer(b"\0".join(body) + b"\0", np.uint8)
        lens = np.fromiter(map(len, body), np.int64, len(body))
        begin = np.cumsum(lens + 1) - lens - 1
        # Places where a whole window lies in one segment: only their suffixes are of use.
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wanted = np.zeros(len(text), bool)
        wanted[at] = True
        eight = eights(text, window)
        order = two_stage_order(text, window, wanted, eight)
        run = np.cumsum(common_prefixes(text, order, window, eight) < window) - 1
        of = np.empty(len(text), np.int64)
        of[order] = run
        least = np.full(run[-1] + 1 if len(run) else 0, LAST)
        np.minimum.at(least, of[at], np.repeat(first, n))
        return least[of[at]]

    return resolve


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _pieces(text: str):
    data = text.encode()
    return lambda lo, hi: data[lo:hi]


def _windows(window: int):
    def hashes(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(body, np.uint8).astype(np.uint64)
        (one,), (two,) = gram_hashes(x, window), gram_hashes(x ^ np.uint64(0xA5), window)
        return one[:n].view(np.int64), two[:n].view(np.int64)

    return hashes


def remove_repeats(df: DataFrame, window: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", crowd: int = 20_000,
                   row: Column | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, kept_text) of every row;
    ``row`` (a struct of columns) is carried as ``row`` in place of the id if
    given.  ``kept_text`` leaves out bytes of characters cut in two, and is null
    for a null text."""
    docs = keyed(df, id_col, text_col, row)
    spans = repeated_spans(docs, _symbols, _pieces, resolver(window), _windows(window), window, gram, crowd)
    joined = docs.join(spans, ["ord", "tag"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                size, removed, n, kept, as_text = [], [], [], [], []
                for text, runs in zip(part.column(1).to_pylist(), merged(part.column(2))):
                    data, at, rest = (text or "").encode(), 0, []
                    for lo, hi in runs:
                        rest.append(data[at:lo])
                        at = hi
                    rest.append(data[at:])
                    size.append(len(data))
                    removed.append(sum(hi - lo for lo, hi in runs))
                    n.append(len(runs))
                    kept.append(b"".join(rest))
                    as_text.append(None if text is None else kept[-1].decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()),
                                                  pa.array(as_text, pa.string())], ["row", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    row_type = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    return out.withColumnRenamed("row", id_col) if row is None else out


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS win
                   FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
firsts AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i FROM w JOIN firsts USING (win) WHERE firsts.first < w.doc_id),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
         FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY doc_id, run),
gap AS (SELECT doc_id, lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next, hi FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, min(lo) AS first,
               string_agg(CASE WHEN next IS NULL THEN substr(x, 2 * hi + 1) ELSE substr(x, 2 * hi + 1, 2 * (next - hi)) END, '' ORDER BY lo) AS rest
        FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN x ELSE substr(x, 1, 2 * first) || rest END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
