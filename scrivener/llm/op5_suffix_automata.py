"""Substring dedup by suffix automata of reference shards.

Reference shards are the segments of shared passages (see ``repeats``), dealt
by anchor, a quarter MB each.  A shard's words become a generalised suffix
automaton whose states carry the smallest document id among the places they
stand for.  The shard's passages then stream through it: the automaton's state
and match length after each word are the matching statistics, and where the
length reaches ``window`` words, the state of the last ``window`` words tells
the smallest document that holds them.  Spans whose smallest document comes
before their own go.

An automaton of all earlier documents has no size bound, so it is never
broadcast whole: the bounded automaton of a shard meets just those passages
that can match it, and a passage's other copies take its result by content.

Words are runs of bytes that are not ASCII white space.  Rows: one per input
row.  A null, empty or blank text has 0 words; a text with fewer than
``window`` words loses none.  Null ids count as larger than any other; rows
that share an id do not remove from each other; rows alike in id and text get
the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from scrivener.llm.common import slices
from scrivener.llm.repeats import LAST, gram_hashes, keyed, merged, repeated_spans


#: Bytes per shard: an automaton's edges take some hundred times its words, and are met at random.
SHARD_BYTES = 1 << 18


class SuffixAutomaton:
    """A generalised suffix automaton of word lists; ``least`` of a state is the
    smallest owner of the words it stands for."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]

    def add(self, words: list, owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # another list has these words already
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                cur, p = self._state({}, length[last] + 1), last
                while p >= 0:
                    edges = nxt[p]
                    q = edges.get(w)
                    if q is not None:
                        break
                    edges[w] = cur
                    p = link[p]
                if q is not None:
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = cur
            if owner < least[last]:
                least[last] = owner

    def _state(self, edges: dict, length: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        self.least.append(LAST)
        return len(self.link) - 1

    def _split(self, p: int, w, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone] = self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def finish(self) -> None:
        """Hand the smallest owners down to all suffixes, longest states first."""
        length, link, least = np.asarray(self.length), np.asarray(self.link), np.asarray(self.least)
        order = np.argsort(length, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1)[:0:-1]:
            np.minimum.at(least, link[some], least[some])
        self.least = least.tolist()

    def shortest(self, window: int) -> list[int]:
        """Per state the state of its last ``window`` words, itself if they are fewer."""
        length, link = np.asarray(self.length), np.asarray(self.link)
        up = np.where((link >= 0) & (length[link] >= window), link, np.arange(len(link)))
        while True:
            further = up[up]
            if (further == up).all():
                return up.tolist()
            up = further

    def stream(self, words: list, window: int, shortest: list[int] | None = None) -> list[int | None]:
        """After each word: the smallest owner of the last ``window`` words, if
        they match at all; ``shortest`` of the window, unless it is to be made."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        top = self.shortest(window) if shortest is None else shortest
        state = size = 0
        out = []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is not None:
                state = top[to]
                size = min(size + 1, length[state])
            out.append(least[state] if size >= window else None)
        return out


def resolver(window: int):
    def resolve(body: list[bytes], n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The smallest ``first`` among the segments that hold each window."""
        number: dict[bytes, int] = {}
        lists = [[number.setdefault(w, len(number)) for w in b.split()] for b in body]
        automaton = SuffixAutomaton()
        for words, owner in zip(lists, first.tolist()):
            automaton.add(words, owner)
        automaton.finish()
        shortest, out = automaton.shortest(window), []
        for words in lists:
            out += automaton.stream(words, window, shortest)[window - 1:]
        return np.array(out, np.int64)

    return resolve


def _hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    # Without a seed (the scans), no Python frame per word.
    return np.fromiter(map(h, words) if seed == 0 else (h(w, seed) for w in words), np.uint64, len(words))


def _symbols(text: str) -> np.ndarray:
    return _hash_words(text.encode().split())


def _pieces(text: str):
    words = text.encode().split()
    return lambda lo, hi: b" ".join(words[lo:hi])


def _windows(window: int):
    def hashes(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        words = body.split()
        (one,), (two,) = gram_hashes(_hash_words(words), window), gram_hashes(_hash_words(words, 1), window)
        return one[:n].view(np.int64), two[:n].view(np.int64)

    return hashes


def remove_repeats(df: DataFrame, window: int = 13, gram: int = 4, id_col: str = "doc_id", text_col: str = "text", crowd: int = 20_000) -> DataFrame:
    """(id, n_words, n_removed, kept: the words that stay, joined by one space)."""
    docs = keyed(df, id_col, text_col)
    spans = repeated_spans(docs, _symbols, _pieces, resolver(window), _windows(window), window, gram, crowd, shard_bytes=SHARD_BYTES)
    joined = docs.join(spans, ["ord", "tag"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                size, removed, kept = [], [], []
                for text, runs in zip(part.column(1).to_pylist(), merged(part.column(2))):
                    words, at, rest = (text or "").encode().split(), 0, []
                    for lo, hi in runs:
                        rest += words[at:lo]
                        at = hi
                    rest += words[at:]
                    size.append(len(words))
                    removed.append(len(words) - len(rest))
                    kept.append(b" ".join(rest).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    id_type = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {id_type}, n_words long, n_removed long, kept string").withColumnRenamed("row", id_col)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
                     FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT win.doc_id, i + unnest(range(0, 13)) AS at FROM win JOIN firsts USING (s) WHERE firsts.first < win.doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d WHERE len(w) > 0),
kept AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(e.word, ' ' ORDER BY e.at) AS s
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at WHERE g.at IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
