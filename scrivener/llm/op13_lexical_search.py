"""Ranked lexical search by an Aho-Corasick scan of the documents.

All terms of the query items form one automaton; there is no index of the
documents.  A text is scanned as bytes in which A-Z are lower-cased and every
other ASCII character that no term holds is a space (one table look-up per
byte); the automaton holds each term between two spaces, so only whole terms
match.  The outputs of the automaton are term numbers, which map to the items
that hold the term.

Two scans: the first counts documents, terms and each query term's documents
(one row per term and task); the second counts tf again, adds each term's share
to the items it belongs to, and keeps the best ``k`` documents per item of
every task, which meet by item.  No (item, document) pair leaves a task
otherwise, and documents are never moved.

Items whose terms together pass ``block_bytes`` are searched in blocks, each
with an automaton of bounded size and two scans of its own; the broadcast
tables are those of a block.

Terms are the maximal runs of characters other than ASCII ones that are no
letter or digit.  With N documents that hold a term, L their terms with
repeats, n those of one document and df the documents of a term: a term weighs
w = floor(1000 * ln((2N + 2) / (2df + 1))); m = 100 - b + (b * n * N) div L;
a document scores the sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)) over
the item's terms, once each.

Rows: up to ``k`` per item, those with a score above 0, equal scores by
ascending id (null last).  Null and empty texts have no terms and count
nowhere.  Repeated document rows are documents of their own; rows that share
an item id (null included) are one item with all their terms.  An item without
terms, or without a document that scores, gives no row; empty tables give none.
A text is scanned whole, whatever its length.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.llm.common import drop, global_running, slices, store

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every byte as it is scanned: a lower-case letter, a digit, part of another character, or a space.
SCAN = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of the terms of a block of items.
BLOCK_BYTES = 8 << 20
#: Scores held at once by a task (documents x items, 8 bytes each).
CELLS = 1 << 21
#: Sums up to this are exact in double precision.
EXACT = 1 << 53


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), distinct: the terms of each item."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(id_col).alias("item"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def automaton(terms: list[str]):
    """Whole terms; each gives its number."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word(" " + term.encode().decode("latin-1") + " ", k)
    if terms:
        out.make_automaton()
    return out


def scan(found, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats; text, term and tf of each that occurs,
    by text and term), from one pass over all of them."""
    parts = [(t or b"").translate(SCAN) for t in texts]
    starts = np.cumsum([1, *[len(p) + 1 for p in parts]])
    joined = b" ".join([b"", *parts, b""])
    blank = np.frombuffer(joined, np.uint8) == 32
    begins = np.concatenate([[0, 0], np.cumsum(blank[:-1] & ~blank[1:])])  # before each place, terms that begin there included from the next on
    n = begins[starts[1:]] - begins[starts[:-1]]
    hits = np.fromiter(chain.from_iterable(found.iter(joined.decode("latin-1"))), np.int64) if len(found) else np.zeros(0, np.int64)
    width = max(1, len(found))
    doc = np.searchsorted(starts, hits[::2] - 1, "right") - 1
    key, tf = np.unique(doc * width + hits[1::2], return_counts=True)
    return n, key // width, key % width, tf


def _counts(docs: DataFrame, terms) -> DataFrame:
    """(term long, n long): documents per term number, -1: documents with a term, -2: their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms.value)
        df, total = np.zeros(len(terms.value), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                n, _, term, _ = scan(found, part.column(1).cast(pa.binary()).to_pylist())
                df += np.bincount(term, minlength=len(df))
                total += (np.count_nonzero(n), n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], total))], ["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Scorer:
    """Scores of documents for the items of a block, the best k kept per item.

    ``postings``: for each term the numbers of its items."""

    def __init__(self, weights: np.ndarray, postings: list[np.ndarray], n_items: int, n_docs: int, n_terms: int, k: int, b: int = 90):
        self.w, self.items, self.k, self.b, self.docs, self.terms = weights, n_items, k, b, n_docs, n_terms
        self.fan = np.fromiter(map(len, postings), np.int64, len(postings))
        self.at = np.cumsum(self.fan) - self.fan
        self.flat = np.concatenate(postings) if postings else np.zeros(0, np.int64)
        # The largest possible score decides whether sums in double precision are exact.
        most = np.zeros(n_items, object)
        np.add.at(most, self.flat, np.repeat(weights, self.fan).astype(object) * 10**6)
        self.exact = max(most, default=0) < EXACT
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_items  # scores and documents, best first
        self.least = np.ones(n_items, np.int64)  # what a document must score to be looked at

    def add(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents ``ids`` with ``n`` terms each; (doc, term, tf) by document."""
        m = 100 - self.b + (self.b * n * self.docs) // max(1, self.terms)
        share = self.w[term] * ((10**9 * tf) // (1000 * tf + 8 * m[doc]))
        fan = self.fan[term]
        # Runs of documents with bounded work: scores held, shares spread to items.
        work = np.bincount(doc, weights=fan, minlength=len(ids)).astype(np.int64) + self.items
        group = np.cumsum(work) // CELLS
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
            a, z = np.searchsorted(doc, [lo, hi])
            self._some(ids[lo:hi], doc[a:z] - lo, term[a:z], share[a:z], fan[a:z])

    def _some(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, share: np.ndarray, fan: np.ndarray) -> None:
        step = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        cell = np.repeat(doc * self.items, fan) + self.flat[np.repeat(self.at[term], fan) + step]
        size = len(ids) * self.items
        if self.exact:
            score = np.bincount(cell, weights=np.repeat(share, fan), minlength=size).astype(np.int64)
        else:
            score = np.zeros(size, np.int64)
            np.add.at(score, cell, np.repeat(share, fan))
        score = score.reshape(len(ids), self.items)
        if len(ids) > self.k:  # of many documents only those that reach the k-th score of this run
            self.least = np.maximum(self.least, np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, item = np.nonzero(score >= self.least)
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        cuts = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(item)]):
            i = item[lo]
            s = np.concatenate([self.held[i][0], score[row[lo:hi], i]])
            d = np.concatenate([self.held[i][1], ids[row[lo:hi]]])
            best = np.lexsort((d, -s))[: self.k]
            self.held[i] = (s[best], d[best])
            if len(best) == self.k:
                self.least[i] = max(self.least[i], s[best[-1]])

    def rows(self) -> pa.RecordBatch:
        size = [len(s) for s, _ in self.held]
        cols = [np.repeat(np.arange(self.items), size), *(np.concatenate([h[c] for h in self.held]) if self.held else np.zeros(0, np.int64) for c in (1, 0))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_no", "id", "score"])


#: Stands for a null id, which comes last.
LAST = (1 << 63) - 1


def _search_block(docs: DataFrame, pairs: list[tuple[int, str]], n_items: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(item_no, id, score): the best k of each task and item, and a stored table."""
    spark = docs.sparkSession
    terms = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(terms)}
    of: list[list[int]] = [[] for _ in terms]
    for item, term in pairs:
        of[number[term]].append(item)
    shipped = spark.sparkContext.broadcast(terms)
    counted = store(_counts(docs, shipped))
    known = {r["term"]: r["n"] for r in counted.collect()}  # a row per term of the block
    n_docs, n_terms = known.pop(-1, 0), known.pop(-2, 0)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * known.get(i, 0) + 1))) for i in range(len(terms))]
    tables = spark.sparkContext.broadcast((np.array(weights, np.int64), [np.array(x, np.int64) for x in of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shipped.value)
        scorer = Scorer(*tables.value, n_items, n_docs, n_terms, k)
        for batch in batches:
            for part in slices(batch, 1):
                ids = np.asarray(part.column(0))
                scorer.add(ids, *scan(found, part.column(1).cast(pa.binary()).to_pylist()))
        yield scorer.rows()

    return docs.mapInArrow(run, "item_no long, id long, score long"), counted


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank int, id long, score long): the best ``k`` documents of each item.  Ids are whole numbers."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"))
    pairs = store(item_terms(items, item_col, item_text_col))
    sizes = pairs.groupBy("item").agg(F.sum(F.octet_length("term") + 16).alias("size"))
    # Items in order, cut where the terms so far pass the bound; an item is never cut, so a block may pass it by one item.
    ordered, held = global_running(sizes, [F.col("item")], {"no": F.lit(1), "upto": F.col("size")})
    ordered = store(ordered.select("item", (F.col("no") - 1).alias("no"), F.floor((F.col("upto") - F.col("size")) / F.lit(block_bytes)).cast("long").alias("block")))
    drop(held)
    tops = []
    for b in [r["block"] for r in ordered.select("block").distinct().orderBy("block").collect()]:  # one row per block
        mine = ordered.where(F.col("block") == b)
        span = mine.agg(F.min("no").alias("lo"), F.count("*").alias("n")).first()
        of = pairs.join(mine, pairs["item"].eqNullSafe(mine["item"])).select((F.col("no") - span["lo"]).alias("no"), "term").collect()  # bounded by block_bytes
        top, counted = _search_block(src, [(r["no"], r["term"]) for r in of], span["n"], k)
        tops.append(store(top.select((F.col("item_no") + span["lo"]).alias("no"), "id", "score")))
        drop(counted)
    drop(pairs)
    if not tops:
        empty = items.select(F.col(item_col)).where("false")
        return empty.select(item_col, F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("score"))
    every = tops[0]
    for top in tops[1:]:
        every = every.union(top)
    # At most k rows per item and task.
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.col("score").desc(), "id"))
    best = every.withColumn("rank", rank).where(F.col("rank") <= k)
    out = best.join(ordered, "no")
    return out.select(F.col("item").alias(item_col), "rank", F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "score")


#: DuckDB SQL of the registered query.
ORACLE = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
n AS (SELECT rid, count(*) AS n FROM t GROUP BY rid),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM n),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term),
s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (rid), g GROUP BY item_id, rid)
SELECT item_id, row_number() OVER p::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW p AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER p <= 10
"""
