"""Exact top-k inner products with a KD-tree per shard.

Vectors are quantised to whole numbers, numbered in a stored copy and dealt to
shards by a hash of that number.  Each shard builds a KD-tree: median splits on
the widest dimension, tight bounding boxes, equal vectors never split.  For a
query and a box, the sum over dimensions of max(q * low, q * high) bounds every
inner product inside.  A query visits leaves best first, in order of that bound
(a box lies inside its parent's, so this is the order in which a heap of nodes
gives them up), and stops when the best bound left cannot beat its k-th result.

Queries travel in blocks.  The queries of a block go down a tree together, in
waves of 1, 2, 4, ... leaves each: a leaf is scored by one matrix product for
all queries that want it, and after a wave every query's k-th score rises.  A
block first searches one home shard; the k-th score found there goes along to
all other shards, where it prunes from the start.  Each shard returns at most k
results a query; those are merged.

Rows: a vector that is null or holds a null or non-finite component takes no
part, nor does a row with a null id.  A query's candidates are all other rows
of its vector's length, rows that share its id included; if there are fewer
than k, all of them are returned.  Rows that share an id are rows of their own,
as queries (each is ranked from 1) and as candidates.  Ties go to the smaller
id.  No queries or no candidates: no rows.  Quantised components and scores
must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.llm.common import drop, store

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
LEAF = 64
LOWEST, LAST = -(1 << 63), (1 << 63) - 1


def finite(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def quantise(vec: Column, scale: float) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class Tree:
    """Arrays of a KD-tree: ids and row numbers of its vectors in leaf order,
    and per node its range of vectors, children (0: none), box and smallest id."""

    def __init__(self, ids, rows, vecs, start, end, left, right, low, high, first):
        self.ids, self.rows, self.vecs, self.start, self.end = ids, rows, vecs, start, end
        self.left, self.right, self.low, self.high, self.first = left, right, low, high, first

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray) -> Tree:
        order = np.argsort(ids, kind="stable")
        start, end, left, right, low, high, first = [0], [len(ids)], [0], [0], [], [], []
        node = 0
        while node < len(start):
            some = order[start[node]: end[node]]
            box = vecs[some]
            lo, hi = box.min(axis=0), box.max(axis=0)
            low.append(lo)
            high.append(hi)
            first.append(ids[some].min())
            if len(some) > LEAF and (hi > lo).any():
                d = int(np.argmax(hi - lo))
                at = np.sort(box[:, d])[len(some) // 2]
                # Rows equal to the median stay together unless they fill a side.
                go = box[:, d] < at if at > lo[d] else box[:, d] <= at
                order[start[node]: end[node]] = np.concatenate([some[go], some[~go]])
                mid = start[node] + int(go.sum())
                left[node], right[node] = len(start), len(start) + 1
                start += [start[node], mid]
                end += [mid, end[node]]
                left += [0, 0]
                right += [0, 0]
            node += 1
        return cls(ids[order], rows[order], vecs[order], *(np.array(x, np.int64) for x in (start, end, left, right)), np.array(low), np.array(high), np.array(first))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no vector of the node scores higher.  Products are
        sums of whole numbers; beyond 2**53 they are done in Python integers."""
        kind = _exact(queries, self.vecs) or object
        q = queries.astype(kind)
        return np.maximum(q, 0) @ self.high.T.astype(kind) + np.minimum(q, 0) @ self.low.T.astype(kind)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of up to k results per query, best first, among
        rows other than the query's ``own``; rows that score under a query's
        ``least`` may be left out."""
        kind = _exact(queries, self.vecs) or np.int64
        q, vecs = queries.astype(kind), self.vecs.astype(kind)
        leaves = np.flatnonzero(self.left == 0)
        bound = self.bounds(queries)[:, leaves]
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        first = self.first[leaves][order]
        n = self.end[leaves] - self.start[leaves]
        # Equal vectors stand in order of id: none past the first k + 1 can be among the k.
        alike = (self.low[leaves] == self.high[leaves]).all(axis=1)
        n = np.where(alike, np.minimum(n, k + 1), n)
        floor, worst = least.copy(), np.full(len(q), LAST)
        of, at, score = (np.zeros(0, np.int64) for _ in range(3))
        done, wave = 0, 1
        while done < len(leaves):
            upto = slice(done, done + wave)
            # A leaf whose bound only ties the k-th score needs a smaller id to matter.
            take = (bound[:, upto] > floor[:, None]) | ((bound[:, upto] == floor[:, None]) & (first[:, upto] < worst[:, None]))
            if not take.any():
                if not (bound[:, done] >= floor).any():
                    break
                done, wave = done + wave, 2 * wave
                continue
            asks, col = np.nonzero(take)
            leaf = order[:, upto][asks, col]
            by = np.argsort(leaf, kind="stable")
            asks, leaf = asks[by], leaf[by]
            cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            new = [(of, at, score)]
            for a, b in zip(cuts, np.append(cuts[1:], len(leaf))):
                who, lo = asks[a:b], self.start[leaves[leaf[a]]]
                got = q[who] @ vecs[lo: lo + n[leaf[a]]].T
                x, y = np.nonzero(got >= floor[who][:, None])
                new.append((who[x], lo + y, got[x, y].astype(np.int64)))
            of, at, score = (np.concatenate(x) for x in zip(*new))
            mine = self.rows[at] != own[of]
            of, at, score = of[mine], at[mine], score[mine]
            best = np.lexsort((self.ids[at], -score, of))
            of, at, score = of[best], at[best], score[best]
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            of, at, score, nth = (x[nth < k] for x in (of, at, score, nth))
            full = nth == k - 1
            floor[of[full]], worst[of[full]] = score[full], self.ids[at[full]]
            done, wave = done + wave, 2 * wave
        return of, self.ids[at], score


def _exact(a: np.ndarray, b: np.ndarray) -> type | None:
    """The smallest float type in which the products of the two are whole
    numbers without rounding, if there is one."""
    if a.size == 0 or b.size == 0:
        return np.float64
    most = 2 * float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return np.float32 if most < 2.0 ** 23 else np.float64 if most < 2.0 ** 52 else None


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.int64).reshape(len(col), dim)


_TREE = "dim int, shard int, ids binary, rows binary, vecs binary, start binary, end binary, left binary, right binary, low binary, high binary, first binary"
_PARTS = ("ids", "rows", "vecs", "start", "end", "left", "right", "low", "high", "first")


def _build(t: pa.Table) -> pa.Table:
    dim, shard = t["dim"][0].as_py(), t["shard"][0].as_py()
    tree = Tree.build(np.asarray(t["id"]).astype(np.int64), np.asarray(t["row"]).astype(np.int64), _matrix(t["vec"].combine_chunks(), dim))
    row = {"dim": [dim], "shard": [shard]} | {p: [_blob(getattr(tree, p))] for p in _PARTS}
    return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), *[(p, pa.binary()) for p in _PARTS]]))


def _pack(t: pa.Table) -> pa.Table:
    dim = t["dim"][0].as_py()
    ids, rows = (np.asarray(t[c]).astype(np.int64) for c in ("id", "row"))
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([t["block"][0].as_py()], pa.int32()), "qids": [_blob(ids)], "qrows": [_blob(rows)],
                     "qvecs": [_blob(_matrix(t["vec"].combine_chunks(), dim))]})


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                dim = row["dim"]
                parts = {p: np.frombuffer(row[p], np.int64) for p in _PARTS}
                # By number of rows: vectors of no components have no length to go by.
                for p, of in (("vecs", "ids"), ("low", "start"), ("high", "start")):
                    parts[p] = parts[p].reshape(len(parts[of]), dim)
                qids, qrows = (np.frombuffer(row[c], np.int64) for c in ("qids", "qrows"))
                queries = np.frombuffer(row["qvecs"], np.int64).reshape(len(qids), dim)
                known = dict(zip(row["bound_rows"] or [], row["bounds"] or []))
                least = np.array([known.get(r, LOWEST) for r in qrows.tolist()], np.int64)
                of, ids, score = Tree(**parts).search(queries, qrows, k, least)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(of), pa.int32()), pa.array([dim] * len(of), pa.int32()), pa.array(qrows[of], pa.int64()),
                                                  pa.array(qids[of], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())],
                                                 ["block", "dim", "query_row", "query_id", "vec_id", "score"])
    return run


_FOUND = "block int, dim int, query_row long, query_id long, vec_id long, score long"


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for
    which ``is_query`` (an expression of the column ``id``) holds."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")))
    vecs = store(src.select("id", F.monotonically_increasing_id().alias("row"), quantise(F.col("v"), scale).alias("vec"), F.size("v").alias("dim")))
    queries = vecs.where(is_query)
    shards = max(1, -(-vecs.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    keyed = vecs.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    trees = store(keyed.groupBy("dim", "shard").applyInArrow(_build, _TREE))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit("q")), F.lit(blocks)).cast("int")).groupBy("dim", "block")
    packed = store(packed.applyInArrow(_pack, "dim int, block int, qids binary, qrows binary, qvecs binary"))

    # A home shard without vectors of a block's length finds nothing; the other shards then start without a bound.
    home = F.pmod("block", F.lit(shards)).cast("int")
    none = [F.lit(None).cast("array<long>").alias("bound_rows"), F.lit(None).cast("array<long>").alias("bounds")]
    search = _searcher(k)
    first = packed.withColumn("shard", home).join(trees, ["dim", "shard"])
    found = store(first.select("*", *none).repartition(_tasks(df, blocks), "dim", "block").mapInArrow(search, _FOUND))
    # The k-th score at home, for queries that have k results there.
    kth = found.groupBy("dim", "block", "query_row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    kth = kth.groupBy("dim", "block").agg(F.collect_list(F.struct("query_row", "kth")).alias("b"))  # a block's queries
    rest = packed.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where(F.col("shard") != home)
    # Dealt one by one, as a task's work is its pairs of block and shard, whatever their keys; trees join after that.
    rest = rest.join(kth, ["dim", "block"], "left").join(packed, ["dim", "block"]).repartition(_tasks(df, shards * blocks)).join(trees, ["dim", "shard"])
    others = rest.select("*", F.col("b.query_row").alias("bound_rows"), F.col("b.kth").alias("bounds")).drop("b").mapInArrow(search, _FOUND)
    merged = store(found.union(others))
    drop(vecs, trees, packed, found)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return merged.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _tasks(df: DataFrame, units: int) -> int:
    return max(1, min(units, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


ORACLE = """
WITH one AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
             WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM one q JOIN one c ON q.rn <> c.rn AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
