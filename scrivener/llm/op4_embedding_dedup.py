"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Equal vectors form a class and are compared once.  A unit vector u is
quantised to s * q with whole q in [-127, 127]; e = u - s * q is its error.
For unit vectors u and v

    |u.v - s_u s_v q_u.q_v| <= |s_u q_u| |e_v| + |e_u|

so the int8 product of a tile of vectors with another decides most pairs;
only pairs whose interval holds the threshold are recomputed in double
precision from the vectors as given.

Tiles: every vector goes to its nearest of ``PIVOTS`` sampled vectors, and a
pivot's vectors are dealt to tiles of about ``TILE_ROWS`` by hash.  If all
vectors of one pivot lie within angle r of it and those of another within s,
no two of them are closer than the pivots' angle less r and s; pairs of pivots
too far apart for the threshold are skipped whole.  The sample decides only
what can be skipped, never what is found.  In a table of very many different
lengths, the less frequent ones have no pivots and all their tiles meet.

A tile pair returns sums, not links: how many vectors each class is linked to,
and a spanning forest of its links, at most one row per class each.  So the
output is linear in the rows of the tile pair, however dense the links are.

Rows: one per input row.  A vector that is null, zero or holds a null or
non-finite component links with nothing, not even its copies: 0 links, its own
component.  Rows that share an id are vectors of their own (each counts as a
link of the other if they are close) and one node; vectors of different length
do not link.  A row with a null id links and counts, but is no component id; a
component of null ids only has a null one, and is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import drop, store
from scrivener.llm.components import components
from scrivener.llm.op3_kd_search import finite

TILE_ROWS = 4096
#: Sampled vectors (by smallest hash) whose angles decide which tile pairs are skipped.
PIVOTS = 64
#: Lengths of vectors, the most frequent ones, for which pairs of tiles are skipped.
PLANNED_LENGTHS = 100
#: Far above the rounding of a double product of unit vectors, far below quantisation errors.
SLACK = 1e-9
_STEP = 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise_units(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, length of scale * q, length of the error) per row."""
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((u - back) ** 2).sum(axis=1))


def linked(xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows with cosine >= threshold, some rows of ``xa``
    at a time; for a tile with itself each pair i < j once."""
    ua, ub = _unit(xa), _unit(xb)
    qa, sa, la, ea = quantise_units(ua)
    qb, sb, _, eb = quantise_units(ub)
    # Sums of dim products of up to 127 * 127 are exact in this type.
    kind = np.float32 if xa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fb = qb.astype(kind).T
    for lo in range(0, len(xa), _STEP):
        rows = slice(lo, lo + _STEP)
        about = (qa[rows].astype(kind) @ fb) * sa[rows, None] * sb
        err = la[rows, None] * eb + ea[rows, None] + SLACK
        maybe = about >= threshold - err
        if same:
            maybe &= np.arange(len(xb)) > np.arange(lo, lo + len(about))[:, None]
        i, j = np.nonzero(maybe)
        sure = about[i, j] >= threshold + err[i, j]
        keep = sure.copy()
        check = np.flatnonzero(~sure)
        for k in range(0, len(check), 1 << 16):
            some = check[k: k + (1 << 16)]
            a, b = xa[i[some] + lo], xb[j[some]]
            dot, na, nb = (a * b).sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1)
            keep[some] = dot / (np.sqrt(na) * np.sqrt(nb)) >= threshold
        yield i[keep] + lo, j[keep]


class Forest:
    """Union-find over the rows of two tiles, fed with many links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.root[a], self.root[b]]), axis=1)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in zip(*pairs.tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            to = np.arange(len(self.root))
            for x in up:
                to[x] = top(x)
            self.root = to[self.root]


def _pack(vecs: np.ndarray) -> bytes:
    """In single precision if that loses nothing, else in double."""
    with np.errstate(over="ignore"):
        single = vecs.astype(np.float32)
    return (single if (single == vecs).all() else np.ascontiguousarray(vecs, np.float64)).tobytes()


def _unpack(blob: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(blob) == rows * dim * 4 else np.float64
    return np.frombuffer(blob, kind).astype(np.float64).reshape(rows, dim)


def _tile(t: pa.Table) -> pa.Table:
    dim = t["dim"][0].as_py()
    order = np.argsort(np.asarray(t["cid"]), kind="stable")
    vecs = np.asarray(t["vec"].combine_chunks().flatten()).reshape(-1, dim)[order]
    return pa.table({"tile": pa.array([t["tile"][0].as_py()], pa.string()), "pivot": pa.array([t["pivot"][0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()),
                     "cids": [np.asarray(t["cid"])[order].astype(np.int64).tobytes()], "copies": [np.asarray(t["copies"])[order].astype(np.int64).tobytes()],
                     "vecs": [_pack(vecs)]})


def _products(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                same = r["tile_a"] == r["tile_b"]
                dim = r["dim"]
                ca, cb = (np.frombuffer(r[f"cids_{x}"], np.int64) for x in "ab")
                ma, mb = (np.frombuffer(r[f"copies_{x}"], np.int64) for x in "ab")
                xa, xb = _unpack(r["vecs_a"], len(ca), dim), _unpack(r["vecs_b"], len(cb), dim)
                na, nb = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
                forest = Forest(len(ca) if same else len(ca) + len(cb))
                for i, j in linked(xa, xb, threshold, same):
                    na += np.bincount(i, mb[j], len(ca)).astype(np.int64)
                    nb += np.bincount(j, ma[i], len(cb)).astype(np.int64)
                    forest.join(i, j if same else j + len(ca))
                cids = ca if same else np.concatenate([ca, cb])
                n = na + nb if same else np.concatenate([na, nb])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cids[some]), pa.array(n[some]), pa.array(cids[forest.root[some]])], ["cid", "n", "root"])
    return run


def _pivots(classes: DataFrame, dim: int) -> np.ndarray:
    rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("vec"), "cid").limit(PIVOTS).select("vec").collect()
    return _unit(np.array([r["vec"] for r in rows], np.float64))


def _assign(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds pivot and angle to (cid, copies, vec, dim); 0 for lengths without pivots."""
    shipped = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(3))
            pivot, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            at = np.concatenate([[0], np.cumsum(dims)])
            flat = np.asarray(b.column(2).flatten())
            for dim in np.unique(dims):
                if int(dim) not in shipped.value:
                    continue
                rows = np.flatnonzero(dims == dim)
                x = _unit(flat[at[rows][:, None] + np.arange(dim)])
                cos = x @ shipped.value[int(dim)].T
                pivot[rows] = cos.argmax(axis=1)
                angle[rows] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(angle)], ["cid", "copies", "vec", "dim", "pivot", "angle"])

    return classes.select("cid", "copies", "vec", "dim").mapInArrow(run, "cid long, copies long, vec array<double>, dim int, pivot int, angle double")


def embedding_components(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; threshold in (0, 1]."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = df.sparkSession
    # Doubles throughout; 0.0 and -0.0 are one value.
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    usable = finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec"))
    rows = rows.select("id", F.when(usable, F.col("vec")).alias("vec"))
    grouped = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = store(grouped.select(F.monotonically_increasing_id().alias("cid"), "vec", "copies", "first", F.size("vec").alias("dim")))
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n"))
    dims = [r["dim"] for r in sizes.orderBy(F.col("n").desc(), "dim").limit(PLANNED_LENGTHS + 1).collect()]
    more, dims = len(dims) > PLANNED_LENGTHS, dims[:PLANNED_LENGTHS]
    planned = F.col("dim").isin(dims)
    pivots = {dim: _pivots(classes, dim) for dim in dims}
    near = store(_assign(classes, pivots))
    per = {(r["dim"], r["pivot"]): r for r in near.where(planned).groupBy("dim", "pivot").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()}  # PIVOTS a length
    reach = float(np.arccos(threshold)) + 1e-6
    meets = []
    for dim in dims:
        mine = [(p, a) for (other, p), a in per.items() if other == dim]
        for p, a in mine:
            for q, b in mine:
                if p <= q:
                    apart = float(np.arccos(np.clip(pivots[dim][p] @ pivots[dim][q], -1, 1)))
                    if apart <= a["r"] + b["r"] + reach:
                        meets.append((dim, p, q))
    deal = spark.createDataFrame([(*at, -(-a["n"] // TILE_ROWS)) for at, a in per.items()], "dim int, pivot int, deal long")  # PIVOTS a length
    dealt = near.where(planned).join(F.broadcast(deal), ["dim", "pivot"])
    if more:
        rest = sizes.where(~planned).select("dim", F.ceil(F.col("n") / TILE_ROWS).alias("deal"))
        dealt = dealt.unionByName(near.where(~planned).join(rest, "dim"))
    tiled = dealt.withColumn("tile", F.concat_ws("/", "dim", "pivot", F.pmod(F.xxhash64("cid"), F.col("deal")))).drop("deal")
    tiles = store(tiled.groupBy("tile").applyInArrow(_tile, "tile string, pivot int, dim int, cids binary, copies binary, vecs binary"))
    names = tiles.select("tile", "pivot", "dim")
    meet = spark.createDataFrame(meets, "dim int, p int, q int")  # at most PIVOTS ** 2 rows a length
    if more:
        meet = meet.union(names.where(~planned).select("dim", "pivot", "pivot").distinct())
    left = names.select("dim", F.col("tile").alias("tile_a"), F.col("pivot").alias("p"))
    right = names.select("dim", F.col("tile").alias("tile_b"), F.col("pivot").alias("q"))
    pairs = left.join(meet, ["dim", "p"]).join(right, ["dim", "q"]).where((F.col("p") < F.col("q")) | (F.col("tile_a") <= F.col("tile_b")))
    pairs = store(pairs.select("tile_a", "tile_b"))
    a = tiles.select(F.col("tile").alias("tile_a"), "dim", *[F.col(c).alias(f"{c}_a") for c in ("cids", "copies", "vecs")])
    b = tiles.select(F.col("tile").alias("tile_b"), *[F.col(c).alias(f"{c}_b") for c in ("cids", "copies", "vecs")])
    tasks = max(1, min(pairs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    both = pairs.join(a, "tile_a").join(b, "tile_b").repartition(tasks, "tile_a", "tile_b")
    sums = store(both.mapInArrow(_products(threshold), "cid long, n long, root long"))
    drop(near, tiles, pairs)

    count = sums.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(sums.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    labelled = classes.join(roots, classes["cid"] == roots["node"], "left").join(count, "cid", "left")
    labelled = labelled.select("cid", "vec", "copies", "first", F.coalesce("root", "cid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = store(labelled.join(smallest, "root").select("vec", "n_links", "component_id"))
    drop(classes, roots, sums)
    out = rows.join(labels, "vec", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
            AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(comp.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(comp.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
