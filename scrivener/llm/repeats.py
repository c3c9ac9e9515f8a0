"""Which fixed-length windows of a document also start in an earlier one.

Shared by the two substring operators; they differ in what a symbol is (byte
or word) and in the index that resolves a shard.

Windows that are equal must meet without moving the texts:

1. A window's *anchor* is the smallest hash among its ``gram``-symbol grams,
   so equal windows have equal anchors.  Consecutive windows of one anchor
   form a *segment* (at most as many windows as a window has grams, so its
   first and last window together hold all of its symbols).
2. Anchors seen in one document only cannot repeat.  Every segment is dealt by
   its anchor once, as a hash of its content, document and place, no text; the
   smallest and largest id of each anchor come from that one shuffle, and the
   segments of anchors in more than one document are stored.
3. Segments are grouped by anchor and content: a group is resolved once, by
   the smallest id in it.  One copy of each is cut from its text and sent to a
   shard by its anchor.
4. A shard (a few MB) builds its index over its segments and returns for each
   window the smallest id that holds it, in runs.  An anchor with more than
   ``crowd`` different segments would outgrow a shard: its windows are grouped
   by their own 128-bit hash instead, which splits evenly and combines
   map-side.
5. The runs go back to all places of the segment; a window is repeated if the
   smallest id that holds it is smaller than the document's own.

Content is compared by 128-bit hashes when places are grouped, and symbol by
symbol in the index.  Ids are whole numbers; a null id counts as larger than
any other.  Rows that share an id are not earlier than each other.  Rows alike
in id and text get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import drop, slices, store

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LAST = (1 << 63) - 1
#: Symbols per work block of a task and bytes per shard.
_BLOCK = 1 << 17
#: A segment's place is packed as first window * PLACE + number of windows (fewer than PLACE).
PLACE = 256
SHARD_BYTES = 2 << 20
#: Crowded anchors that are broadcast at most.
MOST_CROWDED = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _M1
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _mix(a * _M2 + (b ^ np.uint64(salt)))


def gram_hashes(symbols: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """64-bit hashes of all runs of each length, from hashes of runs of half the
    length (a run that is no power of two is covered by two that overlap)."""
    with np.errstate(over="ignore"):
        cur, size, out = _mix(symbols * _M1 + np.uint64(7)), 1, {}
        for want in sorted(lengths):
            while 2 * size <= want:
                n = max(0, len(cur) - size)
                cur = _pair(cur[:n], cur[size: size + n], size)
                size *= 2
            n = max(0, len(cur) - (want - size))
            out[want] = cur if want == size else _pair(cur[:n], cur[want - size: want - size + n], want)
    return [out[x] for x in lengths]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    d = width - size
    return x if d == 0 else (np.minimum(x[:-d], x[d:]) if len(x) > d else x[:0])


def segments(parts: list[np.ndarray], window: int, gram: int, content: bool = True) -> tuple[np.ndarray, ...]:
    """(part, first window, windows, anchor, content hash) of each segment."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts).astype(np.uint64)
    if len(flat) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams, full = gram_hashes(flat, gram, window)
    anchor = sliding_min(grams, window - gram + 1)
    n, ends = len(anchor), np.cumsum(lens)
    part = np.repeat(np.arange(len(parts)), lens)[:n]
    inside = np.arange(n) + window <= ends[part]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1]))
    # A run of equal anchors is cut after every window - gram + 1 windows, or as many as a place can hold.
    run = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    first = np.flatnonzero(since % min(window - gram + 1, PLACE - 1) == 0)
    count = np.diff(np.append(first, n))
    keep = inside[first]
    first, count = first[keep], count[keep]
    with np.errstate(over="ignore"):
        same = _pair(full[first], full[first + count - 1], 11) + count.astype(np.uint64) if content else full[:0]
    of = part[first]
    return of, first - (ends - lens)[of], count, anchor[first].view(np.int64), same.view(np.int64)


Symbols = Callable[[str], np.ndarray]


def _scan(docs: DataFrame, symbols: Symbols, window: int, gram: int, block: int = _BLOCK) -> DataFrame:
    """All segments: anchor, content hash, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, block):
                ords, tags = np.asarray(some.column(0)), np.asarray(some.column(1))
                parts, owner, at, held = [], [], [], 0
                for i, text in enumerate(some.column(2).to_pylist()):
                    found = symbols(text or "")
                    # A long text is cut into pieces that share window - 1 symbols: every window is in one piece.
                    for lo in range(0, max(1, len(found) - window + 1), block):
                        parts.append(found[lo: lo + block + window - 1])
                        owner.append(i)
                        at.append(lo)
                        held += len(parts[-1])
                        if held >= block:
                            yield out(parts, owner, at, ords, tags)
                            parts, owner, at, held = [], [], [], 0
                if parts:
                    yield out(parts, owner, at, ords, tags)

    def out(parts, owner, at, ords, tags) -> pa.RecordBatch:
        of, first, count, anchor, same = segments(parts, window, gram)
        own = np.asarray(owner)[of]
        place = (first + np.asarray(at)[of]) * PLACE + count
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(same), pa.array(ords[own]), pa.array(tags[own]), pa.array(place)], ["anchor", "same", "ord", "tag", "place"])

    return docs.select("ord", "tag", "text").mapInArrow(run, "anchor long, same long, ord long, tag long, place long")


def keyed(df: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """(row, text, ord, tag): ``ord`` orders documents, (ord, tag) tells rows
    apart; ``row`` is what to carry along, the id unless given.  The tag is 0 in
    a table whose ids do not repeat; else the table is stored and the tag is the
    row's number in the stored copy, so that no two rows are taken for one."""
    ord_ = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    again = df.select(ord_.alias("ord")).groupBy("ord").count().where("count > 1").limit(1).count()
    number = F.monotonically_increasing_id() if again else F.lit(0).cast("long")
    out = df.select((F.col(id_col) if row is None else row).alias("row"), F.col(text_col).alias("text"), ord_.alias("ord"), number.alias("tag"))
    return store(out) if again else out


def _cut(wanted: DataFrame, docs: DataFrame, pieces: Callable, window: int) -> DataFrame:
    """The content of segments: ``wanted`` holds (ord, tag, list of (place,
    anchor, same, first, last, crowded)).  Crowded segments become one row per
    window, with the 128-bit hash of the window for shard and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = part.column(1)
                row = dict(zip((f.name for f in found.type.value_type), found.flatten().flatten()))
                lo, n = np.divmod(np.asarray(row["place"]).astype(np.int64), PLACE)
                hi = (lo + n + window - 1).tolist()
                lo, ends, at, body = lo.tolist(), np.cumsum(_lengths(found)).tolist(), 0, []
                for text, end in zip(part.column(0).to_pylist(), ends):
                    cut = pieces(text or "")
                    body += [cut(a, b) for a, b in zip(lo[at:end], hi[at:end])]
                    at = end
                yield pa.RecordBatch.from_arrays([row["anchor"], row["same"], pa.array(n, pa.int32()), row["first"], row["last"], row["crowded"], pa.array(body, pa.binary())],
                                                 ["anchor", "same", "n", "first", "last", "crowded", "body"])

    joined = docs.join(wanted, ["ord", "tag"]).select("text", "wanted")
    return joined.mapInArrow(run, "anchor long, same long, n int, first long, last long, crowded boolean, body binary")


Resolve = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def _runs(n: np.ndarray, least: np.ndarray) -> pa.ListArray:
    """Per segment a list of (from, to, least) over its windows."""
    seg = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n) - n
    new = np.append(True, (seg[1:] != seg[:-1]) | (least[1:] != least[:-1])) if len(seg) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(seg))
    of = seg[a]
    entry = pa.StructArray.from_arrays([pa.array(a - starts[of], pa.int64()), pa.array(b - starts[of], pa.int64()), pa.array(least[a], pa.int64())], ["lo", "hi", "least"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), entry)


_RUNS = "anchor long, same long, last long, runs array<struct<lo: long, hi: long, least: long>>"


def _resolve(cut: DataFrame, resolve: Resolve, shards: int) -> DataFrame:
    """Index all segments of a shard."""

    def run(t: pa.Table) -> pa.Table:
        n, first = np.asarray(t["n"]).astype(np.int64), np.asarray(t["first"]).astype(np.int64)
        least = resolve(t["body"].to_pylist(), n, first)
        return pa.table({"anchor": t["anchor"], "same": t["same"], "last": t["last"], "runs": _runs(n, least)})

    keyed_by = cut.where("NOT crowded").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    return keyed_by.groupBy("shard").applyInArrow(run, _RUNS)


def _resolve_crowded(cut: DataFrame, windows: Callable) -> DataFrame:
    """Every window of a crowded anchor by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one, two = windows(b.column(3)[k].as_py(), b.column(2)[k].as_py())
                m = len(one)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * m, pa.int64()), pa.array([b.column(1)[k].as_py()] * m, pa.int64()), pa.array(np.arange(m, dtype=np.int64)),
                                                  pa.array(one), pa.array(two), pa.array([b.column(4)[k].as_py()] * m, pa.int64()), pa.array([b.column(5)[k].as_py()] * m, pa.int64())],
                                                 ["anchor", "same", "at", "one", "two", "first", "last"])

    each = cut.where("crowded").select("anchor", "same", "n", "body", "first", "last").mapInArrow(run, "anchor long, same long, at long, one long, two long, first long, last long")
    least = each.groupBy("one", "two").agg(F.min("first").alias("least"))
    back = each.join(least, ["one", "two"]).groupBy("anchor", "same")  # a segment's own windows
    return back.agg(F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "least"))).alias("runs"))


def repeated_spans(docs: DataFrame, symbols: Symbols, pieces: Callable, resolve: Resolve, windows: Callable, window: int, gram: int,
                   crowd: int = 20_000, block: int = _BLOCK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(ord, tag, spans): per document of ``docs`` (from ``keyed``) the symbol
    ranges (lo, hi) of its repeated windows, in no order.  Documents without any
    are absent.  ``block``: symbols per work block of a task; longer texts are
    cut into pieces.  ``shard_bytes``: content of a shard, about."""
    every = _scan(docs, symbols, window, gram, block).repartition("anchor")
    # ``read`` takes in the other columns: with the same columns on both sides of the join, both read one shuffle of one scan.
    ends = every.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.bit_xor(F.expr("same ^ tag ^ place")).alias("read"))
    shared = ends.where("a < b AND read IS NOT NULL").select("anchor")
    places = store(every.join(shared.hint("shuffle_hash"), "anchor"))  # one row an anchor, so what is hashed has no large groups
    # Any one of the places serves for the content: all three values are those of one row.
    rep = [F.first(c).alias(f"rep_{c}") for c in ("ord", "tag", "place")]
    groups = store(places.groupBy("anchor", "same").agg(*rep, F.min("ord").alias("first"), F.max("ord").alias("last")))
    many = store(groups.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd))
    # At most one anchor for every ``crowd`` rows, broadcast but for a table of very many.
    few = F.broadcast(many) if many.count() <= MOST_CROWDED else many
    several = groups.join(few, "anchor", "left").withColumn("crowded", F.col("kinds").isNotNull())
    content = F.struct(F.col("rep_place").alias("place"), "anchor", "same", "first", "last", "crowded")
    # A document's segments are in as many partitions as it has anchors: they are dealt by document as they are, not as lists of one.
    wanted = several.select(F.col("rep_ord").alias("ord"), F.col("rep_tag").alias("tag"), content.alias("one")).repartition("ord", "tag")
    wanted = wanted.groupBy("ord", "tag").agg(F.collect_list("one").alias("wanted"))
    cut = store(_cut(wanted, docs, pieces, window))
    drop(groups, many)
    size = cut.agg(F.sum(F.octet_length("body")).alias("s"), F.max("crowded").alias("c")).first()
    resolved = _resolve(cut, resolve, max(1, (size["s"] or 0) // shard_bytes))
    if size["c"]:
        resolved = resolved.union(_resolve_crowded(cut, windows))
    # Groups without a document that comes after the first holder of one of their windows remove nothing.
    known = store(resolved.where(F.exists("runs", lambda r: r["least"] < F.col("last"))).drop("last"))
    drop(cut)
    back = places.join(known.hint("shuffle_hash"), ["anchor", "same"])
    hits = back.select("ord", "tag", F.floor(F.col("place") / PLACE).alias("start"), F.explode(F.filter("runs", lambda r: r["least"] < F.col("ord"))).alias("r"))
    hits = hits.select("ord", "tag", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") + (window - 1)).alias("hi"))
    spans = store(hits.repartition("ord", "tag").groupBy("ord", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))  # a row's own
    drop(places, known)
    return spans


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def merged(spans: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Per row the sorted maximal ranges of its list of (lo, hi), none for a
    null; ranges that touch are one."""
    n = _lengths(spans)
    flat = dict(zip((f.name for f in spans.type.value_type), spans.flatten().flatten()))
    lo, hi = (np.asarray(flat[c]).astype(np.int64) for c in ("lo", "hi"))
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(n))]
    if len(lo) == 0:
        return out
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((lo, of))
    of, lo, hi = of[order], lo[order], hi[order]
    # The furthest end so far in the row; rows are set apart by more than any end.
    apart = of * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + apart) - apart
    new = np.append(True, (of[1:] != of[:-1]) | (lo[1:] > reach[:-1]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(lo)) - 1
    for i, a, b in zip(of[begin].tolist(), lo[begin].tolist(), reach[end].tolist()):
        out[i].append((a, b))
    return out
