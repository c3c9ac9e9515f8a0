"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: words of the text (ASCII letters lower-cased), shingles of
``shingle`` words with repeats, XXH64 of each; a bit is 1 if set in over half
of the hashes.  Documents with one fingerprint form a class; everything below
works on the distinct fingerprints.

Links: a fingerprint is embedded as the counts of its set bits per segment
(``segments`` equal runs of bits).  Changing a bit moves one count by one, so
the Manhattan distance of two embeddings is at most the Hamming distance of
the fingerprints.  Two points of the grid within distance d have a grid point
between them, at most floor(d/2) steps from one and ceil(d/2) from the other:
each fingerprint is sent to the cells within those radii, fingerprints that
meet in a cell are compared bit by bit, and no link is missed.

A cell that holds more than ``crowd`` fingerprints is not compared pair by
pair.  Its members are embedded again with one bit per segment, where the
Manhattan distance is the Hamming distance: those that meet in such a cell
are linked for certain, so a star to its smallest member links them all with
as many rows as members.  That is exact, and linear however large the crowd.

Rows: one per input row.  A null, empty or blank text has no words and
fingerprint zero, which links like any other.  A row with a null id links like
any other, but is no component id; a component of null ids only has a null
one.  Repeated rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import drop, row_tag, slices, spread, store
from scrivener.llm.components import components

SEED = 42
_BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: str) -> Iterator[list[bytes]]:
    """Words of a text, about a block of bytes at a time (cut at white space)."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _BLOCK)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def _hashes(words: list[bytes], shingle: int) -> list[int]:
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, lowest bit first."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[lo: lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += part.sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint."""
    total, ones, carry, joined_any = 0, np.zeros(64, np.int64), [], False
    for words in _word_blocks(text or ""):
        words = carry + words
        if len(words) >= shingle:
            found = np.array(_hashes(words, shingle), np.uint64)
            ones += _set_bits(found)
            total += len(found)
            joined_any = True
            carry = words[len(words) - shingle + 1:]
        else:
            carry = words
    if not joined_any:
        if not carry:
            return 0
        ones += _set_bits(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64))
        total = 1
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """(id, tag, fp long) of every row."""
    src = df.select(F.col(id_col).alias("id"), (F.lit(0).cast("long") if tag is None else tag).alias("tag"), F.col(text_col).alias("text"))
    id_type = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                fps = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], ["id", "tag", "fp"])

    tag_type = src.schema[1].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, tag {tag_type}, fp long")


def _packed(fp: Column, segments: int) -> Column:
    """Set bits per segment, 64 / segments bits each, packed side by side.  A
    segment of w bits has counts 0..w, which need more than w bits only for
    w = 1; that case is the fingerprint itself."""
    width = 64 // segments
    if width == 1:
        return fp
    field = width.bit_length()
    out = F.lit(0).cast("long")
    for i in range(segments):
        count = F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count, i * field))
    return out


def _step(cell: Column, segments: int) -> Column:
    """The cell and its neighbours one step away."""
    width = 64 // segments
    if width == 1:
        return F.array(cell, *[cell.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)])
    field = width.bit_length()
    near = [cell]
    for i in range(segments):
        count = F.shiftrightunsigned(cell, i * field).bitwiseAND(F.lit((1 << field) - 1).cast("long"))
        # Writing the new count by xor keeps the top field clear of arithmetic overflow.
        near += [F.when(ok, cell.bitwiseXOR(F.shiftleft(count.bitwiseXOR(to), i * field))) for ok, to in ((count < width, count + 1), (count > 0, count - 1))]
    return F.array_compact(F.array(*near))


def _ball(cell: Column, radius: int, segments: int) -> Column:
    out = F.array(cell)
    for r in range(radius):
        out = _step(cell, segments) if r == 0 else F.array_distinct(F.flatten(F.transform(out, lambda c: _step(c, segments))))
    return out


def links(classes: DataFrame, max_distance: int, segments: int = 16, crowd: int = 64) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``classes.fp`` that
    suffice for its components: all of those in cells of up to ``crowd``
    fingerprints, a spanning star per crowded place."""
    if segments not in (16, 32, 64) or max_distance < 0:
        raise ValueError("segments must be 16, 32 or 64 and max_distance at least 0")
    near, far = max_distance // 2, (max_distance + 1) // 2
    at = _packed(F.col("fp"), segments)

    def cells(radius: int, seg: int, df: DataFrame = classes) -> DataFrame:
        # The embedding is a column of its own: every neighbour refers to it many times.
        home = df.select("fp", (at if seg == segments else F.col("fp")).alias("home"))
        return home.select("fp", F.explode(_ball(F.col("home"), radius, seg)).alias("cell"))

    crowded = store(cells(far, segments).groupBy("cell").count().where(F.col("count") > crowd).select("cell"))
    few = spread(crowded, crowded.count())
    calm = cells(far, segments).join(few, "cell", "left_anti")
    left = calm if near == far else cells(near, segments)
    a, b = left.select(F.col("fp").alias("a"), "cell"), calm.select(F.col("fp").alias("b"), "cell")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    order = F.col("a") < F.col("b") if near == far else F.col("a") != F.col("b")
    pairs = a.join(spread(b), "cell").where(order & close).select("a", "b")

    members = cells(far, segments).join(few, "cell", "left_semi").select("fp").distinct()
    fine = cells(far, 64, members)
    heads = cells(near, 64, members).groupBy("cell").agg(F.min("fp").alias("a"))
    stars = fine.join(spread(heads), "cell").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _rooted(docs: DataFrame, max_distance: int, segments: int, crowd: int) -> DataFrame:
    """(fp, first: smallest id of the fingerprint, root: of its component), stored."""
    classes = store(docs.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(classes, max_distance, segments, crowd))
    out = store(classes.join(spread(roots, roots.count()), classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    drop(classes, roots)
    return out


def simhash_components(df: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
                       segments: int = 16, crowd: int = 64) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    docs = store(fingerprints(df, shingle, id_col, text_col))
    rooted = _rooted(docs, max_distance, segments, crowd)
    n = rooted.count()
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = docs.join(spread(rooted.join(spread(smallest, n), "root").select("fp", "component_id"), n), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
             segments: int = 16, crowd: int = 64) -> DataFrame:
    """The rows of ``df`` that stand for their component: of each the row with
    the smallest id (null last), of rows with that id one (by two hashes
    of all columns), once."""
    tag = row_tag(df)
    docs = store(fingerprints(df, shingle, id_col, text_col, tag))
    rooted = _rooted(docs, max_distance, segments, crowd)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
    kept = docs.join(spread(rooted.select("fp", "root"), rooted.count()), "fp").groupBy("root").agg(F.min(order).alias("one")).select("one.id", "one.tag")
    kept = kept.select(F.col("id").alias("__kept_id"), F.col("tag").alias("__kept_tag"))
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__id"), tag.alias("__tag"))
    same = (F.col("__tag") == F.col("__kept_tag")) & F.col("__id").eqNullSafe(F.col("__kept_id"))
    return tagged.join(kept, same, "left_semi").dropDuplicates(["__tag", "__id"]).select("__row.*")
