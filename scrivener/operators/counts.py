"""Words of a text column, in Arrow batches: counted, in pairs, or one row each.

The JVM lower-cases the text and puts a space for what is no letter or mark beyond
ASCII (``spaced``), so words are cut as its regex and case rules say; in ASCII the
worker does the same by a table of bytes.  The batches are cut, numbered
and counted as columns in the worker.  Batches are gathered up to ``HELD_BYTES`` of text before
they are counted, so a worker holds no more than that, and a hot word or pair leaves
it as one row per gathering.  The sums over all workers are a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from scrivener.operators.generate import _package_by_value

HELD_BYTES = 16 << 20
# 16 MB.
MOST_BITS = 1 << 27
# Letters of any script, with their combining marks, are words; all else is not.
NON_ASCII_SIGN = r"[^\x00-\x7F\p{L}\p{M}]"
# ASCII signs become spaces; letters and the bytes of other characters stay.
_SIGNS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def spaced(text: Column) -> Column:
    """``text`` with a space for each character beyond ASCII that is no letter or
    mark; those of ASCII are left to ``_cut``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(F.regexp_replace(text, NON_ASCII_SIGN, " "))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _cut(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(words, row of each) of the last column."""
    text = _one(table.column(table.num_columns - 1))
    text = text if text.offset == 0 else pa.concat_arrays([text])
    valid, offsets, data = text.buffers()
    plain = pa.Array.from_buffers(text.type, len(text), [valid, offsets, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(_SIGNS))], offset=text.offset)
    lists = pc.split_pattern(plain, " ")
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(flat, "")
    return flat.filter(some), row.filter(some).to_numpy()


def _encoded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _groups(table: pa.Table) -> np.ndarray:
    """A number for each row, equal where all columns but the last are."""
    group = np.zeros(table.num_rows, np.int64)
    for i in range(table.num_columns - 1):
        values, code = _encoded(_one(table.column(i)))
        group = np.unique(group * (len(values) + 1) + code, return_inverse=True)[1].reshape(-1)
    return group


def _counted(table: pa.Table, group: np.ndarray, words: pa.Array, columns: list[np.ndarray], row: np.ndarray) -> pa.RecordBatch:
    """The distinct (group, words...) with their count: ``columns`` are places in ``words``, a row each."""
    code = group[row]
    for c in columns[:-1]:
        code = np.unique(code * len(words) + c, return_inverse=True)[1].reshape(-1)
    _, first, n = np.unique(code * len(words) + columns[-1], return_index=True, return_counts=True)
    by = [_one(table.column(i)).take(pa.array(row[first])) for i in range(table.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*by, *[words.take(pa.array(c[first])) for c in columns], pa.array(n.astype(np.int64))],
                                      names=[f"c{i}" for i in range(len(by) + len(columns) + 1)])


def _map(df: DataFrame, run, *added: StructField) -> DataFrame:
    """``df`` without its last column through ``run``, which gives the added columns."""
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema.fields[:-1]], *added])
    names = schema.names

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(names)

    with _package_by_value():
        return df.mapInArrow(named, schema)


def _text(df: DataFrame, columns, text: Column) -> DataFrame:
    return df.select(*columns, text.alias("__text")).where(F.col("__text").isNotNull())


def word_counts(df: DataFrame, text: Column, by) -> DataFrame:
    """(by..., word, freq): how often each word of the spaced ``text`` stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            flat, row = _cut(table)
            words, code = _encoded(flat)
            yield _counted(table, _groups(table), words, [code], row)

    part = _map(_text(df, by, text), run, StructField("word", StringType()), StructField("freq", LongType()))
    return part.groupBy(*by, "word").agg(F.sum("freq").alias("freq"))


def pair_parts(df: DataFrame, text: Column, by, ends: tuple[str, str] | None, out: tuple[str, str, str]) -> DataFrame:
    """``pair_counts`` before the sum: a pair has a row for each gathering that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            flat, row = _cut(table)
            words, code = _encoded(flat)
            new = np.ones(len(row), bool)
            new[1:] = row[1:] != row[:-1]
            before = np.zeros(len(row), np.int64)
            before[1:] = code[:-1]
            if ends is None:
                u, w, of = before[~new], code[~new], row[~new]
            else:
                n, last = len(words), np.append(new[1:], True)[:len(new)]
                before[new] = n
                u, w, of = np.concatenate([before, code[last]]), np.concatenate([code, np.full(int(last.sum()), n + 1, np.int64)]), np.concatenate([row, row[last]])
                words = pa.concat_arrays([words, pa.array(ends, words.type)])
            yield _counted(table, _groups(table), words, [u, w], of)

    return _map(_text(df, by, text), run, StructField(out[0], StringType()), StructField(out[1], StringType()), StructField(out[2], LongType()))


def pair_counts(df: DataFrame, text: Column, by, ends: tuple[str, str] | None, out: tuple[str, str, str]) -> DataFrame:
    """(by..., two words, count; named ``out``): neighbours in the spaced ``text``, and with
    ``ends`` each line's first and last word with the marks of its start and end."""
    part = pair_parts(df, text, by, ends, out)
    return part.groupBy(*by, out[0], out[1]).agg(F.sum(out[2]).alias(out[2]))


def word_bits(words: DataFrame, word: str) -> np.ndarray:
    """A set of the ``words`` in at most ``MOST_BITS`` bits, by the hash of a word: some
    other words seem to be in it."""
    size = 1 << 16
    n = words.count()
    while size < min(16 * n, MOST_BITS):
        size *= 2
    at = F.xxhash64(word).bitwiseAND(F.lit(size - 1).cast("long"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    held = words.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("long").alias("place")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[held.column("place").to_numpy()] = held.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def _among(bits: np.ndarray, words: pa.Array) -> np.ndarray:
    """Which of the words may be in ``word_bits``."""
    h = xxhash.xxh64_intdigest
    at = np.fromiter((h(w.encode(), 42) for w in words.to_pylist()), np.uint64, len(words)) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def words_in_place(df: DataFrame, text: Column, columns, ends: tuple[str, str], most: int | None = None, among: np.ndarray | None = None) -> DataFrame:
    """(columns..., pos, word, prev, next): a row per word of the spaced ``text``, the first
    ``most`` of a line only, with the words on either side (or the marks of the line's ends).
    With ``among`` (``word_bits``) most words that are not in that set are left out."""
    shipped = None if among is None else df.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few batches at a time: every word leaves as a row.
        for batch in batches:
            table = pa.Table.from_batches([batch])
            flat, row = _cut(table)
            at = np.arange(len(row))
            new = np.ones(len(row), bool)
            new[1:] = row[1:] != row[:-1]
            last = np.append(new[1:], True)[:len(new)]
            pos = at - np.maximum.accumulate(np.where(new, at, 0))
            marked = pa.concat_arrays([flat, pa.array(ends, flat.type)])
            wanted = np.ones(len(row), bool) if most is None else pos < most
            if shipped is not None:
                words, code = _encoded(flat)
                wanted &= _among(shipped.value, words)[code] if len(words) else False
            kept = np.flatnonzero(wanted)
            prev, follow = np.where(new, len(flat), at - 1)[kept], np.where(last, len(flat) + 1, at + 1)[kept]
            own = [_one(table.column(i)).take(pa.array(row[kept])) for i in range(table.num_columns - 1)]
            arrays = [*own, pa.array(pos[kept].astype(np.int32)), flat.take(pa.array(kept)), marked.take(pa.array(prev)), marked.take(pa.array(follow))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    return _map(_text(df, columns, text), run, StructField("pos", IntegerType()), *[StructField(c, StringType()) for c in ("word", "prev", "next")])
