"""Token ids as Parquet list columns, in id order, with selective reads.

``write_tokens`` range-partitions the documents by id, encodes them there and
writes one row per document: id, ``part`` (file order), ``before`` (ids of earlier
documents of the part), ``n_tokens`` and the list column ``ids``.  Parquet's dictionary encoding packs the ids into as few
bits as the page's vocabulary needs (delta encoding, in version 2 of the
format, where a dictionary grows too large); row groups and pages are bounded
in bytes, and page indexes are written, so a reader that wants some documents
or only the counts touches just those pages and columns.

``read_tokens`` gives the documents back with ``start``, the ids of all
documents before them: part totals (the count column alone is read) turn into
offsets, one row per part, and ``before`` is added.  Ids are never shuffled.

Rows: one per input row.  Null text counts as empty and holds just the end
id.  Rows are in order of id, null ids last, rows with equal ids by the text's
md5 and length.  An empty table gives an empty file set.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrivener.llm.common import partitions, released_shuffles, slices
from scrivener.llm.tokenizer_files import parsed, ship
from scrivener.llm.units import Memo

#: The steps before the merges for which ``pieces`` are known.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: All but the characters that NFC leaves alone beside each other and that have one lower-case character at most: visible ASCII,
#: Latin letters up to U+017E without the dotted capital I, and common punctuation.
_OTHER = re.compile("[^\n!-~\u00a1\u00ab\u00b7\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u2010-\u2027]")
_LOWER = "a-z\u00df-\u00f6\u00f8-\u017e"
#: Of lower-cased characters that are none of the others: what the merges see as one word.  Line feeds stand between units.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\n{_LOWER}0-9]+|\n")

_MEMO: dict[int, tuple] = {}


def _memo(shipped) -> tuple:
    """(units -> pieces, memo of the ids of pieces)."""
    key = hash(shipped.value)
    if key not in _MEMO:
        tok = parsed(shipped)
        split = pieces(tok)
        memo = Memo(unit_encoder(tok) if split is None else piece_encoder(tok), len, 128 << 20)
        _MEMO[key] = split or (lambda found: re.findall(r"[^\n]+|\n", found)), memo
    return _MEMO[key]


def pieces(tok):
    """A function text of units (without ASCII white space), a line feed after
    each -> their pieces and the line feeds: the ids of a unit are those of its pieces in
    order, each encoded alone.  A unit of known characters is lower-cased and cut
    as the library does it, so that units that differ in case and punctuation
    share their pieces; any other, and one that holds an added token, is one
    piece as it stands.  None for a tokenizer that works in another way."""
    steps, added = json.loads(tok.to_str()), list(tok.get_added_tokens_decoder().values())
    inside = [t.content for t in added]
    if steps["normalizer"] != _NORMALIZER or steps["pre_tokenizer"] != _PRE_TOKENIZER:
        return None
    # An added token that a single piece could hold would be found in the piece, though not in a unit with capitals.
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) or len(_PIECE.findall(t.content.lower())) < 2 for t in added):
        return None

    def odd(text: str) -> bool:
        return _OTHER.search(text) is not None or any(t in text for t in inside)

    def split(found: str) -> list[str]:
        if not odd(found):
            return _PIECE.findall(found.lower())
        out: list[str] = []
        for u in found.split("\n")[:-1]:
            out += (u, "\n") if odd(u) else _PIECE.findall(u.lower() + "\n")
        return out

    return split


def piece_encoder(tok, block: int = 1024):
    """A function list of pieces (see ``pieces``) -> their ids as bytes.  Pieces
    that the merges see as one word are encoded ``block`` at a time with spaces
    between them and told apart by the library's word numbers, others alone."""

    def encode(found):
        own: dict[str, bytes] = {}
        words = [u for u in found if _PIECE.fullmatch(u) and not _OTHER.search(u)]
        for a in range(0, len(words), block):
            part = words[a: a + block]
            e = tok.encode(" ".join(part), add_special_tokens=False)
            blob = np.array(e.ids, "<i4").tobytes()
            cuts = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            own.update(zip(part, [blob[s:t] for s, t in zip(cuts, cuts[1:])]))
        rest = [u for u in found if u not in own]
        own.update(zip(rest, [np.array(e.ids, "<i4").tobytes() for e in tok.encode_batch_fast(rest, add_special_tokens=False)] if rest else []))
        return [own[u] for u in found]

    return encode


def _ids(found: str, split, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units laid end to end, where each unit's begin and the last one's end)."""
    parts = split(found)
    blobs = [b"" if p == "\n" else b for p, b in zip(parts, map(memo.known.get, parts))]
    new = [i for i, b in enumerate(blobs) if b is None]
    if new:
        get = memo.lookup([[parts[i] for i in new]])
        for i in new:
            blobs[i] = get(parts[i])
    ends = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)))[[i for i, p in enumerate(parts) if p == "\n"]] // 4
    return np.frombuffer(b"".join(blobs), "<i4"), np.append(0, ends)


def unit_encoder(tok, block: int = 1024):
    """A function list of white-space units -> their ids as bytes.

    ``block`` units go through the library in one call, with a special token
    between them: the library cuts a text there before it does anything else, so
    the ids between two such tokens are those of the unit alone.  Units that
    hold an added token themselves, and all units if the vocabulary has no
    special token, are encoded one by one."""
    added = tok.get_added_tokens_decoder()
    mark = next(((i, t.content) for i, t in sorted(added.items()) if t.special and not t.normalized), None)
    inside = [t.content for t in added.values()]

    def alone(found):
        return [np.array(e.ids, "<i4").tobytes() for e in tok.encode_batch_fast(found, add_special_tokens=False)]

    def encode(found):
        if mark is None:
            return alone(found)
        odd = [i for i, u in enumerate(found) if any(t in u for t in inside)]
        own = dict(zip(odd, alone([found[i] for i in odd]))) if odd else {}
        out = []
        for a in range(0, len(found), block):
            part = ["" if i in own else found[i] for i in range(a, min(a + block, len(found)))]
            ids = np.array(tok.encode_batch_fast([f" {mark[1]} ".join(part)], add_special_tokens=False)[0].ids, "<i4")
            cuts, blob = 4 * np.flatnonzero(ids == mark[0]), ids.tobytes()
            out += [blob[s:e] for s, e in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(blob)])]
        for i, value in own.items():
            out[i] = value
        return out

    return encode


def encode_ids(df: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(id, before, n_tokens, ids array<int>) of (id, text): ``before`` counts the
    ids of the documents before it in its partition."""
    shipped = ship(df.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (split, memo), before = _memo(shipped), 0
        for batch in batches:
            for part in slices(batch, 1, 1 << 23):
                # Units are cut at ASCII white space; each different one of the slice is looked up once.
                lists = pc.ascii_split_whitespace(part.column(1))
                units, last = lists.values.dictionary_encode(), np.asarray(lists.offsets).astype(np.int64)
                found = pc.binary_join(pa.ListArray.from_arrays([0, len(units.dictionary)], units.dictionary), "\n")[0].as_py()
                pool, begin = _ids(found + "\n" if len(units.dictionary) else "", split, memo)
                at = np.asarray(units.indices)
                if end_id is not None:
                    at = np.insert(at, last[1:], len(begin) - 1)
                    last = last + np.arange(len(last))
                    pool, begin = np.append(pool, np.int32(end_id)), np.append(begin, len(pool) + 1)
                size = np.diff(begin)[at]
                ends = np.append(0, np.cumsum(size))
                values = pool[np.repeat(begin[at] - ends[:-1], size) + np.arange(ends[-1])]
                offsets = ends[last]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)),
                                                  pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))], ["id", "before", "n_tokens", "ids"])
                before += int(offsets[-1])

    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInArrow(run, f"id {id_type}, before long, n_tokens long, ids array<int>")


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
                 row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Write the token files under ``path``.

    The text is moved to its id range first and encoded there, so that it is
    encoded once and its ids never cross the network."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.select(F.col(id_col).alias("id"), text.alias("text"))
    by = [F.col("id").asc_nulls_last()]
    moved = src.repartitionByRange(partitions(spark), *by).select("id", "text", F.md5("text").alias("tie"))
    moved = moved.sortWithinPartitions(*by, "tie")
    encoded = encode_ids(moved, tokenizer_path, end_id).select("id", F.spark_partition_id().alias("part"), "before", "n_tokens", "ids")
    with released_shuffles(spark):
        (encoded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
         .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes)).option("parquet.page.row.count.limit", "20000")
         .parquet(path))


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) per document, from the files."""
    schema = T.StructType.fromDDL(f"id {id_type}, part int, before bigint, n_tokens bigint, ids array<int>")
    files = spark.read.schema(schema).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("s"))  # one row per part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("off"))
    out = files.join(F.broadcast(offsets), "part")  # as many rows as the shuffle has partitions
    return out.select(F.col("id").alias(id_col), (F.col("off") + F.col("before")).alias("start"), "n_tokens", "ids")


def ids_crc32(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * s: 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["__id", "start", "n_tokens", "ids_crc32"])

    out = df.select(id_col, "start", "n_tokens", "ids").mapInArrow(run, f"__id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("__id", id_col)
