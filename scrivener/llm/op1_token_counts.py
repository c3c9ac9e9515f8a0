"""Token counts with overlap resynchronisation for huge texts.

A text of up to ``chunk`` characters is encoded whole.  A longer one is
encoded in chunks that overlap, with offsets, and the chunks are spliced at a
boundary where both encodings are proved to agree with the encoding of the
whole text.  The proof: in byte-level BPE a piece (the unit that merges never
leave) that holds a visible character can hold white space only as its first
character, so white space after a visible character always starts a new
piece, whatever stands elsewhere.  Left of such a place the tokens depend
only on the text left of it, right of it only on the text right of it; special
strings hold no white space, so none lies across it.  If the overlap holds no
such place, or one encoding has no token boundary there, it is doubled until
one is found or the text ends: a text without white space is one piece and is
encoded whole, as it must be.

Rows: one per input row.  Null text counts as empty: 0 bytes, 0 tokens, not
over the limit.  Null ids and repeated rows stay as they are.  Only the two
named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import slices
from scrivener.llm.tokenizer_files import parsed, ship

#: White space after a visible ASCII character, letter or digit.
STABLE = re.compile(r"(?<=[!-~\w])(?=[ \n])")


def splice_count(tok, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text from overlapping chunks."""
    total, start, n = 0, 0, len(text)
    floor = 0  # tokens of the current chunk that start before it are counted already
    left = tok.encode(text[:chunk], add_special_tokens=False)
    end = min(chunk, n)
    while end < n:
        width = overlap
        while True:
            # The next chunk begins inside this one, at an arbitrary character.
            begin = max(floor + 1, end - width)
            stop = min(n, begin + chunk)
            right = tok.encode(text[begin:stop], add_special_tokens=False)
            at = _common_boundary(text, left, start, right, begin, max(begin, floor), end)
            if at is not None:
                break
            if begin == floor + 1:  # no agreement in the whole chunk: make it longer
                end = min(n, end + max(chunk, end - start))
                left = tok.encode(text[start:end], add_special_tokens=False)
                if end == n:
                    return total + _between(left, start, floor, n)
                width = overlap
            else:
                width *= 2
        total += _between(left, start, floor, at)
        start, end, left, floor = begin, stop, right, at
    return total + _between(left, start, floor, n)


def _between(enc, start: int, lo: int, hi: int) -> int:
    return sum(lo <= a + start < hi for a, _ in enc.offsets)


def _common_boundary(text, left, left_at, right, right_at, lo, hi):
    """The last stable place in (lo, hi) at which a token starts in both."""
    ours = {a + left_at for a, _ in left.offsets}
    theirs = {a + right_at for a, _ in right.offsets}
    for m in reversed(list(STABLE.finditer(text, lo + 1, hi))):
        if m.start() in ours and m.start() in theirs:
            return m.start()
    return None


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``df``."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and less than chunk")
    spark = df.sparkSession
    shipped = ship(spark, tokenizer_path)
    src = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = parsed(shipped)
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                n = [0] * len(texts)
                for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
                    n[i] = len(e)
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[i] = splice_count(tok, t, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                     pa.array([x > limit for x in n], pa.bool_())], ["__id", "n_bytes", "n_tokens", "over_limit"])

    out = src.mapInArrow(run, f"__id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("__id", id_col)
