"""Corpus-trained corrector (N1-N7): noisy-channel correction with a
deletion-neighbourhood candidate search, as joins, aggregates and windows.

* N1 ``build_lexicon`` — word counts per group (``lang``), counted in Arrow
  batches first (``operators.counts``), so a hot word is collapsed before the shuffle.  All
  words, unless the caller gives a least count.
* N2 ``find_oov`` — distinct input words minus the lexicon (left anti join;
  both sides are distinct on the join key, so there is no hot key).
* N3 ``candidates`` — words and lexicon entries are exploded into themselves
  plus every one-character deletion, equi-joined on (group, variant), and
  de-duplicated.  For a variant of length L at most 26·(L+1)+1 lexicon words
  share it, so every join key has a bounded fan-out; no length cap is needed.
  A shared variant means distance ≤ 2 (insert, delete, substitute, swap).
* N4 score — ``levenshtein`` and corpus frequency.
* N5 ``best`` — per word, the least (distance, −frequency, candidate) as a
  hash aggregate of ``min(struct)`` with partial aggregation.
* N6 ``sample`` — top-k by score (window over a word's bounded candidate
  set), then the arg-max of score/T plus seeded Gumbel noise.
* N7 ``apply_corrections`` — the dictionary join form with N5's output as
  the rule table (it grows with the data, so it is joined, never collected).

Only distinct words are corrected, never each occurrence, which removes the
token skew from the candidate search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from scrivener.operators.counts import spaced, word_counts
from scrivener.operators.dictionary import apply_dictionary_join
from scrivener.operators.generate import _package_by_value
from scrivener.operators.joins import materialize

# Letters of any script, with their combining marks.
WORD_PATTERN = r"[\p{L}\p{M}]+"
NON_WORD_PATTERN = r"[^\p{L}\p{M}]+"
# No bounds on count or length, here and in the SQL of the queries lexicon ...
# sampled_candidate, unless the caller gives them: answers do not depend on the
# size of a table.
DEFAULT_MIN_COUNT = 1
DEFAULT_MIN_LEN = 1
# How many times as frequent a candidate must be, per edit.
DEFAULT_RATIO = 20.0
# Orders candidates like N5 (distance first, then frequency): one distance
# step outweighs any realistic log-frequency difference.
DISTANCE_WEIGHT = 100.0


def words(df: DataFrame, text_col: str = "text", by=("lang",)) -> DataFrame:
    """Every maximal run of WORD_PATTERN letters in the lower-cased text, one
    row each (a split on the complement, empty pieces dropped).  Words never
    span a newline, so a document table and its line table give the same
    words; callers pass whole documents to skip the line split."""
    pieces = F.split(F.lower(F.col(text_col)), NON_WORD_PATTERN)
    return df.select(*by, F.explode(pieces).alias("word")).where(F.col("word") != "")


def build_lexicon(df: DataFrame, text_col: str = "text", by=("lang",), min_count: int = DEFAULT_MIN_COUNT) -> DataFrame:
    """(by..., word, freq) for words seen at least ``min_count`` times."""
    counts = word_counts(df, spaced(F.lower(F.col(text_col))), by)
    return counts if min_count <= 1 else counts.where(F.col("freq") >= min_count)


def find_oov(df: DataFrame, lexicon: DataFrame, text_col: str = "text", by=("lang",),
             min_len: int = DEFAULT_MIN_LEN) -> DataFrame:
    """Distinct (by..., word) of the input that the lexicon lacks."""
    w = build_lexicon(df, text_col, by).select(*by, "word").where(F.length("word") >= min_len)
    return w.join(lexicon.select(*by, "word"), [*by, "word"], "left_anti")


def deletion_variants(w: Column) -> Column:
    """The word itself and each one-character deletion, de-duplicated."""
    dels = F.transform(
        F.sequence(F.lit(1), F.length(w)),
        lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))),
    )
    return F.array_union(F.array(w), dels)


# Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _variant_hashes(words: pa.Array) -> pa.Array:
    """64-bit hashes of each word's deletion variants, as a list of different
    variants.  The hash is a sum over the characters, each times a power for its
    place: without character i it is the sum before i and the sum after i moved
    back by one place, so a word of length L takes O(L) steps."""
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    ends = np.cumsum(sizes)
    start = np.repeat(ends - sizes, sizes)
    powers = np.full(max(int(sizes.max(initial=0)), 1), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    x = chars.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(32))) * powers[np.arange(len(chars)) - start], dtype=np.uint64)])
    whole = upto[ends] - upto[ends - sizes]
    at = np.arange(len(chars))
    less = (upto[at] - upto[start]) + (upto[np.repeat(ends, sizes)] - upto[at + 1]) * np.uint64(_BACK)
    # Of a run of one character any may go: the first stands for all.
    new = np.ones(len(chars), bool)
    new[1:] = (chars[1:] != chars[:-1]) | (start[1:] != start[:-1])
    own = np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])
    n = own[ends] - own[ends - sizes] + 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    out = np.empty(offsets[-1], np.uint64)
    first = np.zeros(len(out), bool)
    first[offsets[:-1]] = True
    out[first], out[~first] = whole, less[new]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.view(np.int64)))


def _with_variants(df: DataFrame) -> DataFrame:
    """``df`` with a row for each ``variant`` of its ``word``."""
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema.fields], StructField("variants", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _variant_hashes(batch.column("word"))], names=schema.names)

    with _package_by_value():
        made = df.where(F.col("word").isNotNull()).mapInArrow(run, schema)
    return made.select(*df.columns, F.explode("variants").alias("variant"))


def _max_len(df: DataFrame, by) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.length("word")).alias("_other_max"))


def _length_compatible(df: DataFrame, other: DataFrame, by) -> DataFrame:
    """Keep words that can share a one-deletion variant with some word of
    ``other``: lengths may differ by at most one.  Exact pruning (no
    candidate is lost); it keeps junk runs of letters, whose variants cost
    O(L²) bytes, out of the variant join.  The bound table has one row per
    group and is joined on the group key (AQE broadcasts it at run time)."""
    bound = _max_len(other, by)
    if by:
        j = df.join(bound, list(by), "inner")
    else:
        limit = bound.first()
        if limit is None or limit["_other_max"] is None:
            return df.limit(0)
        j = df.withColumn("_other_max", F.lit(limit["_other_max"]))
    return j.where(F.length("word") <= F.col("_other_max") + 1).drop("_other_max")


def candidates(oov: DataFrame, lexicon: DataFrame, by=("lang",), ratio: float | None = None) -> DataFrame:
    """N3 + N4: (by..., word, cand, dist, freq).

    With ``ratio``, ``oov`` has how often each word is seen (``own``), and only
    those of ``more_frequent`` are returned; most pairs are dropped where they meet.

    Both inputs are written once to the checkpoint folder: each is read
    several times below (length bounds, pruning, variants), and recomputing
    them would rescan the corpus each time."""
    own = [] if ratio is None else ["own"]
    oov = materialize(oov).select(*by, "word", *own)
    lexicon = materialize(lexicon).select(*by, "word", "freq")
    oov, lexicon = _length_compatible(oov, lexicon, by), _length_compatible(lexicon, oov, by)
    # Pairs meet on hashes of their variants; the few pairs left are then
    # checked to share a variant itself, which words one edit apart always do.
    ov = _with_variants(oov)
    lv = _with_variants(lexicon).withColumnRenamed("word", "cand")
    pairs = ov.join(lv, [*by, "variant"], "inner")
    if ratio is not None:  # other words are one or two edits apart
        least = F.least(*[F.pow(F.lit(float(ratio)), F.lit(d)) for d in (1, 2)])
        pairs = pairs.where((F.col("word") != F.col("cand")) & (F.col("freq") >= least * F.col("own")))
    pairs = pairs.select(*by, "word", *own, "cand", "freq").distinct()
    pairs = pairs.withColumn("dist", F.levenshtein("word", "cand").cast("int"))
    pairs = pairs.where((F.col("dist") <= 1) | F.arrays_overlap(deletion_variants(F.col("word")), deletion_variants(F.col("cand"))))
    if ratio is not None:
        pairs = pairs.where(F.col("freq") >= F.pow(F.lit(float(ratio)), F.col("dist")) * F.col("own"))
    return pairs.select(*by, "word", "cand", "freq", "dist")


def best(cands: DataFrame, by=("lang",)) -> DataFrame:
    """Greedy pick per word: least distance, then highest frequency, then
    the alphabetically first candidate."""
    m = cands.groupBy(*by, "word").agg(
        F.min(F.struct("dist", (-F.col("freq")).alias("nf"), "cand")).alias("b")
    )
    return m.select(*by, "word", F.col("b.cand").alias("cand"), F.col("b.dist").alias("dist"),
                    (-F.col("b.nf")).alias("freq"))


def score(dist: Column, freq: Column) -> Column:
    return F.log(freq.cast("double")) - F.lit(DISTANCE_WEIGHT) * dist


def sample(cands: DataFrame, k: int = 40, temperature: float = 1.0, seed: int = 0, by=("lang",)) -> DataFrame:
    """Top-k by score, then a repeatable draw with probability
    ∝ exp(score/T) (Gumbel-max with noise hashed from seed, word, candidate).
    ``temperature == 0`` is the greedy pick (N5)."""
    if temperature == 0:
        return best(cands, by)
    w = Window.partitionBy(*by, "word").orderBy(F.col("dist"), F.col("freq").desc(), F.col("cand"))
    top = cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # 52 uniform bits that any engine can recompute: md5 of "seed|group|word|candidate".
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(b).cast("string") for b in by], "word", "cand")
    h = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    u = (h.cast("double") + 0.5) / float(1 << 52)
    gumbel = -F.log(-F.log(u))
    keyed = top.withColumn("key", score(F.col("dist"), F.col("freq")) / F.lit(float(temperature)) + gumbel)
    m = keyed.groupBy(*by, "word").agg(F.max_by(F.struct("cand", "dist", "freq"), "key").alias("b"))
    return m.select(*by, "word", F.col("b.cand").alias("cand"), F.col("b.dist").alias("dist"),
                    F.col("b.freq").alias("freq"))


def apply_corrections(df: DataFrame, picks: DataFrame, text_col: str = "text", by=("lang",),
                      key_cols=("doc_id", "line_no"), out: str = "corrected", keep=()) -> DataFrame:
    """(key..., keep..., out): rewrite every line with the picked corrections (whole words,
    case-insensitive; the correction is written in lower case).  The picks
    grow with the data, so they are materialised once and then size-checked
    for the broadcast (the check reads the stored rows, not the upstream plan)."""
    # One pick per (group, word) and words are lower-case: no re-normalising.
    picks = materialize(picks.select(*by, "word", "cand"))
    return apply_dictionary_join(df, picks, text_col, out, key_cols, by=by, typo="word", fixed="cand",
                                 unique_keys=True, words_only=True, keep=keep)


def more_frequent(cands: DataFrame, own: DataFrame, ratio: float = DEFAULT_RATIO, by=("lang",)) -> DataFrame:
    """The candidates, other than the word itself, that are seen at least
    ratio**distance times as often as the word.  ``own`` is (by..., word, own),
    how often each word is seen; a word that it lacks is never seen."""
    known = cands.where("word <> cand").join(own, [*by, "word"], "left")
    least = F.pow(F.lit(float(ratio)), F.col("dist")) * F.coalesce("own", F.lit(0))
    return known.where(F.col("freq") >= least).select(*by, "word", "cand", "freq", "dist")


def train_corrections(df: DataFrame, text_col: str = "text", by=("lang",), ratio: float = DEFAULT_RATIO) -> DataFrame:
    """(by..., word, cand): corrections learned from the text to correct itself.

    Any word may be a typo of a near word that is much more frequent: a
    candidate at distance d must be seen at least ratio**d times as often as
    the word.  The rule compares frequencies only, so it does not depend on
    the size of the corpus, and a typo that is itself common is still
    corrected by a far more common word."""
    return corrections_from_counts(materialize(build_lexicon(df, text_col, by)), ratio, by)


def corrections_from_counts(counts: DataFrame, ratio: float = DEFAULT_RATIO, by=("lang",)) -> DataFrame:
    """``train_corrections`` on word counts (by..., word, freq) taken before."""
    # A candidate is seen ratio times at least: its word is seen once at least.
    return best(candidates(counts.select(*by, "word", F.col("freq").alias("own")), counts.where(F.col("freq") >= ratio), by, ratio), by)


def correct_with_corpus(df: DataFrame, reference: DataFrame, text_col: str = "text", ref_col: str = "text",
                        by=("lang",), min_count: int = 1, min_len: int = 1,
                        temperature: float = 0.0, k: int = 40, seed: int = 0, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """N1-N7 in one call: lexicon from ``reference``, corrections for ``df``.

    Words that ``reference`` lacks, and words in it that a near word exceeds
    ratio**distance times (as in ``train_corrections``), so a misspelling that
    ``reference`` holds too is corrected, at any size of the tables."""
    lex = materialize(build_lexicon(reference, ref_col, by))
    seen = build_lexicon(df, text_col, by).select(*by, "word").where(F.length("word") >= min_len)
    near = candidates(seen, lex.where(F.col("freq") >= min_count), by)
    likely = more_frequent(near, lex.select(*by, "word", F.col("freq").alias("own")), ratio, by)
    return apply_corrections(df, sample(likely, k, temperature, seed, by), text_col, by)
