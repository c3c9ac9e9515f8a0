"""Candidates where a word limit was lost, put in or moved.

"inthe" for "in the", "al so" for "also", "al ot" for "a lot": a typed word, or two
neighbours, written together is one string.  Every way to cut a string into
two lexicon words is found by a meet of two tables: (string, place, part before) and
(string, place, part after), each joined with the lexicon on the part alone.  Only
distinct strings are cut, and only those that hold a word the lexicon lacks.  A
string of length L has L - 1 cuts, so no key is hot beyond how many strings
begin or end alike, and the lexicon's side of each join is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.operators.counts import pair_counts, pair_parts, word_counts
from scrivener.operators.joins import bounded_broadcast, materialize, row_count_at_most
from scrivener.operators.ngram import spaced_words

# Up to so many words or pairs are broadcast.
FEW_ROWS = 100_000


def neighbours(df: DataFrame, text_col: str = "text", by=("lang",)) -> DataFrame:
    """(by..., u, v, n): distinct pairs of neighbouring words and how often they stand so."""
    return pair_counts(df, spaced_words(F.col(text_col)), by, None, ("u", "v", "n"))


def _cuts(strings: DataFrame, lexicon: DataFrame, by) -> DataFrame:
    """(by..., s, at, a, b, freq_a, freq_b): all cuts of ``strings`` (by..., s) into two lexicon words."""
    places = strings.where(F.char_length("s") > 1).select(*by, "s", F.explode(F.sequence(F.lit(1), F.char_length("s") - 1)).alias("at"))
    part = lambda name: lexicon.select(*by, F.col("word").alias(name), F.col("freq").alias(f"freq_{name}"))
    heads = places.select(*by, "s", "at", F.substr("s", F.lit(1), F.col("at")).alias("a")).join(part("a"), [*by, "a"])
    tails = places.select(*by, "s", "at", F.substr("s", F.col("at") + 1).alias("b")).join(part("b"), [*by, "b"])
    return heads.join(tails, [*by, "s", "at"])


def split_merge_candidates(df: DataFrame, lexicon: DataFrame, text_col: str = "text", by=("lang",), reference: DataFrame | None = None,
                           ref_col: str | None = None) -> DataFrame:
    """(by..., typed, kind, cand, freq, seen) of every typed word, or pair of
    neighbours, that holds a word ``lexicon`` (by..., word, freq) lacks.

    kind ``split``: one word typed for two; ``merge``: two typed for one; ``shift``:
    the limit between two moved.  freq: sightings of the candidate's rarer word;
    seen: how often its words are neighbours in ``reference`` (0 without one, and
    for a merge)."""
    lex = materialize(lexicon.select(*by, "word", "freq"))
    words = word_counts(df, spaced_words(F.col(text_col)), by).select(*by, F.col("word").alias("s"))
    unknown = materialize(words.join(lex.select(*by, F.col("word").alias("s")), [*by, "s"], "left_anti"))
    # Few unknown words are looked for where the pairs are counted; else the distinct pairs meet them.
    few = row_count_at_most(unknown, FEW_ROWS)
    pairs = pair_parts(df, spaced_words(F.col(text_col)), by, None, ("u", "v", "n")).select(*by, "u", "v")
    pairs = pairs if few else materialize(pairs.distinct())

    def lacks(side: str) -> DataFrame:
        one = unknown.select(*by, F.col("s").alias(side), F.lit(True).alias(f"no_{side}"))
        return F.broadcast(one) if few else one

    odd = pairs.join(lacks("u"), [*by, "u"], "left").join(lacks("v"), [*by, "v"], "left").where("no_u or no_v").select(*by, "u", "v").distinct()
    odd = materialize(odd.select(*by, F.concat_ws(" ", "u", "v").alias("typed"), F.concat("u", "v").alias("s"), F.char_length("u").alias("was")))
    strings = materialize(unknown.union(odd.select(*by, "s")).distinct())
    cuts = materialize(_cuts(strings, lex, by))
    two = [F.concat_ws(" ", "a", "b").alias("cand"), F.least("freq_a", "freq_b").alias("freq"), "a", "b"]
    none = F.lit(None).cast("string")
    split = cuts.join(unknown, [*by, "s"]).select(*by, F.col("s").alias("typed"), F.lit("split").alias("kind"), *two)
    shift = cuts.join(odd, [*by, "s"]).where("at <> was").select(*by, "typed", F.lit("shift").alias("kind"), *two)
    merge = odd.join(lex.select(*by, F.col("word").alias("s"), "freq"), [*by, "s"]).select(
        *by, "typed", F.lit("merge").alias("kind"), F.col("s").alias("cand"), "freq", none.alias("a"), none.alias("b"))
    every = split.union(shift).union(merge)
    if reference is None:
        return every.select(*by, "typed", "kind", "cand", "freq", F.lit(0).cast("long").alias("seen"))
    # Of the reference's pairs only those that a candidate is made of are summed.
    every = materialize(every)
    asked = bounded_broadcast(materialize(every.select(*by, "a", "b").where("a is not null").distinct()), FEW_ROWS)
    parts = pair_parts(reference, spaced_words(F.col(ref_col or text_col)), by, None, ("a", "b", "n"))
    known = parts.join(asked, [*by, "a", "b"], "left_semi").groupBy(*by, "a", "b").agg(F.sum("n").alias("seen"))
    return every.join(known, [*by, "a", "b"], "left").select(*by, "typed", "kind", "cand", "freq", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))


def best_boundary(cands: DataFrame, by=("lang",)) -> DataFrame:
    """Per typed string the candidate whose words were seen together most often,
    then the more frequent, then the alphabetically first."""
    pick = cands.groupBy(*by, "typed").agg(F.min(F.struct((-F.col("seen")).alias("ns"), (-F.col("freq")).alias("nf"), "cand", "kind")).alias("b"))
    return pick.select(*by, "typed", F.col("b.kind").alias("kind"), F.col("b.cand").alias("cand"), (-F.col("b.nf")).alias("freq"), (-F.col("b.ns")).alias("seen"))
