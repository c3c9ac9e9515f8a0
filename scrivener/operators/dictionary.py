"""Dictionary correction for rule tables of any size (C6) and rule-hit counts.

Three physical forms, picked by the size of the rule table:

* **map form** — the rule table is proven small (row-count check), read once
  and inlined as a literal ``MAP`` in a ``transform`` over the line's
  pieces.  Row-local: no shuffle of the line table at all.
* **lookup form** — rules proven to be a few MB, derived tables among them: the
  pieces are looked up row by row in a broadcast table (``operators.lookup``).
* **head form** — for rule tables past that bound (derived tables grow
  with the data, such as corpus-trained corrections): the pieces of the text are
  counted; the most frequent, with their rule or none, are looked up row by row, and
  only the rare ones, a few hundredths of the text, are joined with the rules.
* **join form** — if the caller sets a bound on broadcasts: the pieces are
  ``posexplode``d where the line is and probed against the rules; only the
  hits ``(line, word position, fix)`` are shuffled, gathered into a small
  position → fix map per line, joined back to the lines and applied
  row-locally.  The rules side is broadcast only behind a size check; past
  it, the rules are first cut to those whose word occurs in the corpus
  (distinct words, pre-aggregated map-side, semi-joined), which is then
  broadcast if small enough, else joined by shuffle with AQE skew handling
  splitting a hot word on the token side.

All forms probe every piece of ``TOKEN_PATTERN``, word runs and the runs
between them, with one rule per folded typo; a null typo is no rule.  For
rules that are words this gives the same text as the chained whole-word
regexes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.sanitize import TOKEN_PATTERN, rules_token_map
from scrivener.functions.text import fold_key
from scrivener.operators.joins import bounded_broadcast, materialize, row_count_at_most
from scrivener.operators.lookup import MAX_BYTES, absent, head, log_rank, rewrite, small_table

# A literal map is searched linearly per lookup, so the map form is kept
# for small rule tables; larger ones take the join form.
MAX_MAP_RULES = 1_000
WORD_RUN = r"(?U)\w+"


def normalise_rules(rules: DataFrame, typo: str = "typo", fixed: str = "fixed", by=()) -> DataFrame:
    """One rule per (group, folded typo): the smallest fixed value, so the
    result does not depend on input order.  A null typo is no rule."""
    return (
        rules.select(*by, fold_key(typo).alias("key"), F.col(fixed).alias("fixed"))
        .where(F.col("key").isNotNull())
        .groupBy(*by, "key")
        .agg(F.min("fixed").alias("fixed"))
    )


def apply_dictionary_join(df: DataFrame, rules: DataFrame, text_col: str = "text", out: str = "corrected",
                          key_cols=("doc_id", "line_no"), max_broadcast_rows: int | None = None,
                          by=(), typo: str = "typo", fixed: str = "fixed",
                          unique_keys: bool = False, words_only: bool = False, max_bytes: int = MAX_BYTES, keep=()) -> DataFrame:
    """C6 join form: returns ``(*key_cols, *keep, out)`` for every input row.  With
    ``by`` (e.g. ``lang``) the rules are per group and matched on group + word.
    ``unique_keys`` says the rules already hold one lower-case row per key
    (no normalising aggregate needed).  ``words_only`` says that every typo is a
    word, so that only word runs need probing.

    Rules of at most ``max_bytes`` are looked up row by row
    (``apply_dictionary_lookup``), of larger ones those of the frequent words
    (``apply_dictionary_head``); any are joined if ``max_broadcast_rows`` is given.

    Plan of the join: the line's pieces are exploded where the line is and probed against
    the rules (a broadcast hash join when the rules are proven small); only
    the hits, ``(key, position, fix)``, are shuffled and gathered into one
    small position → fix map per line; that map is joined back to the lines
    and applied row-locally.  The lines themselves cross the network at most
    once, and not at all when AQE finds the hit table small enough to
    broadcast.
    """
    keys = list(key_cols)
    # Word and non-word runs alternate, so word k is piece 2k + off, where
    # off is 1 when the text starts with a non-word run (one test per line).
    off = F.when(F.col(text_col).rlike(r"(?U)^\w"), F.lit(0)).otherwise(F.lit(1))
    runs = F.lit(WORD_RUN if words_only else TOKEN_PATTERN)
    words = df.select(*keys, *by, off.alias("_off"), F.posexplode(F.regexp_extract_all(F.col(text_col), runs, 0)).alias("k", "tok"))
    if unique_keys:
        r = rules.select(*by, fold_key(typo).alias("key"), F.col(fixed).alias("fixed"))
    else:
        r = normalise_rules(rules, typo, fixed, by)
    if max_broadcast_rows is None:
        done = apply_dictionary_lookup(df, r, text_col, out, by, max_bytes)
        if done is not None:
            return done.select(*keys, *keep, out)
        return apply_dictionary_head(df, r, text_col, out, keys, by, words_only, max_bytes, keep)
    if row_count_at_most(r, max_broadcast_rows):
        r = F.broadcast(r)
    else:
        # Too many rules to broadcast: keep only the rules whose word occurs.
        # The distinct words are pre-aggregated map-side (a hot word is
        # collapsed before the shuffle) and the semi join has unique keys on
        # both sides; the rules that remain are usually few enough to
        # broadcast, otherwise the probe below is a shuffle join that AQE's
        # skew handling splits.
        present = words.select(*by, fold_key("tok").alias("key")).distinct()
        r = bounded_broadcast(materialize(r.join(present, [*by, "key"], "left_semi")), max_broadcast_rows)
    cond = fold_key(words["tok"]) == r["key"]
    for b in by:
        cond = cond & (words[b] == r[b])
    piece_no = (F.col("k") * 2 + F.col("_off") if words_only else F.col("k")).cast("int")
    hits = words.join(r, cond, "inner").select(*[words[k] for k in keys], piece_no.alias("p"), "fixed")
    per_line = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("p", "fixed"))).alias("_fix"))
    j = df.select(*dict.fromkeys([*keys, *keep, text_col])).join(per_line, keys, "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), 0)
    rebuilt = F.array_join(F.transform(pieces, lambda t, i: F.coalesce(F.element_at(F.col("_fix"), i), t)), "")
    text = F.when(F.col("_fix").isNull(), F.col(text_col)).otherwise(rebuilt)
    return j.select(*keys, *keep, text.alias(out))


def _group(by) -> Column:
    """What stands before a piece in the key of a lookup."""
    return F.concat(F.lit(""), *[part for b in by for part in (F.col(b).cast("string"), F.lit("\0"))])


def apply_dictionary_head(df: DataFrame, rules: DataFrame, text_col: str, out: str, keys: list[str], by=(), words_only: bool = False,
                          max_bytes: int = MAX_BYTES, keep=()) -> DataFrame:
    """C6 head form: (keys..., keep..., out) for normalised rules (by..., key, fixed) of
    any size; ``keys`` tell the rows apart."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(WORD_RUN if words_only else TOKEN_PATTERN), F.lit(0))
    src = df.select(*dict.fromkeys([*keys, *keep, text_col]), _group(by).alias("_group"))
    counts = src.select("_group", F.explode(runs).alias("tok")).groupBy(F.concat("_group", fold_key("tok")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    keyed = rules.select(F.concat(_group(by), "key").alias("key"), "fixed")
    known = materialize(counts.where(F.col("key").isNotNull()).join(keyed, "key", "left"))
    first, _ = head(known, "key", "fixed", -log_rank(F.col("n")), max_bytes)
    # A folded form may differ between Python and the JVM, so the rare pieces meet all rules that occur.
    rare = src.select(*keys, "_group", text_col, runs.alias("_runs")).withColumn("_at", absent(df, first, F.col("_runs"), F.col("_group")))
    asked = rare.select(*keys, "_group", text_col, "_runs", F.explode("_at").alias("_k"))
    # Word and other runs alternate: word k is piece 2k, or 2k + 1 after a leading other run.
    piece = F.col("_k") * 2 + F.when(F.col(text_col).rlike(r"(?U)^\w"), F.lit(0)).otherwise(F.lit(1)) if words_only else F.col("_k")
    asked = asked.select(*keys, piece.cast("int").alias("p"), F.concat("_group", fold_key(F.get("_runs", F.col("_k")))).alias("key"))
    hits = asked.join(known.where(F.col("fixed").isNotNull()).select("key", "fixed"), "key")
    per_line = hits.groupBy(*keys).agg(F.collect_list(F.struct("p", "fixed")).alias("_fix"))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), F.lit(0))
    j = src.join(per_line, keys, "left")
    return j.select(*keys, *keep, rewrite(df, first, pieces, F.col("_group"), F.col("_fix.p"), F.col("_fix.fixed")).alias(out))


def apply_dictionary_lookup(df: DataFrame, rules: DataFrame, text_col: str, out: str, by=(), max_bytes: int = MAX_BYTES) -> DataFrame | None:
    """C6 lookup form: ``df`` with ``out``, for normalised rules (by..., key,
    fixed); None if they are larger than ``max_bytes``."""
    group = _group(by)
    found = small_table(rules.select(F.concat(group, "key").alias("key"), "fixed"), "key", "fixed", max_bytes)
    if found is None:
        return None
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), F.lit(0))
    return df.withColumn(out, rewrite(df, found, pieces, group))


def apply_dictionary(df: DataFrame, rules: DataFrame, text_col: str = "text", out: str = "corrected",
                     max_map_rules: int = MAX_MAP_RULES) -> DataFrame:
    """Pick the map form when the rule table is proven small, else the join
    form; both return every row of ``df`` with ``out``."""
    if row_count_at_most(rules, max_map_rules):
        pairs = normalise_rules(rules).collect()  # at most max_map_rules rows, checked above
        if not pairs:
            return df.withColumn(out, F.col(text_col))
        mapped = rules_token_map(F.col(text_col), [(p["key"], p["fixed"]) for p in pairs])
        return df.withColumn(out, mapped)
    done = apply_dictionary_lookup(df, materialize(normalise_rules(rules)), text_col, out)
    if done is not None:
        return done
    # The join form needs one key per row: rows get a number of their own, in a
    # stored copy, so null and repeated keys come back as they went in.
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    joined = apply_dictionary_join(numbered, rules, text_col, out, ("__row",))
    return numbered.join(joined, "__row").select(*[c for c in df.columns if c != out], out)


def rule_hits(df: DataFrame, rules, text_col: str = "text", by=("lang",)) -> DataFrame:
    """How often each rule fires, per group.  Only the hits are exploded
    (one combined whole-word regex), then counted with map-side partial
    aggregation; the line table is never exploded into all its tokens."""
    pattern = r"(?iU)\b(?:" + "|".join(re.escape(t) for t, _ in rules) + r")\b"
    hits = df.select(*by, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("hit"))
    return hits.groupBy(fold_key("hit").alias("typo"), *by).agg(F.count(F.lit(1)).alias("hits"))
