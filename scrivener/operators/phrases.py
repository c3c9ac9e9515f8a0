"""Rules of several words, in tables of any size, applied line by line.

One Aho-Corasick automaton of all typos reads a line once, whatever the number
of rules, and the hits are resolved in the line: a hit must begin and end where a
run of word characters does, and of hits that overlap the leftmost, then the
longest, counts.  A rule may be a word, several words with what stands between
them, or signs; it is compared as a case-insensitive Unicode regex would
(``fold_key``).  No line, token or hit is shuffled: only the text column crosses to
a Python worker and back, in Arrow batches.

The automaton is broadcast behind a check of its size in bytes.  Past it, the
rules are cut to those whose first word or sign run occurs in the text (distinct
pieces only are compared); if they are still too many, they are cut into shards of
equal, bounded size, each shard finds its hits in a pass of its own, and the hits
of a line meet by its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.sanitize import TOKEN_PATTERN
from scrivener.functions.text import fold_key, fold_key_py
from scrivener.operators.balance import equal_tasks
from scrivener.operators.dictionary import normalise_rules
from scrivener.operators.generate import _package_by_value
from scrivener.operators.joins import materialize

# An automaton takes some tens of bytes per byte of typo; this bounds the text.
MAX_BYTES = 8 << 20
# Per rule besides its text.
RULE_BYTES = 64

Rules = list[tuple[str, str]]
Hits = list[tuple[int, int, int]]


@lru_cache(maxsize=1 << 14)
def is_word(ch: str) -> bool:
    """Whether a character is one of ``(?U)\\w``."""
    import regex

    return regex.fullmatch(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]", ch) is not None


def build(typos: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, typo in enumerate(typos):
        automaton.add_word(typo, (k, len(typo)))
    if typos:
        automaton.make_automaton()
    return automaton


def folded(text: str) -> str:
    """The text as rules are compared, place by place."""
    low = fold_key_py(text)
    return low if len(low) == len(text) else "".join(f if len(f := fold_key_py(c)) == 1 else c for c in text)


def whole_hits(automaton, text: str) -> Hits:
    """(start, end, rule) of all hits between piece boundaries."""
    found, n = [], len(text)
    if not len(automaton):
        return found
    for last, (k, size) in automaton.iter(folded(text)):
        lo, hi = last + 1 - size, last + 1
        if (lo == 0 or is_word(text[lo - 1]) != is_word(text[lo])) and (hi == n or is_word(text[hi]) != is_word(text[hi - 1])):
            found.append((lo, hi, k))
    return found


def leftmost_longest(hits: Hits) -> Hits:
    out, free = [], 0
    for lo, hi, k in sorted(hits, key=lambda h: (h[0], -h[1])):
        if lo >= free:
            out.append((lo, hi, k))
            free = hi
    return out


def rewritten(text: str, hits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for lo, hi, fixed in hits:
        parts += [text[at:lo], fixed]
        at = hi
    return "".join([*parts, text[at:]])


def _usable(rules: DataFrame, typo: str, fixed: str) -> DataFrame:
    """One rule per folded typo, stored; a null or empty typo and a null fix are no rules."""
    return materialize(normalise_rules(rules, typo, fixed).where("key <> '' and fixed is not null"))


def _size():
    return (F.octet_length("key") + F.octet_length("fixed") + RULE_BYTES).cast("long")


def _bytes(rules: DataFrame) -> int:
    return rules.agg(F.sum(_size())).first()[0] or 0


def _collected(rules: DataFrame) -> Rules:
    """Rules proven small, in order."""
    return [(r["key"], r["fixed"]) for r in rules.orderBy("key").collect()]


def _shards(rules: DataFrame, df: DataFrame, text_col: str, max_bytes: int) -> list[Rules]:
    """The rules that can occur, in lists of bounded size."""
    if _bytes(rules) <= max_bytes:
        return [_collected(rules)]
    first = F.regexp_extract("key", TOKEN_PATTERN, 0)
    present = df.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), F.lit(0)), fold_key))).alias("first")).distinct()
    cut = materialize(rules.withColumn("first", first).join(present, "first", "left_semi"))
    n = -(-_bytes(cut) // max_bytes) or 1
    if n == 1:
        return [_collected(cut)]
    # Runs of rules of equal size; a run passes the mean by one rule at most.
    placed = materialize(equal_tasks(cut.withColumn("size", _size()), "key", "size", n, "shard"))
    return [_collected(placed.where(F.col("shard") == k)) for k in range(n)]


def _column_udf(df: DataFrame, rules: Rules, what: str):
    """An Arrow UDF of a text column: ``text`` rewrites it, ``hits`` lists the
    typos that count, ``spans`` lists all whole hits as (lo, hi, fixed, typo)."""
    shipped = df.sparkSession.sparkContext.broadcast(rules)
    span = "array<struct<lo: int, hi: int, fixed: string, typo: string>>"
    kind = {"text": "string", "hits": "array<string>", "spans": span}[what]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = shipped.value
        automaton = build([t for t, _ in rules])
        for batch in batches:
            out: list = []
            for text in batch.to_pylist():
                if text is None:
                    out.append(None)
                    continue
                hits = whole_hits(automaton, text)
                if what == "spans":
                    out.append([{"lo": lo, "hi": hi, "fixed": rules[k][1], "typo": rules[k][0]} for lo, hi, k in hits])
                    continue
                hits = leftmost_longest(hits)
                out.append([rules[k][0] for _, _, k in hits] if what == "hits" else rewritten(text, [(lo, hi, rules[k][1]) for lo, hi, k in hits]))
            types = {"text": pa.string(), "hits": pa.list_(pa.string()),
                     "spans": pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("fixed", pa.string()), ("typo", pa.string())]))}
            yield pa.array(out, types[what])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def _sharded_spans(df: DataFrame, shards: list[Rules], text_col: str) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, (__row, spans: leftmost-longest over all shards))."""
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    every = None
    for rules in shards:
        with _package_by_value():
            one = numbered.select("__row", F.explode(_column_udf(df, rules, "spans")(F.col(text_col))).alias("s"))
        every = one if every is None else every.union(one)
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col("s.lo").alias("lo"), (-F.col("s.hi")).alias("nhi"), F.col("s.fixed").alias("fixed"), F.col("s.typo").alias("typo")))),
        F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<lo: int, nhi: int, fixed: string, typo: string>>").alias("out")),
        lambda a, h: F.when(h["lo"] >= a["free"], F.struct((-h["nhi"]).alias("free"), F.concat(a["out"], F.array(h)).alias("out"))).otherwise(a),
    )
    return numbered, every.groupBy("__row").agg(taken["out"].alias("spans"))


def apply_phrases(df: DataFrame, rules: DataFrame, text_col: str = "text", out: str = "corrected", typo: str = "typo", fixed: str = "fixed",
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every row of ``df`` with ``out``, the text with all rules applied; null
    stays null."""
    shards = _shards(_usable(rules, typo, fixed), df, text_col, max_bytes)
    if len(shards) == 1:
        with _package_by_value():
            return df.withColumn(out, _column_udf(df, shards[0], "text")(F.col(text_col)))
    numbered, spans = _sharded_spans(df, shards, text_col)
    text = F.col(text_col)
    # What stands before each hit since the last one, its fix, and the rest.
    built = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("s")), lambda a, h: F.struct(
        (-h["nhi"]).alias("at"), F.concat(a["s"], F.substr(text, a["at"] + 1, h["lo"] - a["at"]), h["fixed"]).alias("s")))
    done = F.concat(built["s"], F.substr(text, built["at"] + 1, F.char_length(text)))
    j = numbered.join(spans, "__row", "left")
    return j.select(*[c for c in df.columns if c != out], F.when(F.col("spans").isNull(), text).otherwise(done).alias(out))


def phrase_hits(df: DataFrame, rules: DataFrame, text_col: str = "text", by=("lang",), typo: str = "typo", fixed: str = "fixed",
                max_bytes: int = MAX_BYTES) -> DataFrame:
    """C8 for a rule table: (typo, by..., hits), how often each rule applies."""
    shards = _shards(_usable(rules, typo, fixed), df, text_col, max_bytes)
    if len(shards) == 1:
        with _package_by_value():
            hits = df.select(*by, F.explode(_column_udf(df, shards[0], "hits")(F.col(text_col))).alias("typo"))
    else:
        numbered, spans = _sharded_spans(df, shards, text_col)
        hits = numbered.join(spans, "__row").select(*by, F.explode(F.transform("spans", lambda h: h["typo"])).alias("typo"))
    return hits.groupBy("typo", *by).agg(F.count(F.lit(1)).alias("hits"))
