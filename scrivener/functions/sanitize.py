"""Cleaning of an extracted answer (C1-C5, C7) as column expressions.

All steps are row-local expressions, so they fuse into one whole-stage-codegen
projection right after the scan: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import byte_len, col_, fence, fold_key, fold_key_py, utrim
from scrivener.sources.fixed import DEFAULT_RULES

# Token pattern used by the map form: runs of word characters or of anything
# else, so that joining the pieces gives back the original text.
TOKEN_PATTERN = r"(?U)\w+|\W+"


def unquote(s: Column) -> Column:
    """Drop one pair of matching outer quotes; a lone quote becomes ''."""
    quoted = (s.startswith('"') & s.endswith('"')) | (s.startswith("'") & s.endswith("'"))
    inner = F.substr(s, F.lit(2), F.length(s) - 2)
    return F.when(quoted & (F.length(s) < 2), F.lit("")).when(quoted, inner).otherwise(s)


def drop_commentary(s: Column) -> Column:
    """Cut at '(Note:' (trimmed); else at the first '(' when it starts
    past byte 8 (trimmed); else leave the text as it is."""
    before_note = F.substring_index(s, "(Note:", 1)
    before_paren = F.substring_index(s, "(", 1)
    return (
        F.when(s.contains("(Note:"), utrim(before_note))
        .when(s.contains("(") & (byte_len(before_paren) > 8), utrim(before_paren))
        .otherwise(s)
    )


def rules_regex_chain(s: Column, rules=None) -> Column:
    """C5 for a small dictionary: one case-insensitive whole-word replace per
    rule, behind a single combined guard so lines without any hit skip them."""
    rules = rules or DEFAULT_RULES
    guard = r"(?iU)\b(?:" + "|".join(re.escape(t) for t, _ in rules) + r")\b"
    out = s
    for typo, fixed in rules:
        out = F.regexp_replace(out, r"(?iU)\b" + re.escape(typo) + r"\b", _java_replacement(fixed))
    return F.when(s.rlike(guard), out).otherwise(s)


def rules_token_map(s: Column, rules=None) -> Column:
    """C5/C6 map form: split into word / non-word runs, look each word up in a
    literal map (keys lower-case), join the pieces.  Row-local, no shuffle; for
    dictionaries whose size is bounded (checked by the caller).  Words and
    keys are compared by ``fold_key``, as a case-insensitive regex compares
    them."""
    rules = rules or DEFAULT_RULES
    first = {}
    for t, f in rules:
        first.setdefault(fold_key_py(t), f)
    keys = F.array(*[F.lit(k) for k in first])
    vals = F.array(*[F.lit(v) for v in first.values()])
    lookup = F.map_from_arrays(keys, vals)
    pieces = F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0)
    fixed = F.transform(pieces, lambda p: F.coalesce(F.element_at(lookup, fold_key(p)), p))
    return F.when(s.isNull(), s).otherwise(F.array_join(fixed, ""))


def _matches(pattern: str):
    return lambda h: h.rlike(pattern)


def apply_rules_staged(df, src: str, out: str, rules=None):
    """C5 for a small dictionary, staged: one scan with the combined
    whole-word pattern lists the words that hit, then each rule runs its
    ``regexp_replace`` only on lines where one of those words is that rule's
    typo.  A line usually holds one or two of the typos, so this does a couple
    of regex passes instead of one per rule.

    Hits are compared exactly as the case-insensitive regex compares them:
    for ASCII rule words, by ``lower`` after folding the four letters that
    such a regex equates with ASCII letters; otherwise with the rule's own
    anchored regex."""
    rules = rules or DEFAULT_RULES
    guard = r"(?iU)\b(?:" + "|".join(re.escape(t) for t, _ in rules) + r")\b"
    hits = f"__{out}_hits"
    found = F.regexp_extract_all(F.col(src), F.lit(guard), 0)
    ascii_rules = all(t.isascii() for t, _ in rules)
    if ascii_rules:
        found = F.transform(found, lambda h: fold_key(h))
    df = df.withColumn(hits, found)
    cur = src
    for i, (typo, fixed) in enumerate(rules):
        nxt = f"__{out}_r{i}"
        if ascii_rules:
            present = F.array_contains(F.col(hits), typo.lower())
        else:
            present = F.exists(F.col(hits), _matches(r"(?iU)^" + re.escape(typo) + r"\z"))
        replaced = F.regexp_replace(F.col(cur), r"(?iU)\b" + re.escape(typo) + r"\b", _java_replacement(fixed))
        df = df.withColumn(nxt, F.when(present, replaced).otherwise(F.col(cur)))
        if cur != src:
            df = df.drop(cur)
        cur = nxt
    return df.withColumn(out, F.col(cur)).drop(cur, hits)


def _java_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def sanitize(c: Column | str, rules=None, form: str = "regex") -> Column:
    """Trim, unquote, drop commentary, apply the rules, trim again."""
    s = utrim(col_(c))
    s = unquote(s)
    s = drop_commentary(s)
    s = rules_regex_chain(s, rules) if form == "regex" else rules_token_map(s, rules)
    return utrim(s)


def sanitize_steps(df, src: str, out: str, rules=None, form: str = "regex"):
    """``sanitize`` staged over separate projections, so Catalyst does not
    inline each step's expression into every later reference of it.
    ``rules``: pairs, or a table (typo, fixed) for the automaton form."""
    s1 = f"__{out}_s1"
    s2 = f"__{out}_s2"
    df = df.withColumn(s1, unquote(utrim(F.col(src))))
    df = df.withColumn(s2, drop_commentary(F.col(s1)))
    if isinstance(rules, DataFrame):
        # A rule table of any size, rules of several words included.
        from scrivener.operators.phrases import apply_phrases

        s3 = f"__{out}_s3"
        df = apply_phrases(df, rules, s2, s3)
        df = df.withColumn(out, utrim(F.col(s3))).drop(s3)
    elif form == "regex":
        s3 = f"__{out}_s3"
        df = apply_rules_staged(df, s2, s3, rules)
        df = df.withColumn(out, utrim(F.col(s3))).drop(s3)
    else:
        df = df.withColumn(out, utrim(rules_token_map(F.col(s2), rules)))
    return fence(df.drop(s1, s2), [out])
