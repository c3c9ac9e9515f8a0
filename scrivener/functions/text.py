"""Unicode-aware string helpers as Spark column expressions.

Spark's one-argument ``trim`` removes only U+0020.  The correction rules trim
every Unicode ``White_Space`` character, so we pass the full set to the
two-argument ``trim`` (a JVM-side code-point scan, no regex).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space property (PropList.txt), in code-point order.
# U+0009..U+000D, U+0020, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.
WHITE_SPACE = "".join(
    chr(c)
    for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# The same set as a DuckDB (RE2) / Java character class, for regex contexts.
WS_CLASS_JAVA = r"\p{IsWhite_Space}"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim Unicode White_Space at both ends."""
    return F.trim(col_(c), F.lit(WHITE_SPACE))


def ultrim(c: Column | str) -> Column:
    return F.ltrim(col_(c), F.lit(WHITE_SPACE))


def urtrim(c: Column | str) -> Column:
    return F.rtrim(col_(c), F.lit(WHITE_SPACE))


def byte_len(c: Column | str) -> Column:
    return F.octet_length(col_(c))


def collapse_ws(c: Column | str) -> Column:
    """Join the whitespace-separated words with single spaces."""
    return F.regexp_replace(utrim(c), WS_CLASS_JAVA + "+", " ")


# The non-ASCII letters that a case-insensitive Unicode regex
# treats as equal to an ASCII letter (dotless i, long s, dotted capital I,
# Kelvin sign), and those ASCII letters.
CASE_FOLD_FROM = "\u0131\u017f\u0130\u212a"
CASE_FOLD_TO = "isik"


def fold_key(c: Column | str) -> Column:
    """Dictionary key of a word: the four letters above mapped to ASCII, then
    lower-cased, so key equality agrees with a case-insensitive regex."""
    return F.lower(F.translate(col_(c), CASE_FOLD_FROM, CASE_FOLD_TO))


def fold_key_py(word: str) -> str:
    return word.translate(str.maketrans(CASE_FOLD_FROM, CASE_FOLD_TO)).lower()


def sql_ws_literal() -> str:
    """The White_Space set as a DuckDB string literal (for oracle SQL)."""
    return "(" + " || ".join(f"chr({ord(ch)})" for ch in WHITE_SPACE) + ")"


def fence(df, cols):
    """Stop predicate pushdown at a block of staged expressions.

    Pushing a filter through a projection substitutes each column's defining
    expression; when every stage refers to its input several times, a filter
    on the last stage would grow exponentially with the number of stages.
    Re-emitting ``cols`` through a one-element ``inline`` makes them
    generator outputs, which no filter is pushed below, while filters on the
    other columns still pass through to the scan.
    """
    from pyspark.sql import functions as F

    others = [c for c in df.columns if c not in cols]
    return df.select(*others, F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))
