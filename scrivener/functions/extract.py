"""Cut the answer out of a raw model generation.

The extraction is a chain of staged projections over column expressions:

1. ``head``  — text before the earliest end marker (one regex split, E1/E2).
2. ``trimmed`` and the whole-output ``Input:`` branch (E3).
3. the first meaningful line, found with ``filter`` over the split lines (E4),
   its own ``Input:`` prefix handling (E5), and the fallback (E6).

Each stage is its own projection so that Catalyst keeps one evaluation per
sub-expression instead of inlining it into every later reference.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import collapse_ws, fence, utrim
from scrivener.sources.fixed import END_MARKERS, ROLE_MARKERS, SKIP_PREFIXES

END_MARKER_REGEX = "|".join(re.escape(m).replace("\\\n", "\\n") for m in END_MARKERS)

BRANCH_INPUT_PREFIX = "input_prefix"
BRANCH_INPUT_LINE = "input_line"
BRANCH_LINE = "line"
BRANCH_FALLBACK = "fallback"
BRANCH_EMPTY = "empty"


def answer_head(raw: Column) -> Column:
    """The text before the first of the end markers (cutting at each
    marker in turn is the same as cutting once at the earliest)."""
    return F.split(raw, END_MARKER_REGEX, 2).getItem(0)


def _meaningful(line: Column) -> Column:
    skip = F.lit(False)
    for prefix in SKIP_PREFIXES:
        skip = skip | line.startswith(prefix)
    return (line != "") & ~skip


def _after_input(s: Column) -> Column:
    """Trimmed text after a leading 'Input:' (6 characters)."""
    return utrim(F.substr(s, F.lit(7), F.length(s)))


def extract_answers(df: DataFrame, raw_col: str = "raw_output", out: str = "extracted",
                    with_branch: bool = True) -> DataFrame:
    """Add ``out`` (STRING, NULL on failure), ``status`` ('ok' / 'empty_output' /
    'null_input') and optionally ``branch``."""
    h, t, fl = "__head", "__trimmed", "__first_line"
    df = df.withColumn(h, answer_head(F.col(raw_col)))
    df = df.withColumn(t, utrim(F.col(h)))
    lines = F.transform(F.split(F.col(h), "\n"), lambda x: utrim(x))
    df = df.withColumn(fl, F.get(F.filter(lines, _meaningful), 0))

    trimmed, first = F.col(t), F.col(fl)
    whole_input = trimmed.startswith("Input:") & (_after_input(trimmed) != "")
    line_input = first.startswith("Input:") & (_after_input(first) != "")
    branch = (
        F.when(F.col(raw_col).isNull(), F.lit(None))
        .when(whole_input, F.lit(BRANCH_INPUT_PREFIX))
        .when(line_input, F.lit(BRANCH_INPUT_LINE))
        .when(first.isNotNull(), F.lit(BRANCH_LINE))
        .when(trimmed != "", F.lit(BRANCH_FALLBACK))
        .otherwise(F.lit(BRANCH_EMPTY))
    )
    df = df.withColumn("branch", branch)
    b = F.col("branch")
    answer = (
        F.when(b == BRANCH_INPUT_PREFIX, _after_input(trimmed))
        .when(b == BRANCH_INPUT_LINE, _after_input(first))
        .when(b == BRANCH_LINE, first)
        .when(b == BRANCH_FALLBACK, trimmed)
    )
    status = (
        F.when(F.col(raw_col).isNull(), F.lit("null_input"))
        .when(b == BRANCH_EMPTY, F.lit("empty_output"))
        .otherwise(F.lit("ok"))
    )
    df = df.withColumn(out, answer).withColumn("status", status).drop(h, t, fl)
    df = fence(df, ["branch", out, "status"])
    return df if with_branch else df.drop("branch")


# ---------------------------------------------------------------- E7-E10

def first_sentence(c: Column) -> Column:
    """Trimmed; if it holds a '.', the trimmed text up to the first '.'
    plus the '.'."""
    s = utrim(c)
    return F.when(s.contains("."), F.concat(utrim(F.substring_index(s, ".", 1)), F.lit("."))).otherwise(s)


def cut_role_markers(c: Column) -> Column:
    """For each role marker in order, keep the trimmed text before it
    (case-sensitive)."""
    s = c
    for marker in ROLE_MARKERS:
        s = utrim(F.substring_index(s, marker, 1))
    return s


def few_shot_postprocess(df: DataFrame, src: str, out: str) -> DataFrame:
    """E10 = E8 (collapse whitespace) + E9 (role markers) + E7, staged."""
    tmp = f"__{out}_ws"
    df = df.withColumn(tmp, collapse_ws(F.col(src)))
    df = df.withColumn(tmp, cut_role_markers(F.col(tmp)))
    return df.withColumn(out, first_sentence(F.col(tmp))).drop(tmp)
