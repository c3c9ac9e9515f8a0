"""Prompts with per-group example sets (P2) and example counts.

The mutable example list of a single prompt template becomes a table of
examples keyed by a group column (for instance ``lang``).  Each group's
examples are rendered once into a header string by an aggregation over the
(small) examples table, and the headers reach the line table through a
size-checked broadcast join: the line table is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.prompts import example_block, few_shot_prompt
from scrivener.operators.joins import bounded_broadcast
from scrivener.sources.fixed import PROMPT_HEADER

def group_headers(examples: DataFrame, by: str) -> DataFrame:
    """(by, header): header text of each group's examples in ``ord`` order.
    A header is one prompt's text, so a group is as large as the user's prompt."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "typo", "fixed")))
    body = F.array_join(F.transform(ordered, lambda e: example_block(e["typo"], e["fixed"])), "")
    return examples.groupBy(by).agg(F.concat(F.lit(PROMPT_HEADER), body).alias("header"))


def render_few_shot_by(df: DataFrame, examples: DataFrame, by: str, text_col: str = "text",
                       out: str = "prompt") -> DataFrame:
    """Prompt per row with its group's examples; a group without
    examples gets the bare header."""
    headers = bounded_broadcast(group_headers(examples, by))
    joined = df.join(headers, on=by, how="left")
    header = F.coalesce(F.col("header"), F.lit(PROMPT_HEADER))
    return joined.withColumn(out, few_shot_prompt(F.col(text_col), header)).drop("header")


def example_count(examples: DataFrame, by: str) -> DataFrame:
    """Number of examples per group."""
    return examples.groupBy(by).agg(F.count(F.lit(1)).alias("n_examples"))
