"""Text → line table (S1-S3) and the blank-line filter (V1).

A document is split into lines in one row-local ``posexplode``; order is
carried by ``(doc_id, line_no)``, never by row position, so later stages can
shuffle freely and still rebuild input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import col_, utrim


def split_lines(text: Column) -> Column:
    """Lines as an array: split at '\n' or '\r\n'; one trailing empty piece
    (text ending with a line break, or empty text) is dropped.  A '\r' not
    followed by '\n' stays in its line."""
    parts = F.split(text, r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """One row per line ``(id, line_no INT (0-based), text, *keep)``."""
    keep = keep or []
    return df.select(
        id_col, *keep, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "text")
    ).select(id_col, F.col("line_no").cast("int").alias("line_no"), "text", *keep)


def trim_input(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Trim the whole input once (Unicode White_Space) before splitting."""
    return df.withColumn(text_col, utrim(F.col(text_col)))


def as_single(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              keep: list[str] | None = None) -> DataFrame:
    """S3: the whole record is one unit of work; blanks are kept."""
    return df.select(id_col, F.lit(0).alias("line_no"), F.col(text_col).alias("text"), *(keep or []))


def is_blank(c: Column | str) -> Column:
    return utrim(col_(c)) == ""


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """V1: drop lines that are empty after a Unicode trim; the untrimmed line
    is passed on unchanged."""
    return df.where(~is_blank(text_col))
