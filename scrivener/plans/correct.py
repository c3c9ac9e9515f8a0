"""End-to-end correction jobs.

``correct_corpus`` wires the stages as one DataFrame chain:

    lines (S1) → drop blanks (V1) → prompt (P1) → backend → extract (E) →
    sanitize (C7) → flags

The backend is the dictionary backend (the rules applied directly to the
line, no model — the default, fully JVM-side), the corpus backend (corrections
learned from the frequencies of the text itself, also JVM-side), the ngram
backend (a bigram model of the text decodes each line; temperature and token
budget act, also JVM-side) or a user model run through ``operators.generate``
(one Arrow hop to Python workers).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.extract import extract_answers
from scrivener.functions.prompts import few_shot_prompt, render_header
from scrivener.functions.sanitize import sanitize_steps
from scrivener.operators.lines import drop_blank
from scrivener.sources.fixed import DEFAULT_MAX_TOKENS, DEFAULT_TEMPERATURE


def correct_lines(df: DataFrame, text_col: str = "text", out: str = "corrected", rules=None,
                  form: str = "regex") -> DataFrame:
    """Dictionary backend: blank lines dropped, each remaining line sanitised."""
    df = drop_blank(df, text_col)
    df = sanitize_steps(df, text_col, out, rules=rules, form=form)
    return df.withColumn("changed", F.col(out) != F.col(text_col))


def corpus_outputs(df: DataFrame, text_col: str, src) -> DataFrame:
    """Adds ``raw_output``: the line rewritten with the corrections trained on
    all lines, per ``lang`` if there is such a column.  Lines get a number of
    their own in a stored copy, so null and repeated keys do no harm."""
    from scrivener.operators.joins import materialize
    from scrivener.operators.lexicon import apply_corrections, train_corrections

    by = ("lang",) if "lang" in df.columns else ()
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    picks = train_corrections(numbered, text_col, by)
    fixed = apply_corrections(numbered, picks, text_col, by, key_cols=("__row",), out="raw_output", keep=[c for c in df.columns if c != "raw_output"])
    return fixed.drop("__row").withColumn("raw_output", F.when(src.isNotNull(), F.col("raw_output")))


def ngram_outputs(df: DataFrame, text_col: str, src, temperature: float, max_tokens: int | None) -> DataFrame:
    """Adds ``raw_output``: the line as the n-gram generator writes it, trained
    on all lines, per ``lang`` if there is such a column; ``temperature`` and
    ``max_tokens`` (words of a line that are generated, the rest is copied) act
    as in ``operators.ngram``."""
    from scrivener.operators.joins import materialize
    from scrivener.operators.ngram import generate_ngram

    by = ("lang",) if "lang" in df.columns else ()
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    made = generate_ngram(numbered.withColumn("__src", src), "__src", ("__row",), by, temperature=temperature, max_tokens=max_tokens)
    return numbered.join(made, "__row").drop("__row")


def correct_corpus(df: DataFrame, text_col: str = "text", backend="dictionary",
                   load_model: Callable | None = None, temperature: float = DEFAULT_TEMPERATURE,
                   max_tokens: int = DEFAULT_MAX_TOKENS, examples=None, rules=None,
                   on_error: str = "row", persist_raw: bool = True, keep_blank: bool = False,
                   skip_blank: bool = True) -> DataFrame:
    """the whole job on a line table ``(doc_id, line_no, text, ...)``.

    With ``backend='model'`` the prompt goes through ``generate`` and the raw
    generation is written once (Parquet, under the shared checkpoint folder) before
    extraction, so a second action never runs the model again.

    With ``keep_blank`` blank lines pass through with ``status='blank'`` and
    no answer, in the same pass (so run counts come from one scan).
    With ``skip_blank=False`` blank inputs are corrected like any other
    (single-record mode: an empty answer then gives ``empty_output``).
    """
    from scrivener.operators.lines import is_blank

    blank = F.col("__blank")
    if keep_blank:
        df = df.withColumn("__blank", is_blank(text_col))
    else:
        if skip_blank:
            df = drop_blank(df, text_col)
        df = df.withColumn("__blank", F.lit(False))
    # Blank rows (kept only with keep_blank) get no raw output.
    src = F.when(~blank, F.col(text_col))
    if callable(backend):
        # A column-expression backend: (df) -> Column of raw generations.
        df = df.withColumn("raw_output", F.when(~blank, backend(df)))
    elif backend == "dictionary":
        df = df.withColumn("raw_output", src)
    elif backend == "corpus":
        df = corpus_outputs(df, text_col, src)
    elif backend == "ngram":
        df = ngram_outputs(df, text_col, src, temperature, max_tokens)
    elif backend == "model":
        from scrivener.operators.generate import generate

        header = render_header(examples)
        df = df.withColumn("prompt", few_shot_prompt(src, header))
        df = generate(df, "prompt", load_model=load_model, max_tokens=max_tokens,
                      temperature=temperature)
        if persist_raw:
            from scrivener.operators.joins import materialize

            df = materialize(df)
    else:
        raise ValueError(f"unknown backend {backend!r}")
    df = extract_answers(df, "raw_output", "extracted")
    df = sanitize_steps(df, "extracted", "corrected", rules=rules)
    df = df.withColumn("changed", F.col("corrected") != F.col(text_col))
    df = df.withColumn("status", F.when(blank, F.lit("blank")).otherwise(F.col("status")))
    df = df.withColumn("branch", F.when(~blank, F.col("branch"))).drop("__blank")
    if on_error == "fail":
        # Write the result once, check the stored rows, hand back the stored
        # table: the job is not run a second time for the check.
        from scrivener.operators.joins import materialize

        df = materialize(df)
        if df.where(F.col("status") != "ok").limit(1).count():
            raise RuntimeError("Model produced empty output")
    return df


def fix_typos(df: DataFrame, text_col: str = "text", **kwargs) -> DataFrame:
    """F2: defaults form (temperature 0.0, 25 tokens)."""
    return correct_corpus(df, text_col, **kwargs)


def fix_typos_with_options(df: DataFrame, temperature: float, max_tokens: int,
                           text_col: str = "text", **kwargs) -> DataFrame:
    """explicit settings, validated with the request rules first."""
    from scrivener.operators.validate import request_error_scalar

    err = request_error_scalar(has_input=True, stdin=False, config=None, local_path=None,
                               temperature=temperature, max_tokens=max_tokens)
    if err:
        raise ValueError(err)
    return correct_corpus(df, text_col, temperature=temperature, max_tokens=max_tokens, **kwargs)
