"""Evaluation and run reports (A1-A9, E11) as aggregations and joins.

All reports are ``groupBy`` aggregations with map-side partial aggregation, so
the shuffle carries one row per group per task, never the raw lines.
Averages are rounded to 6 places so that reports compare stably.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.extract import extract_answers
from scrivener.operators.joins import bounded_broadcast


def extraction_report(df: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """Which extraction branch produced each answer, with counts."""
    ex = extract_answers(df.select(raw_col), raw_col, "extracted")
    return ex.groupBy("branch", "status").agg(F.count(F.lit(1)).alias("n"))


def run_counts(result: DataFrame) -> DataFrame:
    """lines_total (blanks included), lines_blank, lines_processed,
    lines_failed, lines_changed from one pass over the output of
    ``correct_corpus(..., keep_blank=True)``: one global aggregate with
    map-side partial sums."""
    st = F.col("status")
    n = lambda c: F.sum(c.cast("long"))
    return result.agg(
        F.count(F.lit(1)).alias("lines_total"),
        n(st == "blank").alias("lines_blank"),
        n(st != "blank").alias("lines_processed"),
        n(~st.isin("ok", "blank")).alias("lines_failed"),
        n(F.coalesce(F.col("changed"), F.lit(False))).alias("lines_changed"),
    )


def changed_rate(df: DataFrame, by=("lang", "source"), input_col: str = "text",
                 output_col: str = "corrected") -> DataFrame:
    """A1: share of lines whose output differs from the input, per group."""
    changed = (F.col(output_col) != F.col(input_col)).cast("int")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.avg(changed), 6).alias("changed_rate"),
    )


def contains_fix(expected_col: str = "expected", output_col: str = "corrected") -> Column:
    """A2: every expected word occurs in the output, case-insensitively."""
    out = F.lower(F.col(output_col))
    return F.forall(F.col(expected_col), lambda x: F.contains(out, F.lower(x)))


def holds_expected(input_col: str = "text", expected_col: str = "expected") -> Column:
    """A4: the input already holds one of the expected fixes (a bad test case)."""
    inp = F.lower(F.col(input_col))
    return F.exists(F.col(expected_col), lambda x: F.contains(inp, F.lower(x)))


def sentence_accuracy(pred: DataFrame, ref: DataFrame | None = None, keys=("doc_id", "line_no"), by=("lang",),
                      output_col: str = "corrected", expected_col: str = "expected") -> DataFrame:
    """A3: exact-match share of outputs against references.

    With a separate reference table the two are inner-joined on the row key
    (a unique key, so the join has no hot key).  When the reference already
    sits on the prediction row (both derived from the same lines), pass
    ``ref=None``: the self-join would add a second scan and two shuffles for
    nothing."""
    if ref is None:
        j = pred
    else:
        j = pred.select(*keys, *by, output_col).join(ref.select(*keys, expected_col), list(keys), "inner")
    exact = F.coalesce((F.col(output_col) == F.col(expected_col)), F.lit(False)).cast("int")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(exact).cast("long").alias("n_exact"),
        F.round(F.avg(exact), 6).alias("accuracy"),
    )


def repeatable(a: DataFrame, b: DataFrame) -> DataFrame:
    """A5: rows in one run and not the other (multiset difference both ways)."""
    diff = a.exceptAll(b).unionByName(b.exceptAll(a))
    return diff.agg(F.count(F.lit(1)).alias("n_diff"))


def variant_compare(a: DataFrame, b: DataFrame | None = None, keys=("doc_id", "line_no"),
                    expected_col: str = "expected", out_a: str = "out_a", out_b: str = "out_b") -> DataFrame:
    """Side by side on the row key; win / tie / loss counts against the
    expected text.  Two variant tables are joined on the key; with ``b=None``
    both outputs are already columns of ``a`` (no join needed)."""
    j = a if b is None else a.join(b, list(keys), "inner")
    ra = F.coalesce(F.col(out_a) == F.col(expected_col), F.lit(False))
    rb = F.coalesce(F.col(out_b) == F.col(expected_col), F.lit(False))
    outcome = (
        F.when(ra & rb, "both_right").when(ra, "a_wins").when(rb, "b_wins").otherwise("both_wrong")
    )
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def check_targets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics (metric, value) against targets (metric, op, threshold),
    joined on the metric name; ``passed`` per metric."""
    j = metrics.join(bounded_broadcast(targets, 10_000), "metric", "inner")
    passed = (
        F.when(F.col("op") == ">", F.col("value") > F.col("threshold"))
        .when(F.col("op") == "<", F.col("value") < F.col("threshold"))
    )
    return j.select("metric", F.round("value", 6).alias("value"), "op", "threshold", passed.alias("passed"))


def latency_profile(run_log: DataFrame) -> DataFrame:
    """Mean latency, runs per second and tokens per second per shape."""
    return run_log.groupBy("shape").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("ms"), 6).alias("mean_ms"),
        F.round(1000.0 / F.avg("ms"), 6).alias("runs_per_sec"),
        F.round(F.max("n_tokens") * 1000.0 / F.avg("ms"), 6).alias("tokens_per_sec"),
    )


def observe_run_counts(result: DataFrame, name: str = "run_counts"):
    """A8 without a second pass: the same counts as ``run_counts``, gathered
    by ``DataFrame.observe`` while the caller's own action (the write of the
    corrected lines) runs.  Returns (DataFrame to act on, Observation); read
    ``observation.get`` after the action."""
    from pyspark.sql import Observation

    st = F.col("status")
    n = lambda c: F.sum(c.cast("long"))
    obs = Observation(name)
    observed = result.observe(
        obs,
        F.count(F.lit(1)).alias("lines_total"),
        n(st == "blank").alias("lines_blank"),
        n(st != "blank").alias("lines_processed"),
        n(~st.isin("ok", "blank")).alias("lines_failed"),
        n(F.coalesce(F.col("changed"), F.lit(False))).alias("lines_changed"),
    )
    return observed, obs
