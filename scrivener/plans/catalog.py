"""Registered queries: name → (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables (or tables Spark derives from them).  The oracle SQL computes the
same result in DuckDB from the same parquet files; column names agree.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import extract as EX
from scrivener.functions import prompts as P
from scrivener.operators import evaluate as EV
from scrivener.operators import inventory as INV
from scrivener.operators import lexicon as LX
from scrivener.operators import tokens as TK
from scrivener.operators import validate as V
from scrivener.operators.joins import bounded_broadcast
from scrivener.plans import oracle_parts as O
from scrivener.plans.oracle_ngram import ngram_ctes
from scrivener.sources import fixtures as FX
from scrivener.sources.fixed import COMPONENT_RULES, DEFAULT_EXAMPLES, DEFAULT_RULES, PROMPT_HEADER, TARGETS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _w(ctes: str, body: str) -> str:
    return FX.with_ctes(ctes, body)


# ---------------------------------------------------------------- step 1: lines, sanitize


@register("explode_lines", _w(FX.SQL_LINES, "SELECT doc_id, line_no, text, lang, source FROM fx_lines"))
def q_explode_lines(spark, sf):
    return FX.lines(spark, sf).select("doc_id", "line_no", "text", "lang", "source")


@register(
    "drop_blank",
    _w(FX.SQL_LINES, f"SELECT doc_id, line_no, text FROM fx_lines WHERE {O.utrim('text')} <> ''"),
)
def q_drop_blank(spark, sf):
    from scrivener.operators.lines import drop_blank

    return drop_blank(FX.lines(spark, sf)).select("doc_id", "line_no", "text")


_SZ_CTES, _SZ_T = O.sanitize_ctes("fx_raw", "raw_output", "sanitized")


@register("sanitize", _w(FX.SQL_RAW_OUTPUTS + "," + _SZ_CTES, f"SELECT doc_id, line_no, sanitized FROM {_SZ_T}"))
def q_sanitize(spark, sf):
    from scrivener.functions.sanitize import sanitize_steps

    df = FX.raw_outputs(spark, sf)
    return sanitize_steps(df, "raw_output", "sanitized").select("doc_id", "line_no", "sanitized")


_CL_CTES, _CL_T = O.sanitize_ctes("fx_nb", "typo_text", "corrected", prefix="cl")
_CORRECT_LINES_SQL = _w(
    FX.SQL_TYPO_LINES + f",\nfx_nb AS (SELECT * FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> '')," + _CL_CTES,
    f"SELECT doc_id, line_no, typo_text AS text, corrected, corrected <> typo_text AS changed FROM {_CL_T}",
)


def correct_lines_df(spark, sf):
    from scrivener.plans.correct import correct_lines

    df = FX.typo_lines(spark, sf)
    out = correct_lines(df, text_col="typo_text")
    return out.select("doc_id", "line_no", F.col("typo_text").alias("text"), "corrected", "changed")


register("correct_lines", _CORRECT_LINES_SQL)(correct_lines_df)


# ---------------------------------------------------------------- step 2: extraction

_EX_CTES, _EX_T = O.extract_ctes("fx_raw", "raw_output", "extracted")


@register(
    "extract_answers",
    _w(FX.SQL_RAW_OUTPUTS + "," + _EX_CTES, f"SELECT doc_id, line_no, extracted, status FROM {_EX_T}"),
)
def q_extract_answers(spark, sf):
    from scrivener.functions.extract import extract_answers

    df = FX.raw_outputs(spark, sf)
    return extract_answers(df, "raw_output", "extracted").select("doc_id", "line_no", "extracted", "status")


@register(
    "extract_branches",
    _w(
        FX.SQL_RAW_OUTPUTS + "," + _EX_CTES,
        f"SELECT branch, status, count(*) AS n FROM {_EX_T} GROUP BY branch, status",
    ),
)
def q_extract_branches(spark, sf):
    from scrivener.operators.evaluate import extraction_report

    return extraction_report(FX.raw_outputs(spark, sf), "raw_output")


# ---------------------------------------------------------------- step 3: prompts


# Per-language example sets for the grouped-prompt query.
# 'en' = the default four, 'fr' = the first three, 'es' = one added example,
# 'de' = none (bare header).
LANG_EXAMPLES = (
    [("en", o, t, f) for o, t, f in DEFAULT_EXAMPLES]
    + [("fr", o, t, f) for o, t, f in DEFAULT_EXAMPLES[:3]]
    + [("es", 1, "it occured twice", "it occurred twice")]
)

_NB_LINES_SQL = FX.SQL_LINES + f",\nfx_nb_lines AS (SELECT * FROM fx_lines WHERE {O.utrim('text')} <> '')"


def _nb_lines(spark, sf):
    from scrivener.operators.lines import drop_blank

    return drop_blank(FX.lines(spark, sf))


def _sql_prompt(header: str, text: str = "text") -> str:
    return f"{O.q(header)} || 'Input: ' || {text} || chr(10) || 'Output:'"


@register("few_shot_prompt", _w(_NB_LINES_SQL, f"SELECT doc_id, line_no, {_sql_prompt(P.render_header())} AS prompt FROM fx_nb_lines"))
def q_few_shot_prompt(spark, sf):
    df = _nb_lines(spark, sf)
    return df.select("doc_id", "line_no", P.few_shot_prompt(F.col("text")).alias("prompt"))


@register(
    "three_shot_prompt",
    _w(_NB_LINES_SQL, f"SELECT doc_id, line_no, {_sql_prompt(P.render_header(DEFAULT_EXAMPLES[:3]))} AS prompt FROM fx_nb_lines"),
)
def q_three_shot_prompt(spark, sf):
    df = _nb_lines(spark, sf)
    header = P.render_header(DEFAULT_EXAMPLES[:3])
    return df.select("doc_id", "line_no", P.few_shot_prompt(F.col("text"), header).alias("prompt"))


@register("zero_shot_prompt", _w(_NB_LINES_SQL, "SELECT doc_id, line_no, 'Fix: ' || text AS prompt FROM fx_nb_lines"))
def q_zero_shot_prompt(spark, sf):
    df = _nb_lines(spark, sf)
    return df.select("doc_id", "line_no", P.zero_shot_prompt(F.col("text")).alias("prompt"))


def _sql_lang_examples() -> str:
    rows = ", ".join(f"({O.q(g)}, {o}, {O.q(t)}, {O.q(f)})" for g, o, t, f in LANG_EXAMPLES)
    return f"fx_examples(lang, ord, typo, fixed) AS (VALUES {rows})"


_SQL_HEADERS = f""",
{_sql_lang_examples()},
fx_headers AS (
  SELECT lang, {O.q(PROMPT_HEADER)} || string_agg('Input: ' || typo || chr(10) || 'Output: ' || fixed || chr(10) || chr(10), '' ORDER BY ord) AS header
  FROM fx_examples GROUP BY lang)"""


@register(
    "prompt_by_lang",
    _w(
        _NB_LINES_SQL + _SQL_HEADERS,
        f"""SELECT l.doc_id, l.line_no, l.lang,
       coalesce(h.header, {O.q(PROMPT_HEADER)}) || 'Input: ' || l.text || chr(10) || 'Output:' AS prompt
FROM fx_nb_lines l LEFT JOIN fx_headers h ON l.lang = h.lang""",
    ),
)
def q_prompt_by_lang(spark, sf):
    from scrivener.operators.prompts import render_few_shot_by
    from scrivener.sources.fixed import examples_df

    ex = examples_df(spark, LANG_EXAMPLES, group="lang")
    out = render_few_shot_by(_nb_lines(spark, sf), ex, "lang")
    return out.select("doc_id", "line_no", "lang", "prompt")


@register(
    "example_count",
    _w(
        _NB_LINES_SQL + _SQL_HEADERS.split("fx_headers AS")[0].rstrip().rstrip(","),
        """SELECT l.lang, l.n_lines, coalesce(e.n_examples, 0) AS n_examples
FROM (SELECT lang, count(*) AS n_lines FROM fx_nb_lines GROUP BY lang) l
LEFT JOIN (SELECT lang, count(*) AS n_examples FROM fx_examples GROUP BY lang) e ON l.lang = e.lang""",
    ),
)
def q_example_count(spark, sf):
    from scrivener.operators.prompts import example_count
    from scrivener.sources.fixed import examples_df

    ex = example_count(examples_df(spark, LANG_EXAMPLES, group="lang"), "lang")
    per_lang = _nb_lines(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"))
    out = per_lang.join(bounded_broadcast(ex, 10_000), "lang", "left")
    return out.select("lang", "n_lines", F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"))


def _sql_normalise(p: str) -> str:
    r = O.urtrim(p)
    plain = " OR ".join(f"suffix({r}, '{c}')" for c in [":", ".", "!", "?", " "])
    return f"CASE WHEN suffix({r}, 'Output:') THEN {r} || ' ' WHEN NOT ({plain}) THEN {r} || ' ' ELSE {p} END"


@register(
    "normalise_prompt",
    _w(FX.SQL_LINES, f"SELECT doc_id, line_no, {_sql_normalise('text')} AS normalised FROM fx_lines"),
)
def q_normalise_prompt(spark, sf):
    df = FX.lines(spark, sf)
    return df.select("doc_id", "line_no", P.normalise_prompt(F.col("text")).alias("normalised"))


# The echoed generation: the prompt, then (for two rows in three) a leading
# run of ' ', '\n', '\t' and the raw output; the third row has no echo.
def _echo_spark(prompt, raw, k):
    return F.when(k % 3 == 0, raw).otherwise(F.concat(prompt, F.when(k % 3 == 1, F.lit(" \n")).otherwise(F.lit("\t ")), raw))


def _echo_sql(prompt: str, raw: str, k: str) -> str:
    return f"CASE WHEN {k} % 3 = 0 THEN {raw} WHEN {k} % 3 = 1 THEN {prompt} || ' ' || chr(10) || {raw} ELSE {prompt} || chr(9) || ' ' || {raw} END"


_SQL_STRIP = _w(
    FX.SQL_RAW_OUTPUTS
    + f""",
fx_echo AS (
  SELECT doc_id, line_no, p, {_echo_sql('p', 'raw_output', '(doc_id + line_no)')} AS full_text
  FROM (SELECT *, {_sql_prompt(P.render_header(), 'typo_text')} AS p FROM fx_raw))""",
    """SELECT doc_id, line_no,
  ltrim(CASE WHEN starts_with(full_text, p) THEN substr(full_text, length(p) + 1) ELSE full_text END, ' ' || chr(10) || chr(9)) AS response
FROM fx_echo""",
)


@register("strip_prompt", _SQL_STRIP)
def q_strip_prompt(spark, sf):
    df = FX.raw_outputs(spark, sf)
    df = df.withColumn("p", P.few_shot_prompt(F.col("typo_text")))
    df = df.withColumn("full_text", _echo_spark(F.col("p"), F.col("raw_output"), F.col("doc_id") + F.col("line_no")))
    return df.select("doc_id", "line_no", P.strip_prompt(F.col("full_text"), F.col("p")).alias("response"))


# ---------------------------------------------------------------- step 4: end to end, sinks, counts

RUN_MODEL, RUN_TEMPERATURE, RUN_MAX_TOKENS = "stub/raw-shapes", 0.0, 25

_CC_EX, _CC_EX_T = O.extract_ctes("fx_cc_raw", "raw_output", "extracted", prefix="cx")
_CC_SZ, _CC_SZ_T = O.sanitize_ctes(_CC_EX_T, "extracted", "corrected", prefix="cs")
_CC_CTES = (
    FX.SQL_RAW_OUTPUTS
    + f",\nfx_cc_raw AS (SELECT * FROM fx_raw WHERE {O.utrim('typo_text')} <> '')," + _CC_EX + "," + _CC_SZ
    + f""",
fx_cc AS (SELECT doc_id, line_no, typo_text AS text, extracted, corrected, status, corrected <> typo_text AS changed
          FROM {_CC_SZ_T})"""
)


def correct_corpus_df(spark, sf):
    from scrivener.plans.correct import correct_corpus

    df = FX.typo_lines(spark, sf)
    stub = lambda d: FX.raw_output_expr(F.col("doc_id"), F.col("line_no"), F.col("typo_text"))
    out = correct_corpus(df, "typo_text", backend=stub)
    return out.select("doc_id", "line_no", F.col("typo_text").alias("text"), "extracted", "corrected",
                      "status", "changed")


register("correct_corpus", _w(_CC_CTES, "SELECT * FROM fx_cc"))(correct_corpus_df)


def _sql_json_record(inp: str, out: str) -> str:
    return (f"CAST(to_json({{'input': {inp}, 'output': {out}, 'model': {O.q(RUN_MODEL)}, "
            f"'temperature': CAST({RUN_TEMPERATURE} AS DOUBLE), 'max_tokens': CAST({RUN_MAX_TOKENS} AS INTEGER)}}) AS VARCHAR)")


@register("json_records", _w(_CC_CTES, f"SELECT doc_id, line_no, {_sql_json_record('text', 'corrected')} AS json FROM fx_cc"))
def q_json_records(spark, sf):
    from scrivener.sinks.writers import json_records

    return json_records(correct_corpus_df(spark, sf), RUN_MODEL, RUN_TEMPERATURE, RUN_MAX_TOKENS)


@register(
    "json_per_document",
    _w(
        _CC_CTES,
        f"""SELECT doc_id, CAST(to_json({{'results': list({{'input': text, 'output': corrected}} ORDER BY line_no),
  'model': {O.q(RUN_MODEL)}, 'temperature': CAST({RUN_TEMPERATURE} AS DOUBLE),
  'max_tokens': CAST({RUN_MAX_TOKENS} AS INTEGER)}}) AS VARCHAR) AS json
FROM fx_cc GROUP BY doc_id""",
    ),
)
def q_json_per_document(spark, sf):
    from scrivener.sinks.writers import json_per_document

    return json_per_document(correct_corpus_df(spark, sf), RUN_MODEL, RUN_TEMPERATURE, RUN_MAX_TOKENS)


@register("json_envelope_file", _w(_CC_CTES, "SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos, text AS input, corrected AS output FROM fx_cc"))
def q_json_envelope_file(spark, sf):
    """The whole run written as one JSON document by the committing sink
    and read back by its manifest."""
    import uuid

    from scrivener.session import scratch_path
    from scrivener.sinks.envelope_file import read_envelope, write_envelope

    path = scratch_path(spark, f"envelope-{uuid.uuid4().hex}")
    write_envelope(correct_corpus_df(spark, sf), path, RUN_MODEL, RUN_TEMPERATURE, RUN_MAX_TOKENS)
    return read_envelope(spark, path)


@register("write_read_text", _w(_CC_CTES, "SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, replace(coalesce(corrected, ''), chr(13), ' ') AS text FROM fx_cc"))
def q_write_read_text(spark, sf):
    """The corrected lines written as text in input order and read back
    by line, counted over all files.  A carriage return would end a line in a
    text file, so it is written as a space."""
    import uuid

    from scrivener.session import scratch_path
    from scrivener.sinks.writers import write_text
    from scrivener.sources.tables import read_text_lines, running_line_no

    path = scratch_path(spark, f"text-{uuid.uuid4().hex}")
    out = correct_corpus_df(spark, sf)
    write_text(out.withColumn("corrected", F.translate(F.coalesce("corrected", F.lit("")), "\r", " ")), path)
    return running_line_no(read_text_lines(spark, path)).select("line_no", "text")


@register(
    "report",
    _w(_CC_CTES, """SELECT doc_id, line_no, status,
  'Input:  ' || text || chr(10) || 'Output: ' || CASE WHEN corrected IS NULL THEN '[' || status || ']' ELSE corrected END || chr(10) || '---' AS report FROM fx_cc"""),
)
def q_report(spark, sf):
    from scrivener.sinks.writers import render_report

    return render_report(correct_corpus_df(spark, sf))


@register(
    "run_counts",
    _w(
        _CC_CTES,
        f"""SELECT
  (SELECT count(*) FROM fx_typo_lines) AS lines_total,
  (SELECT count(*) FROM fx_typo_lines WHERE {O.utrim('typo_text')} = '') AS lines_blank,
  (SELECT count(*) FROM fx_cc) AS lines_processed,
  (SELECT count(*) FROM fx_cc WHERE status <> 'ok') AS lines_failed,
  (SELECT count(*) FROM fx_cc WHERE changed) AS lines_changed""",
    ),
)
def q_run_counts(spark, sf):
    from scrivener.operators.evaluate import run_counts
    from scrivener.plans.correct import correct_corpus

    stub = lambda d: FX.raw_output_expr(F.col("doc_id"), F.col("line_no"), F.col("typo_text"))
    return run_counts(correct_corpus(FX.typo_lines(spark, sf), "typo_text", backend=stub, keep_blank=True))


# ---------------------------------------------------------------- step 5: evaluation, dictionary


_CL_ALL = (
    FX.SQL_TYPO_LINES + f",\nfx_nb AS (SELECT * FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> '')," + _CL_CTES
    + f""",
fx_cl AS (SELECT doc_id, line_no, lang, source, typo_text AS text, corrected, corrected <> typo_text AS changed,
                 {FX.sql_expected_words('typo_text')} AS expected
          FROM {_CL_T})"""
)


def _cl(spark, sf):
    from scrivener.plans.correct import correct_lines

    out = correct_lines(FX.typo_lines(spark, sf), text_col="typo_text")
    return out.select("doc_id", "line_no", "lang", "source", F.col("typo_text").alias("text"), "corrected",
                      "changed", FX.expected_words(F.col("typo_text")).alias("expected"),
                      F.col("text").alias("original"))


@register(
    "changed_rate",
    _w(_CL_ALL, """SELECT lang, source, count(*) AS n_lines, round(avg(CAST(changed AS INTEGER)), 6) AS changed_rate
FROM fx_cl GROUP BY lang, source"""),
)
def q_changed_rate(spark, sf):
    return EV.changed_rate(_cl(spark, sf))


@register(
    "contains_fix",
    _w(_CL_ALL, """SELECT doc_id, line_no, CAST(len(expected) AS INTEGER) AS n_expected,
  list_bool_and(list_transform(expected, lambda x: contains(lower(corrected), lower(x)))) AS contains_fix
FROM fx_cl WHERE len(expected) > 0"""),
)
def q_contains_fix(spark, sf):
    df = _cl(spark, sf).where(F.size("expected") > 0)
    return df.select("doc_id", "line_no", F.size("expected").alias("n_expected"),
                     EV.contains_fix("expected", "corrected").alias("contains_fix"))


@register(
    "case_sanity",
    _w(_CL_ALL, """SELECT doc_id, line_no FROM fx_cl
WHERE len(expected) > 0 AND list_bool_or(list_transform(expected, lambda x: contains(lower(text), lower(x))))"""),
)
def q_case_sanity(spark, sf):
    df = _cl(spark, sf).where(F.size("expected") > 0)
    return df.where(EV.holds_expected("text", "expected")).select("doc_id", "line_no")


@register(
    "sentence_accuracy",
    _w(_CL_ALL, """SELECT p.lang, count(*) AS n, CAST(sum(CAST(coalesce(p.corrected = r.text, false) AS INTEGER)) AS BIGINT) AS n_exact,
  round(avg(CAST(coalesce(p.corrected = r.text, false) AS INTEGER)), 6) AS accuracy
FROM fx_cl p JOIN fx_lines r ON p.doc_id = r.doc_id AND p.line_no = r.line_no GROUP BY p.lang"""),
)
def q_sentence_accuracy(spark, sf):
    # Prediction and reference come from the same line rows: no self-join.
    pred = _cl(spark, sf).drop("expected").withColumnRenamed("original", "expected")
    return EV.sentence_accuracy(pred)


@register(
    "repeatable",
    _w(_CC_CTES, """SELECT count(*) AS n_diff FROM (
  (SELECT * FROM fx_cc EXCEPT ALL SELECT * FROM fx_cc) UNION ALL (SELECT * FROM fx_cc EXCEPT ALL SELECT * FROM fx_cc))"""),
)
def q_repeatable(spark, sf):
    return EV.repeatable(correct_corpus_df(spark, sf), correct_corpus_df(spark, sf))


_VC_SQL = _w(
    _CL_ALL,
    f"""SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN ra AND rb THEN 'both_right' WHEN ra THEN 'a_wins' WHEN rb THEN 'b_wins' ELSE 'both_wrong' END AS outcome
  FROM (SELECT coalesce(a.corrected = r.text, false) AS ra, coalesce(b.out_b = r.text, false) AS rb
        FROM fx_cl a
        JOIN (SELECT doc_id, line_no, {O.first_sentence(O.cut_role_markers(O.collapse_ws('text')))} AS out_b FROM fx_cl) b
          ON a.doc_id = b.doc_id AND a.line_no = b.line_no
        JOIN fx_lines r ON a.doc_id = r.doc_id AND a.line_no = r.line_no))
GROUP BY outcome""",
)


@register("variant_compare", _VC_SQL)
def q_variant_compare(spark, sf):
    from scrivener.functions.extract import few_shot_postprocess

    cl = _cl(spark, sf).select("doc_id", "line_no", "text", F.col("corrected").alias("out_a"),
                               F.col("original").alias("expected"))
    # Both variants are computed on the same line rows, so no join is needed.
    return EV.variant_compare(few_shot_postprocess(cl, "text", "out_b"))


def _sql_targets() -> str:
    rows = ", ".join(f"('{m}', '{op}', CAST({t} AS DOUBLE))" for m, op, t in TARGETS)
    return f"fx_targets(metric, op, threshold) AS (VALUES {rows})"


@register(
    "targets",
    _w(
        _CL_ALL + ",\n" + _sql_targets() + """,
fx_metrics AS (
  SELECT 'accuracy' AS metric, avg(CAST(coalesce(p.corrected = r.text, false) AS INTEGER)) AS value
    FROM fx_cl p JOIN fx_lines r ON p.doc_id = r.doc_id AND p.line_no = r.line_no
  UNION ALL SELECT 'latency_ms', avg(value) FROM events
  UNION ALL SELECT 'model_size_gb', sum(strlen(html)) / 1073741824.0 FROM pages)""",
        """SELECT m.metric, round(m.value, 6) AS value, t.op, t.threshold,
  CASE WHEN t.op = '>' THEN m.value > t.threshold WHEN t.op = '<' THEN m.value < t.threshold END AS passed
FROM fx_metrics m JOIN fx_targets t ON m.metric = t.metric""",
    ),
)
def q_targets(spark, sf):
    from scrivener.sources.tables import read_table

    acc = (
        _cl(spark, sf)
        .agg(F.avg(F.coalesce(F.col("corrected") == F.col("original"), F.lit(False)).cast("int")).alias("value"))
        .select(F.lit("accuracy").alias("metric"), "value")
    )
    lat = read_table(spark, sf, "events").agg(F.avg("value").alias("value")).select(F.lit("latency_ms").alias("metric"), "value")
    size = (
        read_table(spark, sf, "pages").agg((F.sum(F.octet_length("html")) / F.lit(1073741824.0)).alias("value"))
        .select(F.lit("model_size_gb").alias("metric"), "value")
    )
    targets = spark.createDataFrame(TARGETS, "metric string, op string, threshold double")
    return EV.check_targets(acc.unionByName(lat).unionByName(size), targets)


def _sql_rule_hits() -> str:
    keys = ", ".join(O.q(t) for t, _ in DEFAULT_RULES)
    return f"""SELECT typo, lang, count(*) AS hits FROM (
  SELECT lang, lower(unnest(regexp_extract_all(typo_text, '{O.TOKEN_RE}'))) AS typo FROM fx_typo_lines)
WHERE typo IN ({keys}) GROUP BY typo, lang"""


@register("rule_hits", _w(FX.SQL_TYPO_LINES, _sql_rule_hits()))
def q_rule_hits(spark, sf):
    from scrivener.operators.dictionary import rule_hits

    return rule_hits(FX.typo_lines(spark, sf), DEFAULT_RULES, "typo_text", by=("lang",))


@register(
    "dictionary_join",
    _w(FX.SQL_TYPO_LINES, f"SELECT doc_id, line_no, {O.apply_rules('typo_text')} AS corrected FROM fx_typo_lines"),
)
def q_dictionary_join(spark, sf):
    from scrivener.operators.dictionary import apply_dictionary_join
    from scrivener.sources.fixed import rules_df

    return apply_dictionary_join(FX.typo_lines(spark, sf), rules_df(spark), "typo_text")


@register(
    "dictionary_map",
    _w(FX.SQL_TYPO_LINES, f"SELECT doc_id, line_no, {O.apply_rules('typo_text')} AS corrected FROM fx_typo_lines"),
)
def q_dictionary_map(spark, sf):
    from scrivener.operators.dictionary import apply_dictionary
    from scrivener.sources.fixed import rules_df

    out = apply_dictionary(FX.typo_lines(spark, sf), rules_df(spark), "typo_text")
    return out.select("doc_id", "line_no", "corrected")


@register(
    "dictionary_phrases",
    _w(FX.SQL_PHRASE_LINES, f"SELECT doc_id, line_no, {O.apply_phrases('phrase_text', FX.PHRASE_RULES)} AS corrected FROM fx_phrase_lines"),
)
def q_dictionary_phrases(spark, sf):
    """C5/C6 with rules of several words, row-local."""
    from scrivener.operators.phrases import apply_phrases
    from scrivener.sources.fixed import rules_df

    rules = rules_df(spark, DEFAULT_RULES + FX.PHRASE_RULES)
    return apply_phrases(FX.phrase_lines(spark, sf), rules, "phrase_text").select("doc_id", "line_no", "corrected")


def _sql_phrase_hits() -> str:
    singles = ", ".join(O.q(t) for t, _ in DEFAULT_RULES)
    names = "CASE typo " + " ".join(f"WHEN chr({0xE000 + k}) THEN {O.q(t)}" for k, (t, _) in enumerate(FX.PHRASE_RULES)) + " ELSE typo END"
    marks = "".join(chr(0xE000 + k) for k in range(len(FX.PHRASE_RULES)))
    return f"""SELECT {names} AS typo, lang, count(*) AS hits FROM (
  SELECT lang, lower(unnest(regexp_extract_all({O.phrase_marks('phrase_text', FX.PHRASE_RULES)}, '[{marks}]|{O.TOKEN_RE.split('|')[0]}'))) AS typo FROM fx_phrase_lines)
WHERE typo IN ({singles}) OR contains('{marks}', typo) GROUP BY ALL"""


@register("rule_hits_table", _w(FX.SQL_PHRASE_LINES, _sql_phrase_hits()))
def q_rule_hits_table(spark, sf):
    """C8 for a rule table, phrases included."""
    from scrivener.operators.phrases import phrase_hits
    from scrivener.sources.fixed import rules_df

    return phrase_hits(FX.phrase_lines(spark, sf), rules_df(spark, DEFAULT_RULES + FX.PHRASE_RULES), "phrase_text")


@register(
    "batch_report",
    _w(
        FX.SQL_TYPO_LINES,
        f"""SELECT doc_id, line_no, 'Input:  ' || typo_text || chr(10) || 'Output: ' || {O.apply_rules('typo_text')} || chr(10) || '---' AS report
FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> ''
UNION ALL SELECT doc_id, count(*)::INTEGER, 'Processed ' || count(*) || ' lines with model: dictionary' FROM fx_typo_lines GROUP BY doc_id""",
    ),
)
def q_batch_report(spark, sf):
    """S8 in batch mode: blocks, and a closing line per document."""
    from scrivener.operators.dictionary import apply_dictionary
    from scrivener.operators.lines import drop_blank
    from scrivener.sinks.writers import render_batch_report
    from scrivener.sources.fixed import rules_df

    lines = FX.typo_lines(spark, sf)
    out = apply_dictionary(drop_blank(lines, "typo_text"), rules_df(spark), "typo_text")
    return render_batch_report(out, lines, "dictionary", input_col="typo_text")


# ---------------------------------------------------------------- step 6: corpus-trained corrector



def _sql_variants(w: str) -> str:
    return (f"unnest(list_distinct(list_concat([{w}], list_transform(range(1, length({w}) + 1), "
            f"lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1)))))")


_LX_CTES = FX.SQL_TYPO_LINES + f""",
lx_words AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{LX.WORD_PATTERN}')) AS word FROM fx_lines),
lx_lexicon AS (SELECT lang, word, count(*) AS freq FROM lx_words GROUP BY lang, word HAVING count(*) >= {LX.DEFAULT_MIN_COUNT}),
lx_inwords AS (SELECT DISTINCT lang, word FROM
  (SELECT lang, unnest(regexp_extract_all(lower(typo_text), '{LX.WORD_PATTERN}')) AS word FROM fx_typo_lines)
  WHERE length(word) >= {LX.DEFAULT_MIN_LEN}),
lx_oov AS (SELECT * FROM lx_inwords w WHERE NOT EXISTS (SELECT 1 FROM lx_lexicon l WHERE l.lang = w.lang AND l.word = w.word)),
lx_ov AS (SELECT lang, word, {_sql_variants('word')} AS variant FROM lx_oov),
lx_lv AS (SELECT lang, word AS cand, freq, {_sql_variants('word')} AS variant FROM lx_lexicon),
lx_cands AS (SELECT DISTINCT o.lang, o.word, l.cand, l.freq FROM lx_ov o JOIN lx_lv l ON o.lang = l.lang AND o.variant = l.variant),
lx_scored AS (SELECT *, CAST(levenshtein({O.one_byte('word')}, {O.one_byte('cand')}) AS INTEGER) AS dist FROM lx_cands),
lx_best AS (SELECT lang, word, cand, dist, freq FROM lx_scored
  QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY dist, freq DESC, cand) = 1)"""


# Word statistics are taken from whole documents: words never span a line
# break and the typo injections hold no newline, so this equals the line
# tables the oracle uses, without the line split.
def _lexicon(spark, sf):
    from scrivener.operators.joins import materialize

    return materialize(LX.build_lexicon(FX.documents(spark, sf), "text", min_count=LX.DEFAULT_MIN_COUNT))


def _typo_docs(spark, sf):
    return FX.documents(spark, sf).withColumn("typo_text", FX.inject_typos(F.col("text")))


def _oov(spark, sf, lex=None):
    return LX.find_oov(_typo_docs(spark, sf), lex if lex is not None else _lexicon(spark, sf), "typo_text",
                       min_len=LX.DEFAULT_MIN_LEN)


def _cands(spark, sf):
    lex = _lexicon(spark, sf)
    return LX.candidates(_oov(spark, sf, lex), lex)


@register("lexicon", _w(_LX_CTES, "SELECT lang, word, freq FROM lx_lexicon"))
def q_lexicon(spark, sf):
    return _lexicon(spark, sf)


@register("oov_words", _w(_LX_CTES, "SELECT lang, word FROM lx_oov"))
def q_oov_words(spark, sf):
    return _oov(spark, sf)


@register("candidates", _w(_LX_CTES, "SELECT lang, word, cand, freq, dist FROM lx_scored"))
def q_candidates(spark, sf):
    return _cands(spark, sf)


@register("best_candidate", _w(_LX_CTES, "SELECT lang, word, cand, dist, freq FROM lx_best"))
def q_best_candidate(spark, sf):
    return LX.best(_cands(spark, sf))


@register(
    "apply_corrections",
    _w(
        _LX_CTES + f""",
lx_toks AS (SELECT doc_id, line_no, lang, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos
  FROM (SELECT doc_id, line_no, lang, regexp_extract_all(typo_text, '{O.TOKEN_RE}') AS t FROM fx_typo_lines)),
lx_fixed AS (SELECT t.doc_id, t.line_no, string_agg(coalesce(b.cand, t.tok), '' ORDER BY t.pos) AS corrected
  FROM lx_toks t LEFT JOIN lx_best b ON t.lang = b.lang AND lower(t.tok) = b.word GROUP BY t.doc_id, t.line_no)""",
        """SELECT l.doc_id, l.line_no, CASE WHEN l.typo_text IS NULL THEN NULL ELSE coalesce(f.corrected, '') END AS corrected
FROM fx_typo_lines l LEFT JOIN lx_fixed f ON l.doc_id = f.doc_id AND l.line_no = f.line_no""",
    ),
)
def q_apply_corrections(spark, sf):
    picks = LX.best(_cands(spark, sf))
    return LX.apply_corrections(FX.typo_lines(spark, sf), picks, "typo_text")


@register(
    "sampled_candidate",
    _w(
        _LX_CTES + """,
lx_top AS (SELECT * FROM lx_scored QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY dist, freq DESC, cand) <= 40),
lx_noise AS (SELECT *, (('0x' || substr(md5('42|' || lang || '|' || word || '|' || cand), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM lx_top)""",
        """SELECT lang, word, cand, dist, freq FROM lx_noise
QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY (ln(freq::DOUBLE) - 100.0 * dist) / 0.7 - ln(-ln(u)) DESC) = 1""",
    ),
)
def q_sampled_candidate(spark, sf):
    """Seeded top-40 temperature draw per word."""
    return LX.sample(_cands(spark, sf), k=40, temperature=0.7, seed=42)


# The learned error model, on typed words whose origin is known to the report only.

_EM_ROUNDS = 3


def _sql_em_round(k: int) -> str:
    """One round of EM: em_cost{k} from em_cost{k - 1}."""
    return f""",
em_pc{k} AS (SELECT p.*, c1.cost + coalesce(c2.cost, 0) AS cost FROM em_pairs p JOIN em_cost{k - 1} c1 ON c1.lang = p.lang AND c1.was = p.ops[1].was AND c1.typed = p.ops[1].typed
  LEFT JOIN em_cost{k - 1} c2 ON c2.lang = p.lang AND c2.was = p.ops[2].was AND c2.typed = p.ops[2].typed),
em_w{k} AS (SELECT *, freq * exp(-cost / 1000.0::DOUBLE) AS weight FROM em_pc{k}),
em_s{k} AS (SELECT lang, ops, n * weight / sum(weight) OVER (PARTITION BY lang, word) AS share FROM em_w{k}),
em_n{k} AS (SELECT lang, o.was AS was, o.typed AS typed, round(sum(share) * 1000)::BIGINT AS n FROM (SELECT lang, unnest(ops) AS o, share FROM em_s{k}) GROUP BY ALL),
em_cost{k} AS MATERIALIZED (SELECT o.lang, o.was, o.typed, coalesce(n.n, 0)::BIGINT AS n,
  round(-1000 * ln((coalesce(n.n, 0) / 1000.0::DOUBLE + 0.5::DOUBLE) / (greatest(coalesce(h.seen, 0)::DOUBLE, coalesce(n.n, 0) / 1000.0::DOUBLE) + 1.0::DOUBLE)))::BIGINT AS cost
  FROM em_ops o LEFT JOIN em_n{k} n ON n.lang = o.lang AND n.was = o.was AND n.typed = o.typed LEFT JOIN em_seen h ON h.lang = o.lang AND h.was = o.was)"""


_EM_CTES = FX.SQL_SLIPS + f""",
em_lex AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{LX.WORD_PATTERN}')) AS word FROM documents) GROUP BY lang, word),
em_typed AS MATERIALIZED (SELECT lang, typed AS word, count(*) AS n FROM fx_slips t WHERE NOT EXISTS (SELECT 1 FROM em_lex l WHERE l.lang = t.lang AND l.word = t.typed) GROUP BY lang, typed),
em_wv AS (SELECT lang, word, n, {_sql_variants('word')} AS variant FROM em_typed),
em_lv AS (SELECT lang, word AS cand, freq, {_sql_variants('word')} AS variant FROM em_lex),
em_near AS MATERIALIZED (SELECT DISTINCT w.lang, w.word, w.n, l.cand, l.freq FROM em_wv w JOIN em_lv l ON w.lang = l.lang AND w.variant = l.variant),
em_p AS (SELECT *, len(list_filter(range(1, least(length(word), length(cand)) + 1), lambda i: substr(word, 1, i) = substr(cand, 1, i))) AS p FROM em_near),
em_s AS (SELECT *, len(list_filter(range(1, least(length(word), length(cand)) - p + 1), lambda i: right(word, i) = right(cand, i))) AS s FROM em_p),
em_core AS (SELECT *, substr(word, p + 1, length(word) - p - s) AS x, substr(cand, p + 1, length(cand) - p - s) AS y,
  CASE WHEN p > 0 THEN substr(cand, p, 1) ELSE '^' END AS b FROM em_s),
em_pairs AS MATERIALIZED (SELECT lang, word, n, cand, freq, CASE
  WHEN x = '' AND length(y) = 1 THEN [{{'was': b || y, 'typed': b}}]
  WHEN y = '' AND length(x) = 1 THEN [{{'was': b, 'typed': b || x}}]
  WHEN length(x) = 1 AND length(y) = 1 THEN [{{'was': y, 'typed': x}}]
  WHEN length(x) = 2 AND length(y) = 2 AND x = reverse(y) THEN [{{'was': y, 'typed': x}}]
  WHEN substr(x, 2) = substr(y, 1, length(y) - 1) THEN [{{'was': b, 'typed': b || x[1]}}, {{'was': right(y, 2), 'typed': substr(y, length(y) - 1, 1)}}]
  ELSE [{{'was': b || y[1], 'typed': b}}, {{'was': substr(x, length(x) - 1, 1), 'typed': right(x, 2)}}] END AS ops FROM em_core),
em_ops AS MATERIALIZED (SELECT DISTINCT lang, o.was AS was, o.typed AS typed FROM (SELECT lang, unnest(ops) AS o FROM em_pairs)),
em_letters AS (SELECT lang, freq, list_concat(['^'], string_split(word, '')) AS l FROM em_lex),
em_seen AS MATERIALIZED (SELECT lang, was, sum(freq)::BIGINT AS seen FROM (SELECT lang, freq, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]))) AS was FROM em_letters) GROUP BY lang, was),
em_cost0 AS (SELECT lang, was, typed, 2996::BIGINT AS cost FROM em_ops)""" + "".join(_sql_em_round(k) for k in range(1, _EM_ROUNDS + 1)) + f""",
em_all AS (SELECT p.lang, p.word, p.n, p.cand, p.freq, c1.cost + coalesce(c2.cost, 0) + round(-1000 * ln(p.freq::DOUBLE))::BIGINT AS cost
  FROM em_pairs p JOIN em_cost{_EM_ROUNDS} c1 ON c1.lang = p.lang AND c1.was = p.ops[1].was AND c1.typed = p.ops[1].typed
  LEFT JOIN em_cost{_EM_ROUNDS} c2 ON c2.lang = p.lang AND c2.was = p.ops[2].was AND c2.typed = p.ops[2].typed),
em_best AS MATERIALIZED (SELECT lang, word, cand, cost FROM em_all QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY cost, cand) = 1),
em_plain AS (SELECT lang, word, cand FROM em_near QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY levenshtein({O.one_byte('word')}, {O.one_byte('cand')}), freq DESC, cand) = 1)"""


def _error_model(spark, sf):
    """(typed words, stored pairs, lexicon, plain candidates, counted slips): the
    slips are made once, as counts of each (lang, typed, meant)."""
    from scrivener.operators import errors as ER
    from scrivener.operators.joins import materialize

    lex = materialize(LX.build_lexicon(FX.documents_as_given(spark, sf), "text"))
    slips = materialize(FX.counted_slips(spark, sf))
    oov = materialize(slips.groupBy("lang", F.col("typed").alias("word")).agg(F.sum("n").alias("n")).join(lex, ["lang", "word"], "left_anti"))
    cands = materialize(LX.candidates(oov.select("lang", "word"), lex))
    return oov, ER.prepare_pairs(cands, oov), lex, cands, slips


@register("confusions", _w(_EM_CTES, f"SELECT lang, was, typed, n, cost FROM em_cost{_EM_ROUNDS}"))
def q_confusions(spark, sf):
    """Edits learned from misspelled words by three rounds of EM."""
    from scrivener.operators import errors as ER

    _, pairs, lex, _, _ = _error_model(spark, sf)
    return ER.learn_confusions(pairs, lex, _EM_ROUNDS)


@register("best_candidate_learned", _w(_EM_CTES, "SELECT lang, word, cand, cost FROM em_best"))
def q_best_candidate_learned(spark, sf):
    """N4/N5 with the learned costs."""
    from scrivener.operators import errors as ER

    _, pairs, lex, _, _ = _error_model(spark, sf)
    return ER.best_learned(pairs, ER.learn_confusions(pairs, lex, _EM_ROUNDS))


@register(
    "error_model_accuracy",
    _w(_EM_CTES, """SELECT t.lang, count(*) AS n_typed, count(*) FILTER (b.cand = t.meant) AS right_learned, count(*) FILTER (d.cand = t.meant) AS right_distance
FROM fx_slips t JOIN em_typed o ON o.lang = t.lang AND o.word = t.typed LEFT JOIN em_best b ON b.lang = t.lang AND b.word = t.typed
LEFT JOIN em_plain d ON d.lang = t.lang AND d.word = t.typed GROUP BY t.lang"""),
)
def q_error_model_accuracy(spark, sf):
    """How many typed words get back what was meant: learned costs beside plain
    distance, on words typed with a slip."""
    from scrivener.operators import errors as ER

    oov, pairs, lex, cands, slips = _error_model(spark, sf)
    learned = ER.best_learned(pairs, ER.learn_confusions(pairs, lex, _EM_ROUNDS)).select("lang", F.col("word").alias("typed"), F.col("cand").alias("learned"))
    plain = LX.best(cands).select("lang", F.col("word").alias("typed"), F.col("cand").alias("plain"))
    t = slips.join(oov.select("lang", F.col("word").alias("typed")), ["lang", "typed"])
    t = t.join(learned, ["lang", "typed"], "left").join(plain, ["lang", "typed"], "left")
    right = lambda c: F.sum(F.when(F.col(c) == F.col("meant"), F.col("n")).otherwise(0))
    return t.groupBy("lang").agg(F.sum("n").alias("n_typed"), right("learned").alias("right_learned"), right("plain").alias("right_distance"))


# Candidates where a word limit moved.


def _sql_pairs(table: str, col: str) -> str:
    return f"""SELECT lang, u, v, count(*) AS n FROM (SELECT lang, unnest(w[1:len(w) - 1]) AS u, unnest(w[2:len(w)]) AS v
  FROM (SELECT lang, list_transform(regexp_extract_all({col}, '{LX.WORD_PATTERN}'), lambda x: lower(x)) AS w FROM {table}) WHERE len(w) > 1) GROUP BY lang, u, v"""


_SM_CTES = FX.SQL_MOVED_LINES + f""",
sm_lex AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{LX.WORD_PATTERN}')) AS word FROM fx_lines) GROUP BY lang, word),
sm_ref AS MATERIALIZED ({_sql_pairs('fx_lines', 'text')}),
sm_pairs AS MATERIALIZED ({_sql_pairs('fx_moved', 'moved_text')}),
sm_unknown AS MATERIALIZED (SELECT DISTINCT lang, word AS s FROM (SELECT lang, unnest(regexp_extract_all(lower(moved_text), '{LX.WORD_PATTERN}')) AS word FROM fx_moved) w
  WHERE NOT EXISTS (SELECT 1 FROM sm_lex l WHERE l.lang = w.lang AND l.word = w.word)),
sm_odd AS MATERIALIZED (SELECT lang, u || ' ' || v AS typed, u || v AS s, length(u) AS was FROM sm_pairs p
  WHERE EXISTS (SELECT 1 FROM sm_unknown x WHERE x.lang = p.lang AND x.s IN (p.u, p.v))),
sm_places AS (SELECT lang, s, unnest(range(1, length(s))) AS at FROM (SELECT lang, s FROM sm_unknown UNION SELECT lang, s FROM sm_odd)),
sm_cuts AS MATERIALIZED (SELECT p.lang, p.s, p.at, a.word AS a, b.word AS b, least(a.freq, b.freq) AS freq FROM sm_places p
  JOIN sm_lex a ON a.lang = p.lang AND a.word = substr(p.s, 1, p.at) JOIN sm_lex b ON b.lang = p.lang AND b.word = substr(p.s, p.at + 1)),
sm_all AS (
  SELECT c.lang, c.s AS typed, 'split' AS kind, a || ' ' || b AS cand, freq, a, b FROM sm_cuts c JOIN sm_unknown x ON x.lang = c.lang AND x.s = c.s
  UNION ALL SELECT c.lang, o.typed, 'shift', a || ' ' || b, freq, a, b FROM sm_cuts c JOIN sm_odd o ON o.lang = c.lang AND o.s = c.s AND c.at <> o.was
  UNION ALL SELECT o.lang, o.typed, 'merge', o.s, l.freq, NULL, NULL FROM sm_odd o JOIN sm_lex l ON l.lang = o.lang AND l.word = o.s),
sm_cand AS MATERIALIZED (SELECT x.lang, typed, kind, cand, freq, coalesce(r.n, 0) AS seen FROM sm_all x LEFT JOIN sm_ref r ON r.lang = x.lang AND r.u = x.a AND r.v = x.b)"""


def _boundary_cands(spark, sf):
    from scrivener.operators.boundaries import split_merge_candidates

    clean = FX.lines(spark, sf)
    return split_merge_candidates(FX.moved_lines(spark, sf), LX.build_lexicon(clean, "text"), "moved_text", reference=clean, ref_col="text")


@register("split_merge_candidates", _w(_SM_CTES, "SELECT lang, typed, kind, cand, freq, seen FROM sm_cand"))
def q_split_merge_candidates(spark, sf):
    """One word for two, two for one, or a moved limit."""
    return _boundary_cands(spark, sf)


@register("best_split_merge", _w(_SM_CTES, """SELECT lang, typed, kind, cand, freq, seen FROM sm_cand
QUALIFY row_number() OVER (PARTITION BY lang, typed ORDER BY seen DESC, freq DESC, cand, kind) = 1"""))
def q_best_split_merge(spark, sf):
    """N5 for moved word limits."""
    from scrivener.operators.boundaries import best_boundary

    return best_boundary(_boundary_cands(spark, sf))


# ---------------------------------------------------------------- step 7: validation, inventories



def _sql_num_text(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


def _sql_request_checks() -> list[str]:
    return [
        f"CASE WHEN input IS NULL AND NOT stdin THEN {O.q(V.MSG_NO_INPUT)} END",
        f"CASE WHEN input IS NOT NULL AND stdin THEN {O.q(V.MSG_BOTH_INPUTS)} END",
        f"CASE WHEN config IS NOT NULL AND local_path IS NULL THEN {O.q(V.MSG_CONFIG_NEEDS_PATH)} END",
        f"CASE WHEN NOT coalesce(temperature >= 0.0 AND temperature <= 2.0 AND NOT isnan(temperature), false) "
        f"THEN {O.q(V.MSG_TEMPERATURE)} || coalesce({_sql_num_text('temperature')}, 'null') END",
        f"CASE WHEN coalesce(max_tokens < 1 OR max_tokens > 512, true) THEN {O.q(V.MSG_MAX_TOKENS)} || coalesce(CAST(max_tokens AS VARCHAR), 'null') END",
    ]


@register(
    "validate_requests",
    _w(FX.SQL_REQUESTS, f"SELECT req_id, coalesce({', '.join(_sql_request_checks())}) AS error FROM fx_requests"),
)
def q_validate_requests(spark, sf):
    return V.validate_requests(FX.requests(spark, sf)).select("req_id", "error")


@register(
    "quarantine",
    _w(
        FX.SQL_REQUESTS,
        f"""SELECT req_id, CAST(len(errors) AS INTEGER) AS n_errors, errors FROM (
  SELECT req_id, list_filter([{', '.join(_sql_request_checks())}], lambda e: e IS NOT NULL) AS errors FROM fx_requests)
WHERE len(errors) > 0""",
    ),
)
def q_quarantine(spark, sf):
    _, bad = V.split_quarantine(FX.requests(spark, sf))
    return bad.select("req_id", F.size("errors").alias("n_errors"), "errors")


@register(
    "model_ids",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS model_id,
  coalesce(regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '^[^/]+/[^/]+$'), false) AS valid
FROM pages""",
)
def q_model_ids(spark, sf):
    from scrivener.sources.tables import read_table

    p = read_table(spark, sf, "pages")
    mid = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)
    return p.select("page_id", mid.alias("model_id"), V.valid_model_id(mid).alias("valid"))


def _sql_split_lines(c: str) -> str:
    parts = f"string_split_regex({c}, '\\r?\\n')"
    return f"CASE WHEN {parts}[len({parts})] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END"


@register(
    "stub_pages",
    f"""SELECT page_id, CAST(strlen(html) AS INTEGER) AS n_bytes,
  array_to_string({_sql_split_lines('html')}[1:3], ' ') AS preview
FROM pages WHERE strlen(html) < {V.STUB_BYTES}""",
)
def q_stub_pages(spark, sf):
    from scrivener.sources.tables import read_table

    p = V.stub_check(read_table(spark, sf, "pages"), "html")
    return p.where("is_stub").select("page_id", "n_bytes", "preview")


# The component naming rules first, then (ours) host rules for web pages.
URL_RULES = COMPONENT_RULES + [
    ("ads", "contains", ["ads-", "track"], []),
    ("spam", "contains", ["cheap-", "free-"], []),
    ("mobile", "prefix", ["m."], []),
    ("blog", "prefix", ["blog."], []),
]


def _sql_classify(c: str, rules=None) -> str:
    low = f"lower({c})"
    whens = []
    for label, kind, any_of, and_any in (rules or URL_RULES):
        fn = "starts_with" if kind == "prefix" else "contains"
        cond = " OR ".join(f"{fn}({low}, {O.q(s)})" for s in any_of)
        if and_any:
            cond = f"({cond}) AND (" + " OR ".join(f"contains({low}, {O.q(s)})" for s in and_any) + ")"
        whens.append(f"WHEN {cond} THEN {O.q(label)}")
    return "CASE " + " ".join(whens) + f" ELSE 'unknown_' || replace({low}, '.', '_') END"


@register(
    "classify_urls",
    f"""SELECT page_id, host, {_sql_classify('host')} AS kind FROM (
  SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)""",
)
def q_classify_urls(spark, sf):
    from scrivener.sources.tables import read_table

    p = read_table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return p.select("page_id", "host", V.classify_by_rules(F.col("host"), URL_RULES).alias("kind"))


@register(
    "classify_part_names",
    f"SELECT p_partkey, p_name, {_sql_classify('p_name', COMPONENT_RULES)} AS kind FROM part",
)
def q_classify_part_names(spark, sf):
    """V7 with the component rules alone on a second name column."""
    from scrivener.sources.tables import read_table

    p = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", "p_name", V.classify_by_rules(F.col("p_name"), COMPONENT_RULES).alias("kind"))


@register(
    "url_inventory",
    """SELECT dir, n_files FROM (
  SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir,
         CAST(sum(CAST(regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[0-9]+$') AS BIGINT)) AS BIGINT) AS n_files
  FROM pages GROUP BY 1) WHERE n_files > 0""",
)
def q_url_inventory(spark, sf):
    from scrivener.sources.tables import read_table

    return INV.directory_inventory(read_table(spark, sf, "pages"), "url", r"^[0-9]+$")


@register(
    "url_templates",
    "SELECT regexp_replace(url, '[0-9]+', '*', 'g') AS template, count(*) AS n FROM pages GROUP BY 1",
)
def q_url_templates(spark, sf):
    from scrivener.sources.tables import read_table

    return INV.name_templates(read_table(spark, sf, "pages"), "url")


_SQL_SHAPES = FX.SQL_RAGGED + """,
fx_declared AS (
  SELECT 'label_' || label AS component, 'vector' AS tensor, [1, CAST(max(len(embedding)) AS INTEGER)] AS shape FROM embeddings GROUP BY label
  UNION ALL
  SELECT 'label_' || label, 'batch', [CAST(count(*) AS INTEGER)] FROM embeddings GROUP BY label),
fx_observed AS (
  SELECT 'label_' || label AS component, 'vector' AS tensor, [1, CAST(max(len(vals)) AS INTEGER)] AS shape FROM fx_ragged GROUP BY label
  UNION ALL
  SELECT 'label_' || label, 'min_vector', [1, CAST(min(len(vals)) AS INTEGER)] FROM fx_ragged GROUP BY label)"""


@register(
    "shape_drift",
    _w(
        _SQL_SHAPES,
        """SELECT coalesce(d.component, o.component) AS component, coalesce(d.tensor, o.tensor) AS tensor,
  d.shape AS declared, o.shape AS observed,
  CASE WHEN o.shape IS NULL THEN 'missing' WHEN d.shape IS NULL THEN 'extra'
       WHEN d.shape IS NOT DISTINCT FROM o.shape THEN 'match' ELSE 'mismatch' END AS status
FROM fx_declared d FULL OUTER JOIN fx_observed o ON d.component = o.component AND d.tensor = o.tensor""",
    ),
)
def q_shape_drift(spark, sf):
    from scrivener.sources.tables import read_table

    e = read_table(spark, sf, "embeddings")
    comp = F.concat(F.lit("label_"), F.col("label").cast("string")).alias("component")

    def rows(*pairs):
        # One aggregate per side; its tensors come out as rows via inline.
        return F.inline(F.array(*[F.struct(F.lit(t).alias("tensor"), shape.alias("shape")) for t, shape in pairs]))

    d = e.groupBy("label").agg(F.max(F.size("embedding")).alias("mx"), F.count(F.lit(1)).cast("int").alias("n"))
    declared = d.select(comp, rows(("vector", F.array(F.lit(1), "mx")), ("batch", F.array("n"))))
    r = FX.ragged_vectors(spark, sf).groupBy("label").agg(
        F.max(F.size("vals")).alias("mx"), F.min(F.size("vals")).alias("mn")
    )
    observed = r.select(comp, rows(("vector", F.array(F.lit(1), "mx")), ("min_vector", F.array(F.lit(1), "mn"))))
    return INV.shape_drift(declared, observed)


# ---------------------------------------------------------------- step 8: tokens, arrays, shapes, latency


_TK_CTES = FX.SQL_LINES + f""",
tk_words AS (SELECT unnest(regexp_extract_all(lower(text), '{LX.WORD_PATTERN}')) AS word FROM fx_lines),
tk_vocab AS MATERIALIZED (SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, word) AS INTEGER) AS id
  FROM (SELECT word, count(*) AS freq FROM tk_words GROUP BY word)),
tk_toks AS (SELECT doc_id, line_no, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos
  FROM (SELECT doc_id, line_no, regexp_extract_all(lower(text), '{LX.WORD_PATTERN}') AS w FROM fx_lines)),
tk_enc0 AS MATERIALIZED (SELECT t.doc_id, t.line_no, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids
  FROM tk_toks t LEFT JOIN tk_vocab v ON t.word = v.word GROUP BY t.doc_id, t.line_no),
tk_enc AS MATERIALIZED (SELECT l.doc_id, l.line_no, coalesce(e.ids, CAST([] AS INTEGER[])) AS ids
  FROM fx_lines l LEFT JOIN tk_enc0 e ON l.doc_id = e.doc_id AND l.line_no = e.line_no)"""


def _vocab(spark, sf):
    # Word counts from whole documents (same words as the line table).
    return TK.build_vocab(FX.documents(spark, sf), "text")


def _encoded(spark, sf, vocab=None):
    return TK.encode(FX.lines(spark, sf), vocab if vocab is not None else _vocab(spark, sf), "text")


@register("vocabulary", _w(_TK_CTES, "SELECT word, freq, id FROM tk_vocab"))
def q_vocabulary(spark, sf):
    return _vocab(spark, sf).select("word", "freq", "id")


@register("encode", _w(_TK_CTES, "SELECT doc_id, line_no, ids FROM tk_enc"))
def q_encode(spark, sf):
    return _encoded(spark, sf)


@register(
    "decode",
    _w(
        _TK_CTES + """,
tk_dec AS (SELECT t.doc_id, t.line_no, string_agg(coalesce(v.word, '<unk>'), ' ' ORDER BY t.pos) AS decoded
  FROM tk_toks t LEFT JOIN tk_vocab v ON t.word = v.word GROUP BY t.doc_id, t.line_no)""",
        """SELECT l.doc_id, l.line_no, coalesce(d.decoded, '') AS decoded
FROM fx_lines l LEFT JOIN tk_dec d ON l.doc_id = d.doc_id AND l.line_no = d.line_no""",
    ),
)
def q_decode(spark, sf):
    vocab = _vocab(spark, sf)
    return TK.decode(_encoded(spark, sf, vocab), vocab)


@register(
    "pad_truncate",
    _w(
        _TK_CTES,
        """SELECT doc_id, line_no, CAST(len(ids) AS INTEGER) AS n_ids, ids[1:128] AS truncated,
  CASE WHEN len(ids) >= 10 THEN list_resize(ids, 64, 0) END AS padded, ids[1:1] AS first_token, ids[1:10] AS preview,
  list_concat(ids, ids[1:3]) AS appended
FROM tk_enc""",
    ),
)
def q_pad_truncate(spark, sf):
    e = _encoded(spark, sf)
    ids = F.col("ids")
    padded = TK.pad_to(ids, 64, min_len=TK.MIN_BATCH_TOKENS)
    return e.select("doc_id", "line_no", F.size(ids).alias("n_ids"), TK.truncate(ids, 128).alias("truncated"),
                    padded.alias("padded"), F.slice(ids, 1, 1).alias("first_token"),
                    TK.preview(ids, 10).alias("preview"), TK.append_tokens(ids, F.slice(ids, 1, 3)).alias("appended"))


@register(
    "context_budget",
    _w(
        _NB_LINES_SQL,
        f"""SELECT doc_id, line_no, n_tokens, n_tokens + 25 <= 256 AS fits FROM (
  SELECT doc_id, line_no, CAST(len(regexp_extract_all(lower({_sql_prompt(P.render_header())}), '{LX.WORD_PATTERN}')) AS INTEGER) AS n_tokens
  FROM fx_nb_lines)""",
    ),
)
def q_context_budget(spark, sf):
    from scrivener.operators.validate import context_budget

    df = _nb_lines(spark, sf).withColumn("prompt", P.few_shot_prompt(F.col("text")))
    n = F.size(F.regexp_extract_all(F.lower("prompt"), F.lit(LX.WORD_PATTERN), 0))
    return df.select("doc_id", "line_no", n.alias("n_tokens")).withColumn(
        "fits", context_budget(F.col("n_tokens"), 25))


@register(
    "concat_parts",
    _w(FX.SQL_PARTS, """SELECT vec_id, flatten(list(vals ORDER BY part_no)) AS vals, count(*) AS n_parts,
  CAST(sum(len(vals)) AS BIGINT) AS total_size FROM fx_parts_v GROUP BY vec_id"""),
)
def q_concat_parts(spark, sf):
    return TK.concat_parts(FX.vector_parts(spark, sf)).select(
        "vec_id", "vals", "n_parts", F.col("total_size").cast("long").alias("total_size"))


@register(
    "top5_indices",
    """SELECT vec_id, list_transform(list_grade_up(embedding, 'DESC')[1:5], lambda x: CAST(x - 1 AS INTEGER)) AS top5
FROM embeddings""",
)
def q_top5_indices(spark, sf):
    from scrivener.sources.tables import read_table

    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", TK.top_k_indices(F.col("embedding"), 5).alias("top5"))


@register(
    "array_range",
    """SELECT label, min(list_min(embedding)) AS min_val, max(list_max(embedding)) AS max_val, count(*) AS n
FROM embeddings GROUP BY label""",
)
def q_array_range(spark, sf):
    from scrivener.sources.tables import read_table

    return TK.value_range(read_table(spark, sf, "embeddings"), "embedding")


@register(
    "shape_profile",
    _w(FX.SQL_RAGGED, """SELECT label, CAST(min(sz) AS INTEGER) AS min_size, CAST(max(sz) AS INTEGER) AS max_size,
  CAST(arg_min(sz, (-c, sz)) AS INTEGER) AS common_size
FROM (SELECT label, len(vals) AS sz, count(*) OVER (PARTITION BY label, len(vals)) AS c FROM fx_ragged)
GROUP BY label"""),
)
def q_shape_profile(spark, sf):
    return TK.shape_profile(FX.ragged_vectors(spark, sf), "vals")


_SQL_SHAPE_MSG = f"""{O.q(V.SHAPE_MSG[0])} || CAST(len(vals) AS VARCHAR) || {O.q(V.SHAPE_MSG[1])} || '64' || {O.q(V.SHAPE_MSG[2])}"""


@register(
    "shape_conformance",
    _w(FX.SQL_RAGGED, f"SELECT vec_id, {_SQL_SHAPE_MSG} AS message FROM fx_ragged WHERE len(vals) <> 64"),
)
def q_shape_conformance(spark, sf):
    _, bad = V.shape_conformance(FX.ragged_vectors(spark, sf), "vals", 64)
    return bad.select("vec_id", "message")


@register(
    "mismatch_log",
    _w(
        FX.SQL_RAGGED,
        f"""SELECT vec_id, regexp_extract(message, 'MultiArray shape \\(([^)]*)\\).*the shape \\(([^)]*)\\)', 1) AS actual,
  regexp_extract(message, 'MultiArray shape \\(([^)]*)\\).*the shape \\(([^)]*)\\)', 2) AS expected
FROM (SELECT vec_id, {_SQL_SHAPE_MSG} AS message FROM fx_ragged WHERE len(vals) <> 64)""",
    ),
)
def q_mismatch_log(spark, sf):
    _, bad = V.shape_conformance(FX.ragged_vectors(spark, sf), "vals", 64)
    actual, expected = V.parse_shape_message(F.col("message"))
    return bad.select("vec_id", actual.alias("actual"), expected.alias("expected"))


@register(
    "latency",
    _w(FX.SQL_RUN_LOG, """SELECT shape, count(*) AS runs, round(avg(ms), 6) AS mean_ms, round(1000.0 / avg(ms), 6) AS runs_per_sec,
  round(max(n_tokens) * 1000.0 / avg(ms), 6) AS tokens_per_sec FROM fx_run_log GROUP BY shape"""),
)
def q_latency(spark, sf):
    return EV.latency_profile(FX.run_log(spark, sf))


# ---------------------------------------------------------------- step 9: demo post-processing, model step, stream



@register(
    "first_sentence",
    _w(FX.SQL_TYPO_LINES, f"SELECT doc_id, line_no, {O.first_sentence('typo_text')} AS answer FROM fx_typo_lines"),
)
def q_first_sentence(spark, sf):
    df = FX.typo_lines(spark, sf)
    return df.select("doc_id", "line_no", EX.first_sentence(F.col("typo_text")).alias("answer"))


@register(
    "few_shot_postprocess",
    _w(FX.SQL_RAW_OUTPUTS, f"SELECT doc_id, line_no, {O.first_sentence(O.cut_role_markers(O.collapse_ws('raw_output')))} AS answer FROM fx_raw"),
)
def q_few_shot_postprocess(spark, sf):
    df = FX.raw_outputs(spark, sf).select("doc_id", "line_no", "raw_output")
    return EX.few_shot_postprocess(df, "raw_output", "answer").select("doc_id", "line_no", "answer")


_NG_SELECT = "SELECT doc_id, line_no, raw_output FROM ng_raw"


def _recursive(ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + body


@register("generate_ngram", _recursive(FX.SQL_TYPO_LINES + "," + ngram_ctes("fx_typo_lines", "typo_text", "fx_lines", "text"), _NG_SELECT))
def q_generate_ngram(spark, sf):
    """G1/G2 at temperature 0: every line decoded over its lattice by the
    bigram model of the clean lines."""
    from scrivener.operators.ngram import generate_ngram

    return generate_ngram(FX.typo_lines(spark, sf), "typo_text", reference=FX.lines(spark, sf), ref_col="text")


@register("generate_ngram_sampled", _recursive(FX.SQL_TYPO_LINES + "," + ngram_ctes("fx_typo_lines", "typo_text", "fx_lines", "text", 0.8, 5, None, 42), _NG_SELECT))
def q_generate_ngram_sampled(spark, sf):
    """G1/G2 at temperature 0.8 among the 5 best options a word, seed 42."""
    from scrivener.operators.ngram import generate_ngram

    return generate_ngram(FX.typo_lines(spark, sf), "typo_text", reference=FX.lines(spark, sf), ref_col="text", temperature=0.8, top_k=5, seed=42)


def stream_df(spark, sf):
    from scrivener.sources.tables import read_table
    from scrivener.streaming.corrections import run_to_table

    schema = read_table(spark, sf, "documents").schema

    def prepare(s):
        text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(FX.BLANK_SUFFIX))).otherwise(F.col("text"))
        return s.select("doc_id", text.alias("text"), "lang", "source")

    out = run_to_table(spark, f"{sf.rstrip('/')}/documents.parquet", schema, prepare=prepare, keep=["lang", "source"],
                       add_typos=FX.inject_typos)
    return out.select("doc_id", "line_no", F.col("typo_text").alias("text"), "corrected", "changed")


register("stream_equals_batch", ORACLE["correct_lines"])(stream_df)


# ---------------------------------------------------------------- coverage: S2, S3, F2, F3, E8, E9, other tables


@register(
    "trim_input",
    _w(FX.SQL_DOCUMENTS, f"SELECT doc_id, {O.utrim('text')} AS text FROM fx_documents"),
)
def q_trim_input(spark, sf):
    from scrivener.operators.lines import trim_input

    return trim_input(FX.documents(spark, sf)).select("doc_id", "text")


_SR_CTES, _SR_T = O.sanitize_ctes("fx_single", "text", "corrected", prefix="sr")


@register(
    "single_records",
    _w(
        FX.SQL_DOCUMENTS + f",\nfx_single AS (SELECT doc_id, CAST(0 AS INTEGER) AS line_no, {FX._sql_inject('text')} AS text FROM fx_documents),"
        + _SR_CTES,
        f"SELECT doc_id, line_no, corrected FROM {_SR_T}",
    ),
)
def q_single_records(spark, sf):
    """S3: one unit of work per document (blanks kept), dictionary-corrected."""
    from scrivener.functions.sanitize import sanitize_steps
    from scrivener.operators.lines import as_single

    d = FX.documents(spark, sf).withColumn("text", FX.inject_typos(F.col("text")))
    return sanitize_steps(as_single(d), "text", "corrected").select("doc_id", "line_no", "corrected")


_FT_EX, _FT_EX_T = O.extract_ctes("fx_nb", "typo_text", "extracted", prefix="fx2")
_FT_SZ, _FT_SZ_T = O.sanitize_ctes(_FT_EX_T, "extracted", "corrected", prefix="fs2")


@register(
    "fix_typos",
    _w(
        FX.SQL_TYPO_LINES + f",\nfx_nb AS (SELECT * FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> '')," + _FT_EX + "," + _FT_SZ,
        f"SELECT doc_id, line_no, corrected, status FROM {_FT_SZ_T}",
    ),
)
def q_fix_typos(spark, sf):
    """the defaults form with the dictionary backend (the line itself is
    the raw answer, then extraction and sanitising)."""
    from scrivener.plans.correct import fix_typos

    return fix_typos(FX.typo_lines(spark, sf), "typo_text").select("doc_id", "line_no", "corrected", "status")


_TR_EX, _TR_EX_T = O.extract_ctes("tr_raw", "raw_output", "extracted", prefix="tx")
_TR_SZ, _TR_SZ_T = O.sanitize_ctes(_TR_EX_T, "extracted", "corrected", prefix="ts")
_TR_CTES = (
    FX.SQL_TYPO_LINES
    + f""",
tr_counts AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM
  (SELECT lang, unnest(regexp_extract_all(lower(typo_text), '{LX.WORD_PATTERN}')) AS word FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> '') GROUP BY lang, word),
tr_w AS (SELECT lang, word, freq, {_sql_variants('word')} AS variant FROM tr_counts),
tr_pairs AS (SELECT DISTINCT w.lang, w.word, w.freq AS own, c.word AS cand, c.freq FROM tr_w w JOIN tr_w c
  ON w.lang = c.lang AND w.variant = c.variant AND w.word <> c.word AND c.freq >= {LX.DEFAULT_RATIO} * w.freq),
tr_scored AS (SELECT *, CAST(levenshtein({O.one_byte('word')}, {O.one_byte('cand')}) AS INTEGER) AS dist FROM tr_pairs),
tr_best AS MATERIALIZED (SELECT lang, word, cand, dist, freq FROM tr_scored WHERE freq >= pow({LX.DEFAULT_RATIO}, dist) * own
  QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY dist, freq DESC, cand) = 1),
tr_toks AS (SELECT doc_id, line_no, lang, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos
  FROM (SELECT doc_id, line_no, lang, regexp_extract_all(typo_text, '{O.TOKEN_RE}') AS t FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> '')),
tr_fixed AS (SELECT t.doc_id, t.line_no, string_agg(coalesce(b.cand, t.tok), '' ORDER BY t.pos) AS raw_output
  FROM tr_toks t LEFT JOIN tr_best b ON t.lang = b.lang AND lower(t.tok) = b.word GROUP BY t.doc_id, t.line_no),
tr_raw AS (SELECT l.*, f.raw_output FROM fx_typo_lines l JOIN tr_fixed f ON l.doc_id = f.doc_id AND l.line_no = f.line_no),"""
    + _TR_EX + "," + _TR_SZ
)


def _trained(spark, sf, job):
    return job(FX.typo_lines(spark, sf)).select("doc_id", "line_no", F.col("typo_text").alias("text"), "corrected", "status", "changed")


_TR_SQL = f"SELECT doc_id, line_no, typo_text AS text, corrected, status, corrected <> typo_text AS changed FROM {_TR_SZ_T}"


@register("correct_corpus_trained", _w(_TR_CTES, _TR_SQL))
def q_correct_corpus_trained(spark, sf):
    from scrivener.plans.correct import correct_corpus

    return _trained(spark, sf, lambda df: correct_corpus(df, "typo_text", backend="corpus"))


_NO_EX, _NO_EX_T = O.extract_ctes("ng_raw", "raw_output", "extracted", prefix="nx")
_NO_SZ, _NO_SZ_T = O.sanitize_ctes(_NO_EX_T, "extracted", "corrected", prefix="ns")


@register(
    "fix_typos_with_options",
    _recursive(
        FX.SQL_TYPO_LINES + f",\nfx_nb AS (SELECT * FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> ''),"
        + ngram_ctes("fx_nb", "typo_text", "fx_nb", "typo_text", 0.5, 40, 50) + "," + _NO_EX + "," + _NO_SZ,
        f"SELECT doc_id, line_no, typo_text AS text, corrected, status, corrected <> typo_text AS changed FROM {_NO_SZ_T}",
    ),
)
def q_fix_typos_with_options(spark, sf):
    """explicit settings, on the n-gram generator trained on the lines
    themselves: drawn at temperature 0.5, the first 50 words of a line."""
    from scrivener.plans.correct import fix_typos_with_options

    return _trained(spark, sf, lambda df: fix_typos_with_options(df, 0.5, 50, text_col="typo_text", backend="ngram"))


@register(
    "trained_corrections",
    _w(_TR_CTES, "SELECT lang, word, cand, dist, freq FROM tr_best"),
)
def q_trained_corrections(spark, sf):
    from scrivener.operators.lines import drop_blank

    return LX.train_corrections(drop_blank(FX.typo_lines(spark, sf), "typo_text"), "typo_text")


@register("stream_trained_corrections", _w(_TR_CTES, "SELECT lang, word, cand, dist, freq FROM tr_best"))
def q_stream_trained_corrections(spark, sf):
    """ST1 on the corpus backend: the documents as a stream of files, word
    counts merged batch by batch, corrections of the last version."""
    import uuid

    from scrivener.operators.lines import drop_blank, explode_lines
    from scrivener.session import scratch_path
    from scrivener.streaming.learned import learn_files

    # The stand-in for files that arrive one after the other.
    docs, source = FX.documents(spark, sf), scratch_path(spark, f"arrivals-{uuid.uuid4().hex}")
    docs.repartition(6).write.parquet(source)

    def prepare(stream):
        lines = explode_lines(stream, keep=["lang", "source"])
        return drop_blank(lines.withColumn("typo_text", FX.inject_typos(F.col("text"))), "typo_text")

    return learn_files(spark, source, docs.schema, prepare, "typo_text", files_per_batch=2, merge_every=2)


@register("collapse_whitespace", _w(FX.SQL_RAW_OUTPUTS, f"SELECT doc_id, line_no, {O.collapse_ws('raw_output')} AS collapsed FROM fx_raw"))
def q_collapse_whitespace(spark, sf):
    from scrivener.functions.text import collapse_ws

    return FX.raw_outputs(spark, sf).select("doc_id", "line_no", collapse_ws(F.col("raw_output")).alias("collapsed"))


@register("role_markers", _w(FX.SQL_RAW_OUTPUTS, f"SELECT doc_id, line_no, {O.cut_role_markers('raw_output')} AS cut FROM fx_raw"))
def q_role_markers(spark, sf):
    return FX.raw_outputs(spark, sf).select("doc_id", "line_no", EX.cut_role_markers(F.col("raw_output")).alias("cut"))


_CONV_CTES = """
cv_parts AS (SELECT conv_id, turn, role, string_split_regex(text, '\\r?\\n') AS p FROM conversations WHERE text IS NOT NULL),
cv_kept AS (SELECT conv_id, turn, role, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS q FROM cv_parts),
cv_lines0 AS (SELECT conv_id, turn, role, unnest(q) AS raw_line, CAST(unnest(generate_series(0, len(q) - 1)) AS INTEGER) AS line_no FROM cv_kept),
cv_lines AS (SELECT conv_id, turn, role, line_no, raw_line AS text FROM cv_lines0),
cv_typo AS (SELECT *, """ + FX._sql_inject("text") + f""" AS typo_text FROM cv_lines WHERE {O.utrim('text')} <> '')"""
_CV_SZ, _CV_SZ_T = O.sanitize_ctes("cv_typo", "typo_text", "corrected", prefix="cvs")


@register(
    "correct_conversations",
    "WITH " + _CONV_CTES.strip() + "," + _CV_SZ + f"""
SELECT conv_id, turn, line_no, role, corrected, corrected <> typo_text AS changed FROM {_CV_SZ_T}""",
)
def q_correct_conversations(spark, sf):
    """The same correction job on a second text table, keyed (conv_id, turn, line_no)."""
    from scrivener.operators.lines import drop_blank, split_lines
    from scrivener.sources.tables import read_table

    c = read_table(spark, sf, "conversations")
    lines = c.select("conv_id", "turn", "role", F.posexplode(split_lines(F.col("text"))).alias("line_no", "text"))
    lines = drop_blank(lines.withColumn("line_no", F.col("line_no").cast("int")))
    from scrivener.functions.sanitize import sanitize_steps

    out = sanitize_steps(lines.withColumn("typo_text", FX.inject_typos(F.col("text"))), "typo_text", "corrected")
    return out.select("conv_id", "turn", "line_no", "role", "corrected",
                      (F.col("corrected") != F.col("typo_text")).alias("changed"))


@register(
    "changed_by_label",
    _w(_CL_ALL, """SELECT lb.quality, lb.toxic, count(*) AS n_lines, round(avg(CAST(c.changed AS INTEGER)), 6) AS changed_rate
FROM fx_cl c JOIN labels lb ON c.doc_id = lb.doc_id GROUP BY lb.quality, lb.toxic"""),
)
def q_changed_by_label(spark, sf):
    """A1 split by the quality labels (inner join: labels cover some
    documents).  Lines are first summed per document (map-side partial
    aggregation), so the join sees one row per document, however many lines
    a document has."""
    from scrivener.sources.tables import read_table

    per_doc = _cl(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("changed").cast("long")).alias("n_changed"))
    labels = read_table(spark, sf, "labels", spread=False).select("doc_id", "quality", "toxic")
    j = per_doc.join(labels, "doc_id", "inner")
    return j.groupBy("quality", "toxic").agg(
        F.sum("n").alias("n_lines"),
        F.round(F.sum("n_changed") / F.sum("n"), 6).alias("changed_rate"),
    )


_BM_SZ, _BM_SZ_T = O.sanitize_ctes("bm_typo", "typo_text", "corrected", prefix="bms")


@register(
    "benchmark_accuracy",
    """WITH bm_parts AS (SELECT item_id, string_split_regex(text, '\\r?\\n') AS p FROM benchmark WHERE text IS NOT NULL),
bm_kept AS (SELECT item_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS q FROM bm_parts),
bm_lines AS (SELECT item_id, unnest(q) AS text, CAST(unnest(generate_series(0, len(q) - 1)) AS INTEGER) AS line_no FROM bm_kept),
bm_typo AS (SELECT *, """ + FX._sql_inject("text") + f""" AS typo_text FROM bm_lines WHERE {O.utrim('text')} <> ''),"""
    + _BM_SZ
    + f"""
SELECT count(*) AS n_lines, CAST(sum(CAST(typo_text <> text AS INTEGER)) AS BIGINT) AS n_with_typos,
  CAST(sum(CAST(corrected = text AS INTEGER)) AS BIGINT) AS n_exact,
  round(avg(CAST(corrected = text AS INTEGER)), 6) AS accuracy
FROM {_BM_SZ_T}""",
)
def q_benchmark_accuracy(spark, sf):
    """A3 on the benchmark passages: typos injected into the clean text, the
    dictionary job run, exact-match share against the clean line."""
    from scrivener.operators.lines import drop_blank, explode_lines
    from scrivener.functions.sanitize import sanitize_steps
    from scrivener.sources.tables import read_table

    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    lines = drop_blank(explode_lines(b)).withColumn("typo_text", FX.inject_typos(F.col("text")))
    out = sanitize_steps(lines, "typo_text", "corrected")
    exact = (F.col("corrected") == F.col("text")).cast("int")
    return out.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum((F.col("typo_text") != F.col("text")).cast("long")).alias("n_with_typos"),
        F.sum(exact.cast("long")).alias("n_exact"),
        F.round(F.avg(exact), 6).alias("accuracy"),
    )


# ---------------------------------------------------------------- comparison of runs, uncertainty, templates


_RD_CTES = _TR_CTES + f""",
fx_nb AS (SELECT * FROM fx_typo_lines WHERE {O.utrim('typo_text')} <> ''),""" + _FT_EX + "," + _FT_SZ + f""",
rd_a AS (SELECT doc_id, line_no, corrected, count(*) AS n FROM {_FT_SZ_T} GROUP BY ALL),
rd_b AS (SELECT doc_id, line_no, corrected, count(*) AS n FROM {_TR_SZ_T} GROUP BY ALL)"""


def _two_runs(spark, sf):
    """The dictionary and the corpus backend over the same lines, stored."""
    from scrivener.operators.rundiff import store_run
    from scrivener.plans.correct import correct_corpus

    lines = FX.typo_lines(spark, sf)
    return [store_run(correct_corpus(lines, "typo_text", backend=b).select("doc_id", "line_no", "corrected")) for b in ("dictionary", "corpus")]


@register("run_diff", _w(_RD_CTES, """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.corrected, b.corrected) AS corrected,
  coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
FROM rd_a a FULL OUTER JOIN rd_b b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.corrected IS NOT DISTINCT FROM b.corrected WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""))
def q_run_diff(spark, sf):
    """A5: the rows in which two stored runs differ, found through fingerprints."""
    from scrivener.operators.rundiff import run_diff

    return run_diff(*_two_runs(spark, sf))


def _sql_interval(value: str, by: str) -> str:
    """Poisson bootstrap bounds of ``value`` over bs_rows (key k, group ``by``)."""
    from scrivener.operators import bootstrap as BS

    weight = " + ".join(f"(u >= {t})::INTEGER" for t in BS.POISSON)
    group, lead = (f"{by}, ", f"{by}, ") if by else ("", "")
    own = f"GROUP BY {by}" if by else ""
    return f""",
bs_v AS (SELECT {lead}k, ({value})::DOUBLE AS v FROM bs_rows),
bs_u AS (SELECT {lead}v, r, ('0x' || substr(md5(k || '|' || (r // {BS.PER_HASH})), (r % {BS.PER_HASH}) * 4 + 1, 4))::INTEGER AS u FROM bs_v, range(0, {BS.REPLICAS}) t(r) WHERE v IS NOT NULL),
bs_m AS (SELECT {lead}r, sum(w * v) / sum(w) AS m FROM (SELECT {lead}v, r, {weight} AS w FROM bs_u) WHERE w > 0 GROUP BY {group}r),
bs_l AS (SELECT {lead}list(m ORDER BY m) AS l FROM bs_m {own}),
bs_n AS (SELECT {lead}count(v) AS n, avg(v) AS mean FROM bs_v {own})
SELECT {'bs_n.' + by + ', ' if by else ''}n, round(mean, 6) AS mean, round(l[1 + floor(0.025 * len(l))::INTEGER], 6) AS lo, round(l[len(l) - floor(0.025 * len(l))::INTEGER], 6) AS hi
FROM bs_n JOIN bs_l ON {f'bs_n.{by} IS NOT DISTINCT FROM bs_l.{by}' if by else 'true'}"""


_BS_KEY = "p.doc_id || '|' || p.line_no"


@register(
    "accuracy_interval",
    _w(_CL_ALL + f""",
bs_rows AS (SELECT p.lang, {_BS_KEY} AS k, coalesce(p.corrected = r.text, false)::INTEGER AS ok FROM fx_cl p JOIN fx_lines r ON p.doc_id = r.doc_id AND p.line_no = r.line_no)"""
       + _sql_interval("ok", "lang"), ""),
)
def q_accuracy_interval(spark, sf):
    """A3 with the bounds of 96 bootstrap replicas."""
    from scrivener.operators.bootstrap import accuracy_interval

    return accuracy_interval(_cl(spark, sf).drop("expected").withColumnRenamed("original", "expected"))


@register(
    "win_interval",
    _w(_RD_CTES + f""",
bs_rows AS (SELECT p.doc_id || '|' || p.line_no AS k, coalesce(p.corrected = l.text, false)::INTEGER - coalesce(t.corrected = l.text, false)::INTEGER AS d
  FROM {_FT_SZ_T} p JOIN {_TR_SZ_T} t ON p.doc_id = t.doc_id AND p.line_no = t.line_no JOIN fx_lines l ON l.doc_id = p.doc_id AND l.line_no = p.line_no)"""
       + _sql_interval("d", ""), ""),
)
def q_win_interval(spark, sf):
    """A6 with its bounds: dictionary against corpus backend."""
    from scrivener.operators.bootstrap import win_interval
    from scrivener.plans.correct import correct_corpus

    lines = FX.typo_lines(spark, sf)
    a = correct_corpus(lines, "typo_text").select("doc_id", "line_no", F.col("text").alias("expected"), F.col("corrected").alias("out_a"))
    b = correct_corpus(lines, "typo_text", backend="corpus").select("doc_id", "line_no", F.col("corrected").alias("out_b"))
    return win_interval(a.join(b, ["doc_id", "line_no"]), "out_a", "out_b")


def _sql_templates() -> str:
    from scrivener.operators import templates as TP

    out = """lt0 AS (SELECT p, n, len(p) AS n_parts, []::VARCHAR[] AS t FROM (SELECT p, count(*) AS n FROM (
  SELECT string_split(regexp_replace(regexp_replace(url, '^[^:/?#]*://', ''), '[?#].*$', ''), '/') AS p FROM pages WHERE url IS NOT NULL) GROUP BY p))"""
    for k in range(TP.DEPTH):
        out += f""",
lk{k} AS (SELECT n_parts, t, count(DISTINCT p[{k + 1}]) AS kinds FROM lt{k} WHERE n_parts > {k} GROUP BY n_parts, t),
lt{k + 1} AS (SELECT x.p, x.n, x.n_parts, CASE WHEN x.n_parts > {k} THEN list_append(x.t, CASE WHEN kinds > {TP.MOST_VALUES} THEN '*' ELSE x.p[{k + 1}] END) ELSE x.t END AS t
  FROM lt{k} x LEFT JOIN lk{k} y ON x.n_parts = y.n_parts AND x.t = y.t)"""
    return _w(out, f"""SELECT array_to_string(list_concat(t, list_transform(range(0, greatest(n_parts - {TP.DEPTH}, 0)), lambda i: '*')), '/') AS template,
  n_parts::INTEGER AS n_parts, sum(n)::BIGINT AS n FROM lt{TP.DEPTH} GROUP BY 1, 2""")


@register("learned_templates", _sql_templates())
def q_learned_templates(spark, sf):
    """Url templates learned from all pages; a place with more than 8
    different values is variable."""
    from scrivener.operators.templates import learned_templates, url_parts
    from scrivener.sources.tables import read_table

    return learned_templates(read_table(spark, sf, "pages"), url_parts(F.col("url")))
