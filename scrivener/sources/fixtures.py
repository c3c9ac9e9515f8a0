"""Derived test tables, built from the given parquet tables.

The base ``documents`` contain none of the dictionary typos, markers or quotes,
so correctness queries run on tables derived from them by plain string
expressions.  Each derivation exists twice, as a Spark DataFrame builder and
as DuckDB SQL text (a list of CTEs) for the oracle; the two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions.text import sql_ws_literal
from scrivener.operators.lines import explode_lines
from scrivener.sources.tables import read_table

# Typo injection, literal and case-sensitive, applied in this order.
TYPO_INJECTIONS = [
    (" the ", " teh "),
    (" that ", " Sentance "),
    (" with ", " recieve "),
    (" this ", " SEPERATE "),
    (" are ", " cant "),
]

# Raw-generation shapes by (doc_id + line_no) % 8; '{t}' is the line.
RAW_SHAPES = [
    "{t}",
    "{t}<|endoftext|>{t}",
    "{t}\nInput: next\nOutput: next",
    "Output:\n{t}",
    "Input: {t}",
    '"{t}"',
    "{t} (Note: fixed)",
    "Fix typos in these sentences:\n\n{t}",
]
BLANK_SUFFIX = "\n   \nend"

WS = sql_ws_literal()


# ------------------------------------------------------------------ Spark side

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line added to every tenth one (exercises V1)."""
    d = read_table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(BLANK_SUFFIX))).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"), "lang", "source")


def documents_as_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text, lang, source)."""
    return explode_lines(documents(spark, sf_dir), keep=["lang", "source"])


def inject_typos(c):
    for src, dst in TYPO_INJECTIONS:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def typo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 plus ``typo_text``."""
    return lines(spark, sf_dir).withColumn("typo_text", inject_typos(F.col("text")))


def _shape(fmt: str, t):
    segs = fmt.split("{t}")
    items = []
    for i, seg in enumerate(segs):
        if seg:
            items.append(F.lit(seg))
        if i < len(segs) - 1:
            items.append(t)
    return F.concat(*items)


def raw_output_expr(doc_id, line_no, t):
    k = (doc_id + line_no) % 8
    expr = F.when(doc_id % 50 == 0, F.concat(F.lit("<|endoftext|>"), t))
    for i, fmt in enumerate(RAW_SHAPES):
        expr = expr.when(k == i, _shape(fmt, t))
    return expr


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, lang, source, typo_text, raw_output)."""
    df = typo_lines(spark, sf_dir)
    return df.select(
        "doc_id", "line_no", "lang", "source", "typo_text",
        raw_output_expr(F.col("doc_id"), F.col("line_no"), F.col("typo_text")).alias("raw_output"),
    )


# ------------------------------------------------------------------ DuckDB side

def _sql_str(s: str) -> str:
    """A DuckDB string expression for ``s`` (newlines via chr(10))."""
    pieces = s.split("\n")
    out = [("'" + p.replace("'", "''") + "'") for p in pieces]
    expr = " || chr(10) || ".join(out)
    return f"({expr})"


def _sql_shape(fmt: str, t: str = "t") -> str:
    segs = fmt.split("{t}")
    items = []
    for i, seg in enumerate(segs):
        if seg:
            items.append(_sql_str(seg))
        if i < len(segs) - 1:
            items.append(t)
    return "(" + " || ".join(items) + ")"


def _sql_inject(c: str) -> str:
    for src, dst in TYPO_INJECTIONS:
        c = f"replace({c}, '{src}', '{dst}')"
    return c


SQL_DOCUMENTS = f"""
fx_documents AS (
  SELECT doc_id, lang, source,
         CASE WHEN doc_id % 10 = 0 THEN text || {_sql_str(BLANK_SUFFIX)} ELSE text END AS text
  FROM documents)"""

SQL_LINES = SQL_DOCUMENTS + """,
fx_parts AS (
  SELECT doc_id, lang, source, string_split_regex(text, '\\r?\\n') AS p FROM fx_documents WHERE text IS NOT NULL),
fx_kept AS (
  SELECT doc_id, lang, source, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS q FROM fx_parts),
fx_lines0 AS (
  SELECT doc_id, lang, source, unnest(q) AS raw_line,
         CAST(unnest(generate_series(0, len(q) - 1)) AS INTEGER) AS line_no
  FROM fx_kept),
fx_lines AS (
  SELECT doc_id, line_no, lang, source, raw_line AS text FROM fx_lines0)"""

SQL_TYPO_LINES = SQL_LINES + f""",
fx_typo_lines AS (
  SELECT *, {_sql_inject('text')} AS typo_text FROM fx_lines)"""


def _sql_raw_case() -> str:
    whens = "\n".join(
        f"    WHEN (doc_id + line_no) % 8 = {i} THEN {_sql_shape(fmt, 'typo_text')}"
        for i, fmt in enumerate(RAW_SHAPES)
    )
    return f"""CASE WHEN doc_id % 50 = 0 THEN '<|endoftext|>' || typo_text
{whens}
  END"""


SQL_RAW_OUTPUTS = SQL_TYPO_LINES + f""",
fx_raw AS (
  SELECT doc_id, line_no, lang, source, typo_text,
  {_sql_raw_case()} AS raw_output
  FROM fx_typo_lines)"""


def with_ctes(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


# The word each injected typo must be corrected to.
TYPO_EXPECTED = [
    (" teh ", "the"),
    (" Sentance ", "sentence"),
    (" recieve ", "receive"),
    (" SEPERATE ", "separate"),
    (" cant ", "can't"),
]


def expected_words(typo_text):
    """Array of the fixes a line's injected typos call for (F5 from data)."""
    arr = F.array(*[F.when(typo_text.contains(k), F.lit(v)) for k, v in TYPO_EXPECTED])
    return F.filter(arr, lambda x: x.isNotNull())


def sql_expected_words(c: str = "typo_text") -> str:
    items = ", ".join(f"CASE WHEN contains({c}, '{k}') THEN '{v.replace(chr(39), chr(39) * 2)}' END" for k, v in TYPO_EXPECTED)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


# ------------------------------------------------------------------ requests (F8), vectors (F10), run log

def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: one request row per order."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("req_id"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("input"),
        (k % 7 == 0).alias("stdin"),
        F.when(k % 11 == 0, F.lit("c.json")).alias("config"),
        F.when(k % 22 == 0, F.lit("/m")).alias("local_path"),
        ((k % 30).cast("double") / F.lit(10.0)).alias("temperature"),
        (F.col("o_custkey") % 600).cast("int").alias("max_tokens"),
    )


SQL_REQUESTS = """
fx_requests AS (
  SELECT o_orderkey AS req_id,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS input,
         o_orderkey % 7 = 0 AS stdin,
         CASE WHEN o_orderkey % 11 = 0 THEN 'c.json' END AS config,
         CASE WHEN o_orderkey % 22 = 0 THEN '/m' END AS local_path,
         CAST(o_orderkey % 30 AS DOUBLE) / 10.0 AS temperature,
         CAST(o_custkey % 600 AS INTEGER) AS max_tokens
  FROM orders)"""


def ragged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 ragged: sizes 1..64 from the vector id."""
    e = read_table(spark, sf_dir, "embeddings")
    n = (F.lit(1) + F.col("vec_id") % 80).cast("int")
    return e.select("vec_id", "label", F.slice("embedding", F.lit(1), n).alias("vals"))


SQL_RAGGED = """
fx_ragged AS (SELECT vec_id, label, embedding[1:1 + vec_id % 80] AS vals FROM embeddings)"""


def vector_parts(spark: SparkSession, sf_dir: str, parts: int = 16) -> DataFrame:
    """F10 parts: each vector cut into ``parts`` equal slices (part_no 1..parts)."""
    e = read_table(spark, sf_dir, "embeddings")
    width = F.size("embedding") / parts
    return e.select(
        "vec_id", "label",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)),
                                 lambda i: F.slice("embedding", (i * width + 1).cast("int"), width.cast("int")))).alias("p", "vals"),
    ).select("vec_id", "label", (F.col("p") + 1).cast("int").alias("part_no"), "vals")


SQL_PARTS = """
fx_parts_v AS (
  SELECT vec_id, label, CAST(i + 1 AS INTEGER) AS part_no,
         embedding[CAST(i * len(embedding) / 16 + 1 AS BIGINT) : CAST((i + 1) * len(embedding) / 16 AS BIGINT)] AS vals
  FROM embeddings, range(0, 16) r(i))"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run log from events."""
    ev = read_table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.when(even, F.lit("1x1")).otherwise(F.lit("1x64")).alias("shape"),
        F.when(even, F.lit(1)).otherwise(F.lit(64)).alias("n_tokens"),
        F.col("value").alias("ms"),
    )


SQL_RUN_LOG = """
fx_run_log AS (
  SELECT event_id AS run_id, CASE WHEN event_id % 2 = 0 THEN '1x1' ELSE '1x64' END AS shape,
         CASE WHEN event_id % 2 = 0 THEN 1 ELSE 64 END AS n_tokens, value AS ms
  FROM events)"""


# ------------------------------------------------------------------ typed words with what was meant

# The vowel typed in place of each vowel.
VOWEL_SLIPS = ("aeiou", "eioua")


def _slip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    w = d.select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("meant"))
    slipped = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("meant"))), 1, 1) == "0"
    return w.select("lang", "meant", slipped.alias("slipped"))


def _slip(meant):
    kind = F.substring(F.md5(meant), 1, 1)
    vowel = F.regexp_extract(meant, "[aeiou]", 0)
    return (
        F.when(kind < "8", F.regexp_replace(meant, F.lit("^([^aeiou]*)[aeiou]"), F.concat(F.lit("$1"), F.translate(vowel, *VOWEL_SLIPS))))
        .when(kind < "c", F.concat(F.substring(meant, 1, 2), F.substr(meant, F.lit(4))))
        .otherwise(F.concat(F.substring(meant, 1, 1), F.substring(meant, 3, 1), F.substring(meant, 2, 1), F.substr(meant, F.lit(4))))
    )


def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, meant, typed), a row per word of the documents.  One word in 16 is
    typed with a slip that depends on the word: its first vowel changed, its third
    letter lost, or its second and third swapped."""
    meant = F.col("meant")
    return _slip_words(spark, sf_dir).select("lang", "meant", F.when(F.col("slipped"), _slip(meant)).otherwise(meant).alias("typed"))


def counted_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slips`` as (lang, typed, meant, n): the slip is made once for each distinct word."""
    meant = F.col("meant")
    n = _slip_words(spark, sf_dir).groupBy("lang", "meant", F.coalesce("slipped", F.lit(False)).alias("slipped")).agg(F.count(F.lit(1)).alias("n"))
    typed = n.select("lang", "meant", F.when(F.col("slipped"), _slip(meant)).otherwise(meant).alias("typed"), "n")
    return typed.groupBy("lang", "typed", "meant").agg(F.sum("n").alias("n"))


SQL_SLIPS = f"""
fx_slip_words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS meant FROM documents),
fx_slips AS MATERIALIZED (SELECT lang, meant, CASE WHEN substr(md5(doc_id || '|' || meant), 1, 1) <> '0' THEN meant
  WHEN substr(md5(meant), 1, 1) < '8' THEN regexp_replace(meant, '^([^aeiou]*)[aeiou]', '\\1' || translate(regexp_extract(meant, '[aeiou]', 0), '{VOWEL_SLIPS[0]}', '{VOWEL_SLIPS[1]}'))
  WHEN substr(md5(meant), 1, 1) < 'c' THEN substr(meant, 1, 2) || substr(meant, 4)
  ELSE substr(meant, 1, 1) || substr(meant, 3, 1) || substr(meant, 2, 1) || substr(meant, 4) END AS typed FROM fx_slip_words)"""


# ------------------------------------------------------------------ phrases

# Phrases put in place of words, literal and case-sensitive, in this order.
PHRASE_INJECTIONS = [
    (" and ", " alot of "),
    (" to ", " Could Of "),
    (" of ", " teh same "),
    (" a ", " in spite off "),
    (" de ", " alot "),
]
# Rules for them, with rules of one word inside others.
PHRASE_RULES = [
    ("alot of", "a lot of"),
    ("alot", "a lot"),
    ("could of", "could have"),
    ("teh same", "the same"),
    ("in spite off", "in spite of"),
]


def phrase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 plus ``phrase_text``, the typo text with phrases put in."""
    c = F.col("typo_text")
    for src, dst in PHRASE_INJECTIONS:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return typo_lines(spark, sf_dir).withColumn("phrase_text", c)


def _sql_phrases(c: str) -> str:
    for src, dst in PHRASE_INJECTIONS:
        c = f"replace({c}, '{src}', '{dst}')"
    return c


SQL_PHRASE_LINES = SQL_TYPO_LINES + f""",
fx_phrase_lines AS (SELECT *, {_sql_phrases('typo_text')} AS phrase_text FROM fx_typo_lines)"""


# ------------------------------------------------------------------ moved word limits

# Words with their limits lost, put in or moved, literal and case-sensitive, in this order.
MOVED_LIMITS = [
    (" of the ", " ofthe "),
    (" in the ", " i nthe "),
    (" that ", " th at "),
    (" with ", " wi th "),
    (" de la ", " del a "),
    (" una ", " un a "),
    (" is it ", " isit "),
]


def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 plus ``moved_text``."""
    c = F.col("text")
    for src, dst in MOVED_LIMITS:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return lines(spark, sf_dir).withColumn("moved_text", c)


def _sql_moved(c: str) -> str:
    for src, dst in MOVED_LIMITS:
        c = f"replace({c}, '{src}', '{dst}')"
    return c


SQL_MOVED_LINES = SQL_LINES + f""",
fx_moved AS (SELECT *, {_sql_moved('text')} AS moved_text FROM fx_lines)"""
