"""Batch job entry point for ``spark-submit`` (or ``python -m scrivener.jobs``).

The reference is driven from a command line (single text or a whole input,
text / JSON / verbose output, temperature and token budget).  Here the same
choices select a Spark job: read a folder of text files or a Parquet table,
correct it in single or batch mode, write JSON Lines or text in parallel.

    python -m scrivener.jobs --input docs/ --input-format text --mode batch \
        --output-format json --output out/
    python -m scrivener.jobs --input t.parquet --input-format parquet --id-col doc_id --text-col text ...

The settings are checked with the same rules as the reference's arguments
before any data is read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from scrivener.operators.validate import request_error_scalar
from scrivener.plans.corrector import OUTPUT_FORMATS, Corrector
from scrivener.session import get_session
from scrivener.sources.fixed import DEFAULT_MAX_TOKENS, DEFAULT_TEMPERATURE
from scrivener.sinks.writers import json_envelope, render_batch_report
from scrivener.sources.tables import read_text_files, read_text_lines


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrivener.jobs", description="Correct typing errors in a text corpus on Spark.")
    p.add_argument("--input", required=True, help="folder of text files, or a Parquet path")
    p.add_argument("--input-format", choices=("text", "parquet"), default="text")
    p.add_argument("--id-col", default="doc_id")
    p.add_argument("--text-col", default="text")
    p.add_argument("--mode", choices=("batch", "single"), default="batch",
                   help="batch: trim, split into lines, skip blank lines; single: one unit per input row")
    p.add_argument("--output", required=True, help="output folder")
    p.add_argument("--output-format", choices=OUTPUT_FORMATS, default="text")
    p.add_argument("--backend", choices=("dictionary", "corpus", "ngram"), default="dictionary",
                   help="dictionary: the fixed rules; corpus: corrections learned from the input's own word frequencies; "
                        "ngram: lines generated by a bigram model of the input (temperature and max-tokens act here)")
    p.add_argument("--model", default="dictionary", help="model name recorded in JSON output")
    p.add_argument("--temperature", type=float, default=DEFAULT_TEMPERATURE)
    p.add_argument("--max-tokens", type=int, default=DEFAULT_MAX_TOKENS)
    p.add_argument("--rules", help="rule table (typo, fixed) in place of the fixed rules: Parquet, or .json / .csv with a header; typos may be several words")
    p.add_argument("--examples", help="few-shot examples (ord, typo, fixed) in place of the fixed ones, in the same formats")
    return p


#: The examples go into every prompt, so their number is bounded.
MAX_EXAMPLES = 1_000


def _read_table(spark, path: str):
    if path.endswith(".json"):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    return spark.read.parquet(path)


def _corrector(spark, args) -> Corrector:
    rules = _read_table(spark, args.rules) if args.rules else None
    examples = None
    if args.examples:
        rows = _read_table(spark, args.examples).select(F.col("ord").cast("int"), "typo", "fixed").orderBy("ord").limit(MAX_EXAMPLES + 1).collect()
        if len(rows) > MAX_EXAMPLES:
            raise ValueError(f"more than {MAX_EXAMPLES} examples")
        examples = [tuple(r) for r in rows]
    return Corrector(backend=args.backend, model=args.model, rules=rules, examples=examples)


def _correct_text_lines(spark, args) -> int:
    """Batch mode over text files: read, corrected and written by line, in
    order of path and line; no file is ever one row."""
    c = _corrector(spark, args)
    lines = read_text_lines(spark, args.input)
    out = c.fix_typos_with_options(lines, args.temperature, args.max_tokens)
    if args.output_format == "text":
        value = out.orderBy("doc_id", "line_no").select(F.coalesce("corrected", F.lit("")).alias("value"))
    elif args.output_format == "json":
        value = json_envelope(out, args.model, args.temperature, args.max_tokens)
    else:
        value = render_batch_report(out, lines, args.model).orderBy("doc_id", "line_no").select(F.col("report").alias("value"))
    value.write.mode("overwrite").text(args.output)
    return 0


def main(argv=None) -> int:
    args = build_parser().parse_args(argv)
    err = request_error_scalar(True, False, None, None, args.temperature, args.max_tokens)
    if err:
        print(f"error: {err}", file=sys.stderr)
        return 2
    spark = get_session()
    if args.input_format == "text" and args.mode == "batch":
        return _correct_text_lines(spark, args)
    if args.input_format == "text":
        # Known by path: output comes in order of path, and no two files share an id.
        docs = read_text_files(spark, args.input)
        id_col, text_col = "path", "text"
    else:
        docs = spark.read.parquet(args.input)
        id_col, text_col = args.id_col, args.text_col
    c = _corrector(spark, args)
    run = c.correct_batch if args.mode == "batch" else c.correct_single
    out = run(docs, id_col, text_col, output=args.output_format, temperature=args.temperature,
              max_tokens=args.max_tokens)
    if args.output_format == "text":
        # Input order is carried by (doc_id, line_no); a range sort keeps it
        # across the part files without funnelling through one task.
        out.orderBy("doc_id", "line_no").select(F.col("corrected").alias("value")).write.mode("overwrite").text(args.output)
    else:
        col = "json" if args.output_format == "json" else "report"
        keys = [k for k in ("doc_id", "line_no") if k in out.columns]
        out.orderBy(*keys).select(F.col(col).alias("value")).write.mode("overwrite").text(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
