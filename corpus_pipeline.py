"""The corpus pipeline: five stages from ``documents`` to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and gives it to the next.

1. language: drop documents without any letter or text (``und``).
2. near_duplicates: of each SimHash component one document stays.
3. repeated_passages: bytes of 50-byte strings that an earlier document holds
   too go; characters cut in two go whole.  A text may become empty.
4. mix: each document as often as the source mix takes it.
5. tokens: n_tokens and digests of the BPE ids and of their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import op2_simhash, op6_language_id, op7_suffix_array, op8_mixing, op9_bpe
from scrivener.llm.common import drop, store, table

#: SQL cannot express the language, SimHash and BPE stages; the tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op6_language_id.train(docs.where(~op6_language_id.held_out(F.col("doc_id"))))
    return op6_language_id.predict(docs, model, _row(docs)).where("lang_pred <> 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_simhash.keep_one(docs, shingle=3, max_distance=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op7_suffix_array.remove_repeats(docs, window=50, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    rest = out.select("row.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Workers outlive the stage and the next one's need the memory.
    out = op9_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), memo_bytes=32 << 20)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return docs
