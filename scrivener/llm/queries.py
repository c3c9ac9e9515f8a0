"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import op3_kd_search, op5_suffix_automata, op7_suffix_array, op8_mixing, op11_url_filter, op12_filter_audit, op13_lexical_search
from scrivener.llm.op4_embedding_dedup import ORACLE as EMBEDDING_DEDUP_SQL
from scrivener.llm.common import table
from scrivener.llm.op1_token_counts import count_tokens
from scrivener.llm.op2_simhash import simhash_components
from scrivener.llm.op3_kd_search import top_k
from scrivener.llm.op4_embedding_dedup import embedding_components
from scrivener.llm.op6_language_id import identify
from scrivener.llm.op8_mixing import mix
from scrivener.llm.op9_bpe import encode_decode
from scrivener.llm.op10_token_files import ids_crc32, read_tokens, write_tokens
from scrivener.session import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def op3_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op5_suffix_automata.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7_suffix_array.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return ids_crc32(read_tokens(spark, path))


def op11_url_filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_url_filter.judge(table(spark, sf_dir, "pages"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_kd_top_k": op3_kd_top_k,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_token_files": op10_token_files,
    "op11_url_filter": op11_url_filter_verdicts,
    "op12_filter_audit": op12_filter_interactions,
    "op13_lexical_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_kd_top_k": op3_kd_search.ORACLE,
    "op4_embedding_dedup": EMBEDDING_DEDUP_SQL,
    "op5_substring_dedup": op5_suffix_automata.ORACLE,
    "op7_suffix_array_dedup": op7_suffix_array.ORACLE,
    "op8_source_mix": op8_mixing.ORACLE,
    "op11_url_filter": op11_url_filter.ORACLE,
    "op12_filter_audit": op12_filter_audit.ORACLE,
    "op13_lexical_search": op13_lexical_search.ORACLE,
}
