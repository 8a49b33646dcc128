"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.chat_format import format_windows, read_back
from strandweave.llm.compression_quality import compression_quality
from strandweave.llm.embedding_dedup import embedding_components
from strandweave.llm.jaccard_join import jaccard_components
from strandweave.llm.language_id import identify_languages
from strandweave.llm.line_dedup import line_dedup
from strandweave.llm.mixing import mix_to_weights
from strandweave.llm.oracles import ORACLES as ORACLES
from strandweave.llm.packing import pack_powers_of_two
from strandweave.llm.separator_scan import count_document_tokens
from strandweave.llm.substring_dedup import repeated_passages


def tokenizer_path() -> str:
    """The public vocabulary: ``STRANDWEAVE_TOKENIZER`` if set, else where it is installed."""
    if path := os.environ.get("STRANDWEAVE_TOKENIZER"):
        return path
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(convs.unionByName(planted), tokenizer_path()))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_document_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("row")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")))
    return line_dedup(docs).select(
        "doc_id", F.col("n_lines").cast("long"), F.size("removed_lines").cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "part", "rate")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_separator_scan, op3_embedding_dedup, op4_substring_dedup, op5_language_id, op6_line_dedup, op7_mixing, op8_compression_quality, op9_jaccard_join, op10_packing)}
