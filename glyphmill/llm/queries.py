"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import ann, chat, html_blocks, langid, minhash, packing, prefix_bpe, quality, token_file, toxicity
from glyphmill.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(vectors, F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return prefix_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_quality": op2_line_quality,
    "op3_packing": op3_packing,
    "op4_html_blocks": op4_html_blocks,
    "op5_chat_collapse": op5_chat_collapse,
    "op6_pruned_graph": op6_pruned_graph,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_token_file": op9_token_file,
    "op10_prefix_bpe": op10_prefix_bpe,
}

ORACLES: dict[str, str] = {"op3_packing": packing.oracle_sql(), "op5_chat_collapse": chat.ORACLE}
