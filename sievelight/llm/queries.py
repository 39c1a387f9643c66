"""The registered queries of the corpus operators, and SQL for those that SQL can express.

Each query applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chosen_path,
    chunk_recipes,
    disclosure,
    distribution_quality,
    host_suffixes,
    jump_sharding,
    online_packing,
    secret_forest,
    speculative_bpe,
    token_transducer,
)


def vocabulary_file(name: str) -> str:
    """A public tokenizer's file, as installed beside this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution_quality.judge(table(spark, sf_dir, "documents"))


def op2_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffixes.main_text(table(spark, sf_dir, "pages"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.exact_groups(table(spark, sf_dir, "documents"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_groups(table(spark, sf_dir, "documents"))


def op6_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), speculative_bpe.PATTERN)


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op9_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_distribution_quality, op2_host_suffixes, op3_jump_sharding, op4_chunk_recipes, op5_chosen_path, op6_online_packing, op7_speculative_bpe, op8_secret_forest, op9_token_transducer, op10_disclosure]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_distribution_quality": distribution_quality.oracle(), "op3_jump_sharding": jump_sharding.oracle(24), "op4_chunk_recipes": chunk_recipes.ORACLE, "op5_chosen_path": chosen_path.ORACLE}
