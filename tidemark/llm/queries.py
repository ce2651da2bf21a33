"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, line_dedup, packing, pieces, simhash, substring_dedup, suffix_dedup, tokens, topk_search

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, the same on every machine that has the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), packing.word_count())


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    own = [op1_line_dedup, op2_substring_dedup, op3_language_id, op4_token_counts, op5_nearest_neighbours, op6_suffix_dedup, op7_simhash, op8_best_fit_packing, op9_exact_top_k, op10_pieces]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.LINE_SQL, "op2_substring_dedup": substring_dedup.SUBSTRING_SQL, "op9_exact_top_k": topk_search.TOPK_SQL}
