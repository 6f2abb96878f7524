"""The queries of this subpackage, opN_<name>, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haplospark.llm import _common
from haplospark.llm.decontamination import contaminated
from haplospark.llm.jaccard_join import ORACLE as JACCARD_SQL
from haplospark.llm.jaccard_join import jaccard_components
from haplospark.llm.language_id import language_id
from haplospark.llm.personal_data import find
from haplospark.llm.piece_sampling import encode
from haplospark.llm.quality import quality
from haplospark.llm.secret_scan import scan
from haplospark.llm.token_counts import token_counts
from haplospark.llm.token_store import read_store, write_store
from haplospark.llm.topk_search import ORACLE as TOP_K_SQL
from haplospark.llm.topk_search import top_k


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; the only default of the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _common.scratch(spark, "token-store")
    write_store(_common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return read_store(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_common.table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_common.table(spark, sf_dir, "documents"), _common.table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_common.table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_common.table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_common.table(spark, sf_dir, "documents"), _common.table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(_common.table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_common.table(spark, sf_dir, "embeddings"))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_token_counts, op3_secret_scan, op4_quality, op5_language_id, op6_jaccard_join, op7_decontamination, op8_topk_search, op9_piece_sampling, op10_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": JACCARD_SQL, "op8_topk_search": TOP_K_SQL}
