"""The thin queries over the operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlake.llm import (
    balance,
    common,
    decontaminate,
    line_chunks,
    merkle,
    ngram_join,
    packing,
    quality_fm,
    rendezvous,
    robust_rules,
    seed_extend,
    spelling,
    toxicity_pu,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op8_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules.judge(_documents(spark, sf_dir))


@query
def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal shards; ``grown_shard`` is the place under nine."""
    return rendezvous.assign(_documents(spark, sf_dir), [1.0] * 8, [1.0] * 9).withColumn("law", F.lit("key"))


@query
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.round_trip(pages, common.shared_folder(spark))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.remove_repeated(_documents(spark, sf_dir), lines="n_lines", removed="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", "text")


@query
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op3_line_chunks"] = line_chunks.ORACLE
ORACLES["op5_benchmark_leaks"] = decontaminate.ORACLE


@query
def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.remove_repeats(_documents(spark, sf_dir)).drop("kept", "ranges")


@query
def op4_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), added=True)


@query
def op6_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir)).drop("key", "label")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


@query
def op12_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.mix(_documents(spark, sf_dir))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


ORACLES["op11_merkle_manifest"] = merkle.ORACLE
ORACLES["op13_spelling_variants"] = spelling.ORACLE
