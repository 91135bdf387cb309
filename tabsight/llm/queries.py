"""Named queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tabsight.llm import ann, decontaminate, extraction, langid, merkle, mixing, neardup, passages, sharding, substrings, toxicity, wavelet, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours_of_sample(table(spark, sf_dir, "embeddings"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_report(table(spark, sf_dir, "documents"))


def op7_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_digest(table(spark, sf_dir, "documents"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_documents(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.label_documents(docs, langid.train(docs))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_nearest": op2_nearest,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_passages": op4_passages,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_wavelet_ids": op7_wavelet_ids,
    "op8_repeated_substrings": op8_repeated_substrings,
    "op9_main_text": op9_main_text,
    "op10_shards": op10_shards,
    "op11_whitened": op11_whitened,
    "op12_manifest": op12_manifest,
    "op13_language": op13_language,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op3_benchmark_leaks": decontaminate.LEAK_SQL,
    "op12_manifest": merkle.MANIFEST_SQL,
}
