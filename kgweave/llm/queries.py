"""Registered queries of the corpus operators: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, fill_in_middle, html_lstm, merkle, minhash_dedup, mixing, packing, pii_surrogates, quality_rules, substring_dedup, topk, url_filter
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii_surrogates.replace_entities(table(spark, folder, "documents"))


@query
def op4_html_lstm(spark: SparkSession, folder: str) -> DataFrame:
    return html_lstm.extract(table(spark, folder, "pages"))


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages"), rules)


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, folder, "documents"), exact_dedup.arrived_before())


@query
def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op11_bpe_rank_array(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encode(table(spark, folder, "documents"), packed=True)
    return bpe.decode(ids).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, folder, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle.manifest(table(spark, folder, "documents"), merkle.tampered)
    siblings = F.array_join(F.flatten(F.transform("proof", lambda level: level.siblings)), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


__all__ = ["QUERIES", "ORACLES"]
