"""Documents to packed training sequences in five stages.

Every stage reads what its predecessor kept (written as Parquet and read back), and all but the last return
the columns of documents. SQL cannot express the trained classifier, so the pipeline is tested against a
brute-force version in tests/llm.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from kgweave.llm import exact_dedup, minhash_dedup, mixing, packing, quality_rules
from kgweave.llm.common import save

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_rules.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*DOCUMENT)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest doc_id."""
    stays = exact_dedup.deduplicate(docs, exact_dedup.arrived_before()).where("kept").select("doc_id").distinct()
    return docs.join(stays, docs.doc_id.eqNullSafe(stays.doc_id), "left_semi").select(*DOCUMENT)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    stays = minhash_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(stays, docs.doc_id.eqNullSafe(stays.doc_id), "left_semi").select(*DOCUMENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of sources."""
    slots = mixing.mix(docs).groupBy("doc_id").agg(F.min("slot").alias("slot"))
    return docs.join(slots, docs.doc_id.eqNullSafe(slots.doc_id)).orderBy("slot", docs.doc_id).select(*[docs[c] for c in DOCUMENT])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every remaining document and its place in a sequence of 2048 tokens, filled in the mixture's order."""
    return packing.pack(in_stored_order(docs), place="place")


def in_stored_order(docs: DataFrame) -> DataFrame:
    """Documents with their ``place`` in the files they are read from, which a stage wrote in the order of its rows.

    A table that is not read from files has no such order.
    """
    try:
        part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
        return docs.select("doc_id", "text", (part * F.lit(1 << 40) + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(0).cast("long").alias("place"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
