"""Documents to knowledge graph, end to end, with every intermediate table written to a folder."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import models, schema as SC
from ..operators import concept_graph as CG, concepts as C, extraction as X, graph as G, outputs as O, shaping as S
from ..session import cut_lineage, dense_index
from ..sources import readers, writers
from . import prompts


@dataclass(frozen=True)
class BuildConfig:
    """Batch sizes and switches of graph construction."""
    batch_triples: int = 16
    batch_concepts: int = 64
    remove_doc_spaces: bool = False
    shards: int = 1
    languages: tuple[str, ...] = S.LANGUAGES


def chunks(docs: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """Language filter and chunking of (id, text, metadata) documents."""
    d = docs.withColumn("lang", F.coalesce(F.try_element_at("metadata", F.lit("lang")), F.lit(S.DEFAULT_LANGUAGE)))
    return S.chunk_documents(S.filter_language(d, supported=config.languages), remove_spaces=config.remove_doc_spaces)


def extract(chunk_rows: DataFrame, make_generator) -> DataFrame:
    """Three-stage extraction with a model; each answer is repaired and validated."""
    p = prompts.extraction_prompts(chunk_rows)
    names = {"entity_relation": ("output_stage_one", "entity_relation_dict"), "event_entity": ("output_stage_two", "event_entity_relation_dict"),
             "event_relation": ("output_stage_three", "event_relation_dict")}
    for stage, (raw, fixed) in names.items():
        p = O.repaired(models.generate(p, f"prompt_{stage}", raw, make_generator), raw, fixed, stage).drop(f"prompt_{stage}")
    # stored: numbering and flattening read the records several times, the model answers once
    return cut_lineage(p.withColumnRenamed("text", "original_text").drop("system"))


def ordered_records(records: DataFrame) -> DataFrame:
    """Records in the order of document id and chunk, as flattening expects them."""
    return records.select(F.lit("records").alias("file_name"), "id", "chunk_id", "original_text", "entity_relation_dict",
                          "event_entity_relation_dict", "event_relation_dict").transform(
        lambda d: dense_index(d, ["id", "chunk_id"], "line_no"))


def build_graph(spark: SparkSession, records: DataFrame, folder: str,
                conceptualize: Callable[[DataFrame], DataFrame] = models.rule_concepts) -> G.Graph:
    """Records -> graph tables -> concepts -> full graph; tables are written once and read back.

    Reading the written tables back cuts the plan between the stages, so a lost executor repeats a
    stage and never the extraction.
    """
    started = datetime.now(timezone.utc)
    flat = X.flatten(records)
    steps = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        steps.append({"step": name, "at": datetime.now(timezone.utc).isoformat()})
        return spark.read.parquet(f"{folder}/{name}")

    triples = keep(flat.triples, "triples")
    seen = X.first_mentions(triples)
    r = X.with_text_ids(records)
    flat = X.Flattened(
        triples,
        keep(flat_nodes(seen), "triple_nodes"), keep(flat_edges(triples), "triple_edges"),
        keep(X.first_texts(r).select("text_id", "original_text", F.lit(X.TEXT_LABEL).alias("label"), "ord"), "text_nodes"),
        keep(seen.select(F.col("name").alias("start_id"), F.col("text_id").alias("end_id"), F.lit(X.SOURCE_TYPE).alias("type"), "ord"), "text_edges"),
        keep(X.missing_concepts(seen, triples), "missing_concepts"))
    answered = keep(conceptualize(flat.missing_concepts), "conceptualized")
    rows = C.concept_rows(answered)
    ce = keep(C.concept_edges(flat.nodes, rows), "concept_edges")
    cn = keep(C.concept_nodes(ce), "concept_nodes")
    with_c = keep(C.edges_with_concepts(flat.edges, rows), "triple_edges_with_concepts")
    g = G.full_graph(flat, cn, ce, with_c)
    g = G.Graph(keep(g.vertices, "vertices"), keep(g.edges, "edges"))
    writers.write_run_log(spark, f"{folder}/run_log", steps, started)
    return g


def flat_nodes(seen: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return seen.select("name", "type", empty.alias("concepts"), empty.alias("synsets"), F.lit(X.NODE_LABEL).alias("label"), "ord")


def flat_edges(triples: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return triples.select(F.col("head").alias("start_id"), F.col("tail").alias("end_id"), "relation", empty.alias("concepts"),
                          empty.alias("synsets"), F.lit(X.RELATION_TYPE).alias("type"), "text_id",
                          F.struct("file_name", "line_no", "kind", "item", "member").alias("ord"))


def numeric_tables(flat: X.Flattened) -> dict[str, DataFrame]:
    """Node, edge and passage tables with dense numeric ids in input order."""
    return {"nodes": dense_index(flat.nodes, ["ord"], "numeric_id"), "edges": dense_index(flat.edges, ["ord"], "numeric_id"),
            "text_nodes": dense_index(flat.text_nodes, ["ord"], "numeric_id")}


def embed_graph(g: G.Graph, make_encoder, events: bool = True, concepts: bool = True) -> dict[str, DataFrame]:
    """Vectors of searchable nodes, of the edges among them and of the passages; equal texts once."""
    nodes = G.node_subset(g, events, concepts).select("id", "name")
    edges = G.named_edges(G.Graph(g.vertices, G.induced_edges(g.edges, nodes))).select(
        "src", "dst", "relation", F.concat_ws(" ", "src_name", "relation", "dst_name").alias("text"))
    texts = g.vertices.filter(F.col("type") == G.PASSAGE).select("id", F.col("name").alias("text"))
    enc = lambda d, c: models.encode_distinct(d, c, "vec", make_encoder)
    return {"nodes": enc(nodes, "name"), "edges": enc(edges, "text"), "passages": enc(texts, "text")}


def build_concept_graph(spark: SparkSession, documents: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str,
                        minimum: int = 1) -> tuple[CG.ConceptGraph, DataFrame]:
    """Direct concept extraction: chunks -> concepts and relationships -> graph and statistics.

    ``answer`` maps (chunk_key, text) rows to (chunk_key, response).
    """
    started = datetime.now(timezone.utc)
    parts = S.sentence_chunks(documents).withColumn("chunk_key", S.chunk_key("id", "chunk_id"))
    c, r = O.concept_records(answer(parts.select("chunk_key", "text")), "response", "chunk_key")
    c = c.withColumn("source_chunk", F.col("chunk_key")).withColumn("ord", F.struct("chunk_key", "item"))
    r = CG.dedupe_undirected(CG.valid_relationships(r).withColumn("ord", F.struct("chunk_key", "item")), "ord")
    c.drop("ord").write.mode("overwrite").parquet(f"{folder}/concepts")
    r.drop("ord").write.mode("overwrite").parquet(f"{folder}/relationships")
    g = CG.build(c, r, minimum=minimum)
    stats = CG.graph_statistics(g)
    writers.write_results(stats, f"{folder}/statistics")
    writers.write_run_log(spark, f"{folder}/run_log", [{"step": s} for s in ("extract", "tables", "graph", "statistics")], started)
    return g, stats


def read_exchange(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Graph tables from the exchanged CSV form."""
    return readers.read_graph_tables(spark, folder)


__all__ = ["BuildConfig", "SC", "build_concept_graph", "build_graph", "chunks", "embed_graph", "extract", "flat_edges",
           "flat_nodes", "numeric_tables", "ordered_records", "read_exchange"]
