"""Property graphs as a pair of tables: assembly, subgraphs, neighbours, degrees, export form."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.text import clean_text_graph, concept_id, md5_id, sha_id, short_key
from ..session import cut_lineage
from .extraction import ENTITY, EVENT, Flattened, first_edge_wins

# Names the graph tables use for passages, concepts and their edges.
PASSAGE, CONCEPT = "passage", "concept"
MENTION, HAS_CONCEPT = "mention in", "has_concept"
CONCEPT_FILE = "concept_file"


@dataclass(frozen=True)
class Graph:
    """vertices: id, name, type, file_id - edges: src, dst, relation, type, concepts."""
    vertices: DataFrame
    edges: DataFrame


def triple_graph(flat: Flattened) -> Graph:
    """Graph of the triples alone; the first row of a node or ordered pair wins."""
    v = flat.nodes.select(sha_id("name").alias("id"), "name", "type")
    e = first_edge_wins(
        flat.edges.select(sha_id("start_id").alias("src"), sha_id("end_id").alias("dst"), "relation", "type", "ord"),
        ["src", "dst"], "ord", ["relation", "type"]).drop("ord")
    return Graph(v, e)


def edge_concepts(edges: DataFrame, concepts: str = "concepts") -> DataFrame:
    """Concepts of all parallel edges of a pair, in first-seen order, comma-joined.

    Parallel edges with the same list, as those of one relation, are one row before anything is gathered;
    the distinct lists of a pair are then read in order. No list is taken apart into rows. Both steps use one
    exchange by pair.
    """
    rows = edges.where(F.size(concepts) > 0).select("src", "dst", F.col(concepts).alias("_l"), "ord").repartition("src", "dst")
    lists = rows.groupBy("src", "dst", "_l").agg(F.min("ord").alias("ord"))
    return lists.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("ord", "_l"))).alias("_c")).select(
        "src", "dst", F.array_join(F.array_distinct(F.flatten(F.col("_c._l"))), ",").alias("concepts"))


def full_graph(flat: Flattened, concept_nodes: DataFrame | None = None, concept_edges: DataFrame | None = None,
               edges_with_concepts: DataFrame | None = None) -> Graph:
    """Triples, passages and concepts in one simple directed graph.

    A triple node's ``file_id`` is the passage of its first mention; passages carry their own id
    and concepts a fixed marker. Only the first edge of an ordered pair is kept.
    """
    passage_of = flat.text_edges.select(F.col("start_id").alias("name"), F.col("end_id").alias("file_id"))
    v = flat.nodes.select("name", "type").join(passage_of, "name", "left").select(
        sha_id("name").alias("id"), "name", "type", "file_id")
    v = v.unionByName(flat.text_nodes.select(
        F.col("text_id").alias("id"), F.col("original_text").alias("name"), F.lit(PASSAGE).alias("type"),
        F.col("text_id").alias("file_id")))
    src = edges_with_concepts if edges_with_concepts is not None else flat.edges
    # ids are exchanged as bytes, half as long as their digits
    number, digits = lambda c: F.unhex(sha_id(c)), lambda c: F.lower(F.hex(c))
    e = src.select(number("start_id").alias("src"), number("end_id").alias("dst"), "relation", "type", "concepts", "ord")
    kept = first_edge_wins(e, ["src", "dst"], "ord", ["relation", "type"]).drop("ord").join(
        edge_concepts(e), ["src", "dst"], "left").withColumns({"src": digits("src"), "dst": digits("dst")})
    kept = kept.unionByName(flat.text_edges.select(
        sha_id("start_id").alias("src"), F.col("end_id").alias("dst"), F.lit(MENTION).alias("relation"), "type",
        F.lit(None).cast("string").alias("concepts")))
    if concept_nodes is not None:
        v = v.unionByName(concept_nodes.select(
            F.col("concept_id").alias("id"), "name", F.lit(CONCEPT).alias("type"), F.lit(CONCEPT_FILE).alias("file_id")))
        linked = concept_edges.select(number("start_id").alias("src"), F.col("end_id").alias("dst"), "relation", "type").distinct()
        kept = kept.unionByName(linked.withColumn("src", digits("src")).withColumn("concepts", F.lit(None).cast("string")))
    return Graph(v, kept)


def json_graph(triples: DataFrame, passages: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """Graph straight from records, where the *last* write of a node type or relation wins.

    ``triples``: head, relation, tail, kind, passage text, file_id and order columns. Entity and
    event triples link both ends to their passage; participation triples do not. Returns the graph
    plus the long tables (id, file_id) of nodes and (src, dst, file_id) of edges: a frequent
    node's files stay rows instead of one unbounded string.
    """
    t = triples.select(
        md5_id("head").alias("src"), md5_id("tail").alias("dst"), "head", "tail", "relation", "kind", "file_id",
        md5_id("passage").alias("pid"), F.struct("file_name", "line_no", "kind", "item", "member").alias("ord"))
    ends = t.select("kind", "file_id", "pid", F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("head").alias("name"),
                 F.when(F.col("kind") == ENTITY, "entity").otherwise("event").alias("type"), F.struct("ord", F.lit(0)).alias("ord")),
        F.struct(F.col("dst").alias("id"), F.col("tail").alias("name"),
                 F.when(F.col("kind") == EVENT, "event").otherwise("entity").alias("type"), F.struct("ord", F.lit(1)).alias("ord")),
    )).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.max_by(F.struct("e.name", "e.type"), "e.ord").alias("v")).select("id", "v.*")
    p = passages.filter("trim(text) <> ''").select(md5_id("text").alias("id"), F.col("text").alias("name")).distinct()
    v = nodes.unionByName(p.withColumn("type", F.lit(PASSAGE)))
    rel = t.groupBy("src", "dst").agg(F.max_by("relation", "ord").alias("relation"))
    mention = ends.filter(F.col("kind") != 2).select(
        F.col("e.id").alias("src"), F.col("pid").alias("dst"), F.lit(MENTION).alias("relation")).distinct()
    linked = ends.filter(F.col("kind") != 2).select("e.id", "file_id").distinct()
    late = ends.filter(F.col("kind") == 2).groupBy("e.id").agg(F.min_by("file_id", "e.ord").alias("file_id")).join(
        linked.select("id").distinct(), "id", "left_anti")
    return (Graph(v, rel.unionByName(mention)), linked.unionByName(late.select("id", "file_id")),
            t.select("src", "dst", "file_id").distinct())


def node_subset(g: Graph, events: bool, concepts: bool) -> DataFrame:
    """Searchable nodes by type; concepts without events is not a supported combination."""
    if concepts and not events:
        raise ValueError("concepts can only be included together with events")
    kinds = ["entity"] + (["event"] if events else []) + (["concept"] if concepts else [])
    cond = F.lit(False)
    for k in kinds:
        cond = cond | F.contains("type", F.lit(k))
    return g.vertices.filter(cond)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node table (also drops edges with missing ends on import)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def induced_subgraph(g: Graph, nodes: DataFrame) -> Graph:
    return Graph(g.vertices.join(nodes.select("id"), "id", "left_semi"), induced_edges(g.edges, nodes))


def named_edges(g: Graph) -> DataFrame:
    """Edges with the names of their ends."""
    n = g.vertices.select("id", "name")
    return (g.edges.join(n.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src")
            .join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Neighbour rows in both directions: (id, other, relation, forward)."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", F.lit(True).alias("forward")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", F.lit(False).alias("forward")))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In-, out- and total degree of every vertex, zeros included."""
    counts = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("d")).groupBy("d.id").agg(
        F.sum("d.o").alias("out_degree"), F.sum("d.i").alias("in_degree"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return vertices.select("id").join(counts, "id", "left").select(
        "id", z("out_degree"), z("in_degree"),
        (F.coalesce("out_degree", F.lit(0)) + F.coalesce("in_degree", F.lit(0))).alias("degree"))


def sampled_neighbours(nodes: DataFrame, edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Up to ``k`` predecessors and ``k`` successors per node in a seeded hash order.

    Texts travel as short keys until the neighbours are drawn; only what is drawn meets its texts again.
    """
    text = isinstance(edges.schema["src"].dataType, T.StringType)
    key = short_key if text else F.col
    h = F.xxhash64(F.lit(seed), "id", "side", "other").alias("_h")
    side = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("successor").alias("side")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("predecessor").alias("side"))).select(
        key("id").alias("id"), key("other").alias("other"), "side", h).distinct()
    pick = side.join(nodes.select(key("id").alias("id")), "id", "left_semi")
    w = W.partitionBy("id", "side").orderBy("_h", "other")
    drawn = pick.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k).drop("_h")
    if not text:
        return drawn
    names = cut_lineage(edges.select(F.explode(F.array("src", "dst")).alias("_t")).distinct().select("_t", short_key("_t").alias("_k")))
    of = lambda to: names.select(F.col("_k").alias(to), F.col("_t").alias(f"{to}_text"))
    return drawn.join(of("id"), "id").join(of("other"), "other").select(
        F.col("id_text").alias("id"), F.col("other_text").alias("other"), "side", "pick")


def file_frequency_weight(node_files: DataFrame) -> DataFrame:
    """Seed weight of a node: one over the number of distinct files it occurs in."""
    return node_files.groupBy("id").agg((F.lit(1.0) / F.countDistinct("file_id")).alias("weight"))


def split_files(vertices: DataFrame) -> DataFrame:
    """(id, file_id) rows from comma separated file lists, repeated ids collapsed."""
    return vertices.select("id", F.explode(F.array_distinct(F.split("file_id", ","))).alias("file_id"))


def concept_ids(names: DataFrame) -> DataFrame:
    return names.select(concept_id("name").alias("concept_id"), "name")


def graph_names(records: DataFrame, cols: list[str]) -> DataFrame:
    """Apply the graph-path cleaning (no squeeze) to the given columns."""
    for c in cols:
        records = records.withColumn(c, clean_text_graph(c))
    return records


def path_triples(path: str = "path"):
    """Triples along an alternating node/relation path."""
    p = F.col(path)
    return F.when(F.size(p) >= 3, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p) - 3) / 2).cast("int")),
        lambda i: F.struct(F.get(p, i * 2).alias("head"), F.get(p, i * 2 + 1).alias("relation"),
                           F.get(p, i * 2 + 2).alias("tail")))).otherwise(
        F.array().cast("array<struct<head:string,relation:string,tail:string>>"))
