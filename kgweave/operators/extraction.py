"""Extraction records -> node, edge, passage and worklist tables.

Records hold three arrays of a model's output as JSON text. Values are read through VARIANT and
checked for their JSON type, because a plain schema cast would turn numbers into strings.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text, nothing_to_clean, sha_id, trim_passage

ENTITY, EVENT, PARTICIPATION = 0, 1, 2
# Labels and relation names of the graph tables.
NODE_LABEL, TEXT_LABEL = "Node", "Text"
RELATION_TYPE, SOURCE_TYPE = "Relation", "Source"
PARTICIPATES = "is participated by"


@dataclass(frozen=True)
class Flattened:
    triples: DataFrame
    nodes: DataFrame
    edges: DataFrame
    text_nodes: DataFrame
    text_edges: DataFrame
    missing_concepts: DataFrame


# Types of an array whose values are all JSON strings, by kind of triple.
_FACT, _EVENT = "ARRAY<OBJECT<Head: STRING, Relation: STRING, Tail: STRING>>", "ARRAY<OBJECT<Entity: ARRAY<STRING>, Event: STRING>>"
_ITEMS = "array<struct<head:string,relation:string,tails:array<string>>>"


def _string(v: str) -> str:
    """SQL: the variant as text when it is a JSON string, NULL for any other type."""
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN try_variant_get({v}, '$', 'string') END"


def _items(a: str, event: bool):
    """head, relation and tails of every element of the array ``a`` (a variant), NULL for what is no JSON string.

    One look at the type of the whole array tells whether all its values are strings, and it is read at once;
    only where some are not, each value is looked at.
    """
    at = lambda x, k: f"variant_get({x}, '$.{k}', 'variant')"
    if event:
        row, whole, given = "Event:string,Entity:array<string>", _EVENT, ("x.Event", f"'{PARTICIPATES}'", "x.Entity")
        odd = (_string(at("x", "Event")), f"'{PARTICIPATES}'", f"transform(try_variant_get(x, '$.Entity', 'array<variant>'), t -> {_string('t')})")
    else:
        row, whole, given = "Head:string,Relation:string,Tail:string", _FACT, ("x.Head", "x.Relation", "array(x.Tail)")
        odd = (_string(at("x", "Head")), _string(at("x", "Relation")), f"array({_string(at('x', 'Tail'))})")
    each = lambda array, cols: f"transform({array}, x -> named_struct('head', {cols[0]}, 'relation', {cols[1]}, 'tails', {cols[2]}))"
    plain = each(f"try_variant_get({a}, '$', 'array<struct<{row}>>')", given)
    return F.expr(f"CASE WHEN schema_of_variant({a}) = '{whole}' THEN {plain} ELSE {each(f"""try_variant_get({a}, '$', 'array<variant>')""", odd)} END").cast(_ITEMS)


def with_text_ids(records: DataFrame) -> DataFrame:
    """Trim the recorded prompt to its passage and add the passage hash."""
    return records.withColumn("passage", trim_passage("original_text")).withColumn("text_id", sha_id("passage"))


def all_triples(records: DataFrame) -> DataFrame:
    """Type-checked, cleaned, non-blank triples of all three kinds in one pass over the records.

    A triple counts only when all its values are JSON strings; participation needs a string event
    and a list, whose non-string members are skipped. Each row carries its place in the input:
    (file_name, line_no, kind, item, member) is the order every first-wins rule refers to.
    """
    r = records if "text_id" in records.columns else with_text_ids(records)
    keep = ["file_name", "line_no", "text_id"]
    arrays = r.select(*keep, F.explode(F.array(
        F.struct(F.lit(ENTITY).alias("kind"), F.col("entity_relation_dict").alias("j")),
        F.struct(F.lit(EVENT).alias("kind"), F.col("event_relation_dict").alias("j")),
        F.struct(F.lit(PARTICIPATION).alias("kind"), F.col("event_entity_relation_dict").alias("j")),
    )).alias("p")).select(*keep, "p.kind", nothing_to_clean("p.j").alias("_tidy"), F.try_parse_json("p.j").alias("_a"))
    items = arrays.select(*keep, "kind", "_tidy", F.posexplode(
        F.when(F.col("kind") == PARTICIPATION, _items("_a", True)).otherwise(_items("_a", False))).alias("item", "v"))
    tidy = lambda c: F.when(F.col("_tidy"), F.trim(c)).otherwise(clean_text(c))
    named = items.select(
        *keep, "kind", "item", "_tidy", tidy(F.col("v.head")).alias("head"),
        F.when(F.col("kind") == PARTICIPATION, F.lit(PARTICIPATES)).otherwise(tidy(F.col("v.relation"))).alias("relation"),
        F.col("v.tails").alias("_t"))
    # blank heads and relations drop out inside the generator: a filter would be pushed below and
    # clean every name a second time
    members = F.when((F.col("head") != "") & (F.col("relation") != ""), F.transform("_t", tidy))
    return named.select(*keep, "kind", "item", "head", "relation", F.posexplode(members).alias("member", "tail")).filter("tail <> ''")


def mentions(triples: DataFrame) -> DataFrame:
    """Both ends of every triple with their kind and order: the candidates for node rows."""
    ends = F.array(
        F.struct(F.col("head").alias("name"),
                 F.when(F.col("kind") == ENTITY, "entity").otherwise("event").alias("type"),
                 F.lit(0).alias("end")),
        F.struct(F.col("tail").alias("name"),
                 F.when(F.col("kind") == EVENT, "event").otherwise("entity").alias("type"),
                 F.lit(1).alias("end")))
    return triples.select(
        "file_name", "line_no", "kind", "item", "member", "text_id", F.explode(ends).alias("e"),
    ).select("e.name", "e.type", "text_id",
             F.struct("file_name", "line_no", "kind", "item", "member", "e.end").alias("ord"))


def first_mentions(triples: DataFrame) -> DataFrame:
    """Name, type and passage of each node's first mention.

    The least of a struct that begins with the order is combined on the map side: a name that occurs in a third of
    all rows costs one partial row per task, never one task with all of them, and its order is sent once.
    """
    return mentions(triples).groupBy("name").agg(F.min(F.struct("ord", "type", "text_id")).alias("f")).select(
        "name", "f.type", "f.text_id", "f.ord")


def first_texts(records: DataFrame) -> DataFrame:
    """Distinct passages; the hash decides identity."""
    return records.groupBy("text_id").agg(
        F.min_by("passage", F.struct("file_name", "line_no")).alias("original_text"),
        F.min(F.struct("file_name", "line_no")).alias("ord"))


def missing_concepts(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Worklist of distinct entities, events and relations."""
    return nodes.select(F.col("name").alias("Name"), F.initcap("type").alias("Type")).unionByName(
        triples.select(F.col("relation").alias("Name")).distinct().withColumn("Type", F.lit("Relation")))


def flatten(records: DataFrame, keep=None, keep_nodes=None) -> Flattened:
    """All graph tables of a set of extraction records.

    ``records``: file_name, line_no, id, original_text and the three JSON array columns. Callers
    that use several tables pass ``keep`` (such as ``cut_lineage``) so that the triples are parsed
    once instead of once per table; ``keep_nodes`` does the same for the first mentions.
    """
    r = with_text_ids(records)
    t = all_triples(r)
    t = keep(t) if keep else t
    seen = first_mentions(t)
    seen = keep_nodes(seen) if keep_nodes else seen
    nodes = seen.select("name", "type", F.array().cast("array<string>").alias("concepts"),
                        F.array().cast("array<string>").alias("synsets"), F.lit(NODE_LABEL).alias("label"), "ord")
    edges = t.select(
        F.col("head").alias("start_id"), F.col("tail").alias("end_id"), "relation",
        F.array().cast("array<string>").alias("concepts"), F.array().cast("array<string>").alias("synsets"),
        F.lit(RELATION_TYPE).alias("type"), "text_id",
        F.struct("file_name", "line_no", "kind", "item", "member").alias("ord"))
    text_nodes = first_texts(r).select("text_id", "original_text", F.lit(TEXT_LABEL).alias("label"), "ord")
    text_edges = seen.select(F.col("name").alias("start_id"), F.col("text_id").alias("end_id"),
                             F.lit(SOURCE_TYPE).alias("type"), "ord")
    return Flattened(t, nodes, edges, text_nodes, text_edges, missing_concepts(seen, t))


def first_edge_wins(edges: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the values of its earliest row."""
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v"), F.min(order).alias(order)).select(
        *keys, "_v.*", order)


def last_edge_wins(edges: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the values of its latest row (the direct graph path overwrites)."""
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"), F.max(order).alias(order)).select(
        *keys, "_v.*", order)


def type_gate(df: DataFrame, json_col: str, path: str, wanted: str) -> DataFrame:
    """Rows whose JSON value at ``path`` has the wanted SQL type name (for example STRING, BIGINT)."""
    parsed = df.withColumn("_j", F.try_parse_json(json_col))
    return parsed.filter(F.expr(f"schema_of_variant(variant_get(_j, '{path}', 'variant'))") == wanted).drop("_j")
