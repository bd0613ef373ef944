"""Knowledge graph built from the documents, concept graph built from the parts, graph operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..functions.text import concept_id, sha_id, short_key
from ..operators import concept_graph as CG, concepts as C, extraction as X, graph as G, paths as P, ranking as R
from ..session import cut_lineage, dense_index
from .base import TRIPLES, WITH_KG, documents, query, table


def kg(spark, d, shared: bool = False, nodes: bool = False) -> X.Flattened:
    """Graph tables of the whole document collection under the stand-in extractor.

    ``shared`` stores the triples once for queries that read several tables, ``nodes`` also the first mentions.
    """
    return X.flatten(models.rule_extraction(documents(spark, d)), cut_lineage if shared else None, cut_lineage if nodes else None)


def plain_edges(spark, d):
    """Directed edges between node names, one per triple, stored."""
    return cut_lineage(kg(spark, d).triples.select(F.col("head").alias("src"), F.col("tail").alias("dst")))


def keyed_edges(t):
    """Simple directed edges between the short keys of node names."""
    return t.select(short_key("head").alias("src"), short_key("tail").alias("dst")).distinct()


# ---- graph tables ------------------------------------------------------------------------------

@query("q_triples_from_json", WITH_KG + """
SELECT kind, count(*) AS n_triples, count(DISTINCT head) AS n_heads, count(DISTINCT tail) AS n_tails, sum(length(relation)) AS relation_chars
FROM triples GROUP BY kind""")
def triples_from_json(spark, d):
    return kg(spark, d).triples.groupBy("kind").agg(
        F.count("*").alias("n_triples"), F.countDistinct("head").alias("n_heads"), F.countDistinct("tail").alias("n_tails"),
        F.sum(F.length("relation")).alias("relation_chars"))


@query("q_kg_nodes", WITH_KG + "SELECT name, type, text_id FROM nodes")
def kg_nodes(spark, d):
    f = kg(spark, d)
    return X.first_mentions(f.triples).select("name", "type", "text_id")


@query("q_kg_node_types", WITH_KG + "SELECT type, count(*) AS n_nodes, count(DISTINCT text_id) AS n_texts FROM nodes GROUP BY type")
def kg_node_types(spark, d):
    return X.first_mentions(kg(spark, d).triples).groupBy("type").agg(
        F.count("*").alias("n_nodes"), F.countDistinct("text_id").alias("n_texts"))


@query("q_kg_edges", WITH_KG + """
SELECT head AS start_id, relation, tail AS end_id, count(*) AS n FROM triples GROUP BY head, relation, tail""")
def kg_edges(spark, d):
    return kg(spark, d).edges.groupBy("start_id", "relation", "end_id").agg(F.count("*").alias("n"))


@query("q_text_nodes", WITH_KG + "SELECT text_id, min(doc_id) AS first_doc, count(*) AS copies FROM texts GROUP BY text_id")
def text_nodes(spark, d):
    r = X.with_text_ids(models.rule_extraction(documents(spark, d)))
    return r.groupBy("text_id").agg(F.min("line_no").alias("first_doc"), F.count("*").alias("copies"))


@query("q_text_edges", WITH_KG + "SELECT text_id AS end_id, count(*) AS n_first_mentions FROM nodes GROUP BY text_id")
def text_edges(spark, d):
    return kg(spark, d).text_edges.groupBy("end_id").agg(F.count("*").alias("n_first_mentions"))


@query("q_first_edge_wins", WITH_KG + """
SELECT head AS start_id, tail AS end_id, relation FROM triples
QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY doc_id, kind, item, member) = 1""")
def first_edge_wins(spark, d):
    return X.first_edge_wins(kg(spark, d).edges, ["start_id", "end_id"], "ord", ["relation"]).drop("ord")


@query("q_last_edge_wins", WITH_KG + """
SELECT head AS start_id, tail AS end_id, relation FROM triples
QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY doc_id DESC, kind DESC, item DESC, member DESC) = 1""")
def last_edge_wins(spark, d):
    return X.last_edge_wins(kg(spark, d).edges, ["start_id", "end_id"], "ord", ["relation"]).drop("ord")


@query("q_numeric_ids", WITH_KG + """
SELECT name, row_number() OVER (ORDER BY doc_id, kind, item, member, e) - 1 AS numeric_id FROM (
  SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, kind, item, member, e) = 1)""")
def numeric_ids(spark, d):
    return dense_index(X.first_mentions(kg(spark, d).triples).select("name", "ord"), ["ord"], "numeric_id").select("name", "numeric_id")


@query("q_missing_concepts", WITH_KG + """
SELECT name AS "Name", CASE type WHEN 'entity' THEN 'Entity' ELSE 'Event' END AS "Type" FROM nodes
UNION ALL SELECT DISTINCT relation, 'Relation' FROM triples""")
def missing_concepts(spark, d):
    return kg(spark, d, shared=True).missing_concepts


@query("q_worklist_batches", WITH_KG + """
SELECT kind, (rn - 1) // 64 AS batch, count(*) AS n FROM (
  SELECT CASE type WHEN 'entity' THEN 'entity' ELSE 'event' END AS kind, row_number() OVER (PARTITION BY type ORDER BY name) AS rn FROM nodes
  UNION ALL SELECT 'relation', row_number() OVER (ORDER BY relation) FROM (SELECT DISTINCT relation FROM triples)) GROUP BY ALL""")
def worklist_batches(spark, d):
    from ..operators.shaping import worklist_batches as split
    return split(kg(spark, d, shared=True).missing_concepts, 64).groupBy("kind", "batch").agg(F.count("*").alias("n"))


# ---- concepts ----------------------------------------------------------------------------------

CONCEPTS = WITH_KG + """,
work AS (SELECT name, type FROM nodes UNION ALL SELECT DISTINCT relation, 'relation' FROM triples),
conc AS (SELECT name AS node, type AS node_type, unnest([
    'initial ' || lower(substring(name, 1, 1)),
    CASE WHEN type = 'event' THEN 'event of ' || (len(string_split(name, ' ')) - len(string_split(name, ' ')) % 5) || ' words'
         ELSE 'length ' || length(name) END]) AS raw FROM work),
crow AS (SELECT DISTINCT node, node_type, trim(unnest(string_split(raw, ','))) AS concept FROM conc),
crows AS (SELECT DISTINCT node, node_type, concept FROM crow WHERE concept <> '')
"""


def conceptualized(f: X.Flattened):
    return models.rule_concepts(f.missing_concepts)


@query("q_concept_nodes", CONCEPTS + """
SELECT sha256(concept || '_concept') AS concept_id, concept AS name, count(DISTINCT node) FILTER (node_type <> 'relation') AS n_names
FROM crows WHERE node_type <> 'relation' GROUP BY concept""")
def concept_nodes(spark, d):
    f = kg(spark, d, shared=True)
    rows = C.concept_rows(conceptualized(f)).filter("kind = 'node'")
    return rows.groupBy("concept").agg(F.count("*").alias("n_names")).select(
        concept_id("concept").alias("concept_id"), F.col("concept").alias("name"), "n_names")


@query("q_concept_edges", CONCEPTS + """
SELECT node AS start_id, sha256(concept || '_concept') AS end_id, 'has_concept' AS relation FROM crows
WHERE node_type <> 'relation' GROUP BY node, concept""")
def concept_edges(spark, d):
    f = kg(spark, d, shared=True)
    return C.concept_edges(f.nodes, C.concept_rows(conceptualized(f))).select("start_id", "end_id", "relation")


@query("q_edge_concepts", CONCEPTS + """
SELECT head AS start_id, tail AS end_id, string_agg(concept, ',' ORDER BY rnk, concept) AS concepts FROM (
  SELECT t.head, t.tail, c.concept, min(t.rk) AS rnk FROM (
    SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY doc_id, kind, item, member) AS rk FROM triples) t
  JOIN crows c ON c.node = t.relation AND c.node_type = 'relation' GROUP BY ALL) GROUP BY head, tail""")
def edge_concepts(spark, d):
    f = kg(spark, d, shared=True)
    e = C.edges_with_concepts(f.edges, C.concept_rows(conceptualized(f)))
    return G.edge_concepts(e.withColumnsRenamed({"start_id": "src", "end_id": "dst"})).withColumnsRenamed({"src": "start_id", "dst": "end_id"})


@query("q_concept_counts", CONCEPTS + """
SELECT node_type, count(DISTINCT concept) AS n_concepts FROM crows GROUP BY node_type
UNION ALL SELECT 'all', count(DISTINCT concept) FROM crows""")
def concept_counts(spark, d):
    return C.concept_counts(conceptualized(kg(spark, d, shared=True)))


@query("q_name_context")
def name_context(spark, d):
    f = kg(spark, d, shared=True)
    return C.name_context(f.nodes, f.edges)


@query("q_full_graph", CONCEPTS + """
, ce AS (SELECT DISTINCT node, concept FROM crows WHERE node_type <> 'relation')
SELECT 'triple' AS part, count(*) AS n FROM (SELECT DISTINCT head, tail FROM triples)
UNION ALL SELECT 'mention in', count(*) FROM nodes
UNION ALL SELECT 'has_concept', count(*) FROM ce
UNION ALL SELECT 'vertices', (SELECT count(*) FROM nodes) + (SELECT count(DISTINCT text_id) FROM texts) + (SELECT count(DISTINCT concept) FROM ce)""")
def full_graph(spark, d):
    f = kg(spark, d, shared=True, nodes=True)
    rows = C.concept_rows(conceptualized(f))
    ce = cut_lineage(C.concept_edges(f.nodes, rows))
    g = G.full_graph(f, C.concept_nodes(ce), ce, C.edges_with_concepts(f.edges, rows))
    part = F.when(F.col("relation").isin(G.MENTION, G.HAS_CONCEPT) & (F.col("type") != X.RELATION_TYPE), F.col("relation")).otherwise("triple")
    return g.edges.groupBy(part.alias("part")).agg(F.count("*").alias("n")).unionByName(
        g.vertices.agg(F.count("*").alias("n")).select(F.lit("vertices").alias("part"), "n"))


@query("q_json_graph", WITH_KG + """,
men AS (SELECT DISTINCT m.name, m.text_id FROM mentions m WHERE kind <> 2),
lastrel AS (SELECT head, tail, relation FROM triples
            QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY doc_id DESC, kind DESC, item DESC, member DESC) = 1),
lasttype AS (SELECT name, type FROM mentions QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id DESC, kind DESC, item DESC, member DESC, e DESC) = 1)
SELECT 'mention in' AS part, count(*) AS n FROM men
UNION ALL SELECT 'relations', count(*) FROM lastrel
UNION ALL SELECT 'relation chars', sum(length(relation)) FROM lastrel
UNION ALL SELECT 'entities', count(*) FROM lasttype WHERE type = 'entity'
UNION ALL SELECT 'events', count(*) FROM lasttype WHERE type = 'event'""")
def json_graph(spark, d):
    docs = documents(spark, d)
    r = X.with_text_ids(models.rule_extraction(docs))
    # stored: the graph reads the triples once for nodes, once for relations and once for mentions
    t = cut_lineage(X.all_triples(r)).withColumn("passage", F.col("text_id")).withColumn("file_id", F.col("line_no").cast("string"))
    g, _, _ = G.json_graph(t, docs.select("text"))
    e = g.edges.groupBy((F.col("relation") == G.MENTION).alias("m")).agg(
        F.count("*").alias("n"), F.sum(F.length("relation")).cast("bigint").alias("c"))
    parts = e.select(F.explode(F.when(F.col("m"), F.array(F.struct(F.lit("mention in").alias("part"), F.col("n").alias("n")))).otherwise(
        F.array(F.struct(F.lit("relations").alias("part"), F.col("n").alias("n")),
                F.struct(F.lit("relation chars").alias("part"), F.col("c").alias("n"))))).alias("x")).select("x.*")
    kinds = g.vertices.filter("type <> 'passage'").groupBy("type").agg(F.count("*").alias("n")).select(
        F.when(F.col("type") == "entity", "entities").otherwise("events").alias("part"), "n")
    return parts.unionByName(kinds)


# ---- graph operators ------------------------------------------------------------------------------

@query("q_node_subset_edges", WITH_KG + """
SELECT count(*) AS n_edges, count(DISTINCT head) AS n_sources FROM (
  SELECT DISTINCT t.head, t.tail FROM triples t
  JOIN nodes a ON a.name = t.head AND a.type = 'entity' JOIN nodes b ON b.name = t.tail AND b.type = 'entity')""")
def node_subset_edges(spark, d):
    f = kg(spark, d, shared=True)
    g = G.Graph(f.nodes.select(short_key("name").alias("id"), "name", "type"), keyed_edges(f.triples))
    e = G.induced_edges(g.edges, G.node_subset(g, events=False, concepts=False))
    return e.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))


@query("q_degree_stats", WITH_KG + """,
e AS (SELECT DISTINCT head, tail FROM triples),
o AS (SELECT head AS name, count(*) AS c FROM e GROUP BY head), i AS (SELECT tail AS name, count(*) AS c FROM e GROUP BY tail)
SELECT type, avg(coalesce(o.c, 0)) AS avg_out, avg(coalesce(i.c, 0)) AS avg_in, max(coalesce(o.c, 0)) AS max_out, max(coalesce(i.c, 0)) AS max_in,
       count(*) AS n_nodes FROM nodes LEFT JOIN o USING (name) LEFT JOIN i USING (name) GROUP BY type""")
def degree_stats(spark, d):
    f = kg(spark, d, shared=True)
    v = cut_lineage(X.first_mentions(f.triples).select(short_key("name").alias("id"), "type"))
    e = keyed_edges(f.triples)
    return v.join(G.degrees(v, e), "id").groupBy("type").agg(
        F.avg("out_degree").alias("avg_out"), F.avg("in_degree").alias("avg_in"), F.max("out_degree").alias("max_out"),
        F.max("in_degree").alias("max_in"), F.count("*").alias("n_nodes"))


@query("q_density", WITH_KG + """
SELECT n, m, m / (CAST(n AS DOUBLE) * (n - 1)) AS density FROM (
  SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM (SELECT DISTINCT head, tail FROM triples)) AS m)""")
def density(spark, d):
    f = kg(spark, d, shared=True)
    # one pass: nodes and pairs are counted side by side
    both = X.first_mentions(f.triples).select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(
        keyed_edges(f.triples).select(F.lit(0).alias("v"), F.lit(1).alias("e")))
    return both.agg(F.sum("v").alias("n"), F.sum("e").alias("m")).withColumn(
        "density", F.col("m") / (F.col("n").cast("double") * (F.col("n") - 1)))


@query("q_components", """
WITH RECURSIVE e AS (
  SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
start AS (SELECT DISTINCT a AS id, a AS label FROM both_ways),
reach(id, label) AS (SELECT id, label FROM start UNION SELECT t.b, r.label FROM reach r JOIN both_ways t ON t.a = r.id),
comp AS (SELECT id, min(label) AS component FROM reach GROUP BY id)
SELECT component, count(*) AS n_nodes FROM comp GROUP BY component""")
def components(spark, d):
    o = table(spark, d, "orders")
    e = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    v = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return R.connected_components(e, v).groupBy("component").agg(F.count("*").alias("n_nodes"))


@query("q_kg_components")
def kg_components(spark, d):
    e = plain_edges(spark, d)
    # short keys stand for the names until every component takes the least of its own
    k = e.select(short_key("src").alias("src"), short_key("dst").alias("dst"))
    named = ends(e).select(short_key("id").alias("id"), F.col("id").alias("name")).join(R.connected_components(k, ends(k)), "id")
    return named.groupBy(F.col("component").alias("_c")).agg(F.min("name").alias("component"), F.count("*").alias("n_nodes")).drop("_c")


# customer -> order -> part -> supplier -> nation -> region
TRADE = """
WITH e AS (
  SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
  UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
deg AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src),
"""


def trade_edges(spark, d):
    """The relational tables read as a graph."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    li = table(spark, d, "lineitem")
    parts = [table(spark, d, "orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("placed").alias("relation")),
             li.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("contains").alias("relation")),
             li.select(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst"), F.lit("supplied by").alias("relation")),
             table(spark, d, "supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("located in").alias("relation")),
             table(spark, d, "nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("part of").alias("relation"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def ends(e):
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


# seeds: every market segment is a query whose seeds are its customers
_SEEDS = """
seeds AS (SELECT c_mktsegment AS query_id, 'c' || c_custkey AS id FROM customer WHERE 'c' || c_custkey IN (SELECT id FROM v)),
p AS (SELECT query_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS p FROM seeds),
q AS (SELECT DISTINCT query_id FROM seeds),
r0 AS (SELECT query_id, id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM q, v),
"""
_ROUND = """
d{k} AS (SELECT query_id, sum(x) AS d FROM r{j} WHERE id NOT IN (SELECT src FROM deg) GROUP BY query_id),
m{k} AS (SELECT r.query_id, e.dst AS id, sum(r.x / g.outdeg) AS s FROM r{j} r JOIN deg g ON g.src = r.id JOIN e ON e.src = r.id GROUP BY r.query_id, e.dst),
r{k} AS (SELECT q.query_id, v.id, 0.85 * coalesce(m.s, 0) + (0.85 * coalesce(d.d, 0) + 0.15) * coalesce(p.p, 0) AS x
         FROM q CROSS JOIN v LEFT JOIN m{k} m ON m.query_id = q.query_id AND m.id = v.id
         LEFT JOIN d{k} d ON d.query_id = q.query_id LEFT JOIN p ON p.query_id = q.query_id AND p.id = v.id),
"""
ROUNDS = 5
PAGERANK_SQL = TRADE + _SEEDS + "".join(_ROUND.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1)) + f"""
kinds AS (SELECT query_id, substring(id, 1, 1) AS kind, sum(x) AS mass, max(x) AS top FROM r{ROUNDS} GROUP BY ALL)
SELECT query_id, kind, round(mass, 9) AS mass, round(top, 9) AS top FROM kinds"""


@query("q_pagerank_k", PAGERANK_SQL)
def pagerank_k(spark, d):
    e = trade_edges(spark, d).select("src", "dst")
    seeds = table(spark, d, "customer").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit(1.0).alias("weight"))
    v = cut_lineage(ends(e))
    seeds = seeds.join(v, "id", "left_semi")
    r = R.personalized_pagerank(e, v, seeds, rounds=ROUNDS).dense()
    return r.groupBy("query_id", F.substring("id", 1, 1).alias("kind")).agg(
        F.round(F.sum("rank"), 9).alias("mass"), F.round(F.max("rank"), 9).alias("top"))


@query("q_two_hop_counts", TRADE + """
u AS (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
h1 AS (SELECT n.n_name AS query_id, 'n' || n_nationkey AS a, u.other AS b FROM nation n JOIN u ON u.id = 'n' || n_nationkey),
h2 AS (SELECT query_id, a, b, u.other AS c FROM h1 JOIN u ON u.id = b WHERE u.other <> a)
SELECT query_id, count(*) AS n_paths, count(DISTINCT c) AS n_tails FROM h2 GROUP BY query_id""")
def two_hop_counts(spark, d):
    e = trade_edges(spark, d)
    seeds = table(spark, d, "nation").select(F.col("n_name").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    p = P.expand(P.expand(P.start_paths(seeds), e), e)
    return p.filter(F.size("nodes") == 3).groupBy("query_id").agg(F.count("*").alias("n_paths"), F.countDistinct("tail").alias("n_tails"))


@query("q_beam_paths", TRADE + """
lab AS (SELECT src, dst, CASE substring(src, 1, 1) WHEN 'c' THEN 'placed' WHEN 'o' THEN 'contains' WHEN 'p' THEN 'supplied by' WHEN 's' THEN 'located in' ELSE 'part of' END AS relation FROM e),
u AS (SELECT src AS id, dst AS other, relation FROM lab UNION ALL SELECT dst, src, relation FROM lab),
p0 AS (SELECT r_name AS query_id, ['r' || r_regionkey] AS path, ['r' || r_regionkey] AS nodes, 'r' || r_regionkey AS tail FROM region),
""" + ",".join(f"""
x{k} AS (SELECT query_id, list_concat(path, [relation, other]) AS path, list_concat(nodes, [other]) AS nodes, other AS tail FROM p{k - 1} JOIN u ON u.id = tail WHERE NOT list_contains(nodes, other)),
p{k} AS (SELECT * FROM (SELECT * FROM x{k} UNION ALL SELECT * FROM p{k - 1} p WHERE NOT EXISTS (SELECT 1 FROM x{k} x WHERE x.query_id = p.query_id AND x.nodes[1:len(p.nodes)] = p.nodes AND x.path[1:len(p.path)] = p.path))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(tail) DESC, path DESC) <= 5)""" for k in range(1, 6)) + """
SELECT query_id, array_to_string(path, ' --->') AS path FROM p5""")
def beam_paths(spark, d):
    from ..functions.text import path_text
    e = cut_lineage(trade_edges(spark, d))  # five tables joined once, not once per round
    seeds = table(spark, d, "region").select(F.col("r_name").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    p = P.search(seeds, e, lambda: F.length("tail"))
    return p.select("query_id", path_text("path").alias("path"))


@query("q_neighbors_sample")
def neighbors_sample(spark, d):
    e = plain_edges(spark, d)
    return G.sampled_neighbours(ends(e), e, 3)


@query("q_walk_rank")
def walk_rank(spark, d):
    """Seeded walk samples of all regions and nations and the source-restart rank on them."""
    e = trade_edges(spark, d).select("src", "dst")
    both = cut_lineage(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    sources = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).unionByName(
        table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))
    s = R.walk_sample(both, sources)
    return R.source_rank(both, s)


# ---- concept graph from the parts --------------------------------------------------------------------

PART_CONCEPTS = """
WITH c AS (SELECT p_partkey AS ord, lower(p_name) AS name, p_type AS type,
  CASE p_size % 3 WHEN 0 THEN 'specific' WHEN 1 THEN 'general' ELSE 'abstract' END AS level FROM part
  UNION ALL SELECT DISTINCT 1000000000 + length(p_type), lower(p_type), 'KIND', 'general' FROM part
  UNION ALL SELECT 2000000000 + p_partkey, lower(string_split(p_name, ' ')[-1]), 'THING', 'abstract' FROM part),
nodes AS (SELECT name, type, level FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC, type DESC) = 1),
pairs AS (SELECT a.name AS s, b.name AS t, a.type = b.type AS same FROM nodes a, nodes b
  WHERE ((a.level = 'specific' AND b.level = 'general') OR (a.level = 'general' AND b.level = 'abstract'))
    AND (a.type = b.type OR contains(a.name, b.name) OR contains(b.name, a.name))),
rel AS (SELECT DISTINCT lower(p_name) AS s, lower(string_split(p_name, ' ')[-1]) AS t FROM part),
kept AS (SELECT s, t FROM rel WHERE s <> t AND (s, t) NOT IN (SELECT s, t FROM pairs)),
alle AS (SELECT s, t FROM pairs UNION SELECT s, t FROM kept)
"""


def part_concepts(spark, d):
    """Part names, part types and head nouns as concepts with levels; every part is one record."""
    p = table(spark, d, "part")
    level = F.when(F.col("p_size") % 3 == 0, "specific").when(F.col("p_size") % 3 == 1, "general").otherwise("abstract")
    noun = F.element_at(F.split(F.lower("p_name"), " "), -1)
    row = lambda ord_, n, t, l: F.struct(ord_.cast("bigint").alias("o"), n.alias("name"), t.alias("type"), l.alias("abstraction_level"))
    c = p.select(F.explode(F.array(
        row(F.col("p_partkey"), F.lower("p_name"), F.col("p_type"), level),
        row(F.lit(1000000000) + F.length("p_type"), F.lower("p_type"), F.lit("KIND"), F.lit("general")),
        row(F.lit(2000000000) + F.col("p_partkey"), noun, F.lit("THING"), F.lit("abstract")))).alias("c")).select("c.*")
    concepts = c.withColumn("ord", F.struct("o", "type")).drop("o")
    rels = p.select(F.lower("p_name").alias("source"), noun.alias("target"), F.lit("is a").alias("relation"), F.col("p_partkey").alias("ord"))
    return concepts, rels


def part_graph(spark, d):
    concepts, rels = part_concepts(spark, d)
    return CG.build(concepts, rels)


@query("q_concept_graph_edges", PART_CONCEPTS + """
SELECT 'abstraction_relation' AS edge_type, count(*) AS n_edges FROM pairs HAVING count(*) > 0
UNION ALL SELECT 'concept_relation', count(*) FROM kept HAVING count(*) > 0""")
def concept_graph_edges(spark, d):
    g = part_graph(spark, d)
    return CG.edge_type_counts(g, CG.containment_edges(g.nodes))


@query("q_abstraction_containment", PART_CONCEPTS + "SELECT s AS src_name, t AS dst_name FROM pairs WHERE NOT same")
def abstraction_containment(spark, d):
    g = part_graph(spark, d)
    n = g.nodes.select("id", "name")
    return CG.containment_edges(g.nodes).join(n.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(
        n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst").select("src_name", "dst_name")


@query("q_abstraction_groups", PART_CONCEPTS + """
SELECT type, count(*) FILTER (level = 'specific') AS n_specific, count(*) FILTER (level = 'general') AS n_general,
       count(*) FILTER (level = 'abstract') AS n_abstract FROM nodes GROUP BY type""")
def abstraction_groups(spark, d):
    return CG.type_groups(part_graph(spark, d).nodes)


@query("q_concept_graph_stats", PART_CONCEPTS + """,
o AS (SELECT s AS name, count(*) AS c FROM alle GROUP BY s), i AS (SELECT t AS name, count(*) AS c FROM alle GROUP BY t)
SELECT count(*) AS total_nodes, CAST(sum(coalesce(o.c, 0)) AS BIGINT) AS total_edges, avg(coalesce(i.c, 0)) AS avg_in_degree, avg(coalesce(o.c, 0)) AS avg_out_degree,
       max(coalesce(i.c, 0)) AS max_in_degree, max(coalesce(o.c, 0)) AS max_out_degree,
       sum(coalesce(o.c, 0)) / (count(*) * (count(*) - 1.0)) AS density,
       (WITH RECURSIVE u AS (SELECT s AS a, t AS b FROM alle UNION SELECT t, s FROM alle),
        reach(id, label) AS (SELECT name, name FROM nodes UNION SELECT u.b, r.label FROM reach r JOIN u ON u.a = r.id)
        SELECT count(DISTINCT m) FROM (SELECT id, min(label) AS m FROM reach GROUP BY id)) AS number_of_components,
       (WITH RECURSIVE u AS (SELECT s AS a, t AS b FROM alle UNION SELECT t, s FROM alle),
        reach(id, label) AS (SELECT name, name FROM nodes UNION SELECT u.b, r.label FROM reach r JOIN u ON u.a = r.id)
        SELECT count(DISTINCT m) = 1 FROM (SELECT id, min(label) AS m FROM reach GROUP BY id)) AS is_connected
FROM nodes LEFT JOIN o USING (name) LEFT JOIN i USING (name)""")
def concept_graph_stats(spark, d):
    return CG.graph_statistics(part_graph(spark, d))


@query("q_node_type_counts", PART_CONCEPTS + """
SELECT 'type' AS attribute, type AS value, count(*) AS n_nodes FROM nodes GROUP BY type
UNION ALL SELECT 'abstraction_level', level, count(*) FROM nodes GROUP BY level""")
def node_type_counts(spark, d):
    return CG.type_counts(part_graph(spark, d).nodes)


@query("q_concept_frequency", PART_CONCEPTS + "SELECT name, count(*) AS frequency FROM c GROUP BY name HAVING count(*) >= 5")
def concept_frequency(spark, d):
    concepts, _ = part_concepts(spark, d)
    # the type rows repeat per part here and once per type in a set of distinct ones
    kept = concepts.filter("type <> 'KIND'").unionByName(concepts.filter("type = 'KIND'").distinct())
    return CG.concept_frequency(CG.frequent_concepts(kept, 5))


@query("q_concept_details", PART_CONCEPTS + """
SELECT name, 'types' AS attribute, type AS value FROM c GROUP BY ALL UNION ALL SELECT name, 'levels', level FROM c GROUP BY ALL""")
def concept_details(spark, d):
    concepts, _ = part_concepts(spark, d)
    c = concepts.withColumn("description", F.lit("")).withColumn("source_chunk", F.lit(""))
    return CG.concept_details(c).filter(F.col("attribute").isin("types", "levels"))


@query("q_relation_dedupe", """
SELECT count(*) AS n, min(source) AS first_source FROM (
  SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y, min(a) AS source FROM (
    SELECT lower(p_name) AS a, lower(string_split(p_name, ' ')[-1]) AS b FROM part UNION ALL
    SELECT lower(string_split(p_name, ' ')[-1]), lower(p_name) FROM part) WHERE a <> b GROUP BY x, y)""")
def relation_dedupe(spark, d):
    _, rels = part_concepts(spark, d)
    back = rels.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", (F.col("ord") + 10**9).alias("ord"))
    one = CG.dedupe_undirected(CG.valid_relationships(rels.unionByName(back)), "ord")
    return one.agg(F.count("*").alias("n"), F.min(F.least("source", "target")).alias("first_source"))


@query("q_adapter_edges", """
WITH k AS (SELECT p_name AS name, max(p_partkey) AS row FROM part GROUP BY p_name)
SELECT a.row AS src, b.row AS dst, p.p_type AS relation FROM (SELECT DISTINCT p_name AS s, p_type FROM part) p
JOIN k a ON a.name = p.s JOIN k b ON b.name = 'red ' || string_split(p.s, ' ')[-1]""")
def adapter_edges(spark, d):
    p = table(spark, d, "part")
    concepts = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    rels = p.select(F.col("p_name").alias("source"), F.concat(F.lit("red "), F.element_at(F.split("p_name", " "), -1)).alias("target"),
                    F.col("p_type").alias("relation")).distinct()
    return CG.adapter_edges(rels, concepts)


@query("q_import_form", """
SELECT p_name AS ":START_ID", p_type AS ":END_ID", 'made as' AS relation, p_brand AS description, replace(upper('made as'), ' ', '_') AS ":TYPE" FROM part""")
def import_form(spark, d):
    p = table(spark, d, "part")
    concepts = p.select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lit("general").alias("abstraction_level"), F.col("p_brand").alias("description"))
    rels = p.select(F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.lit("made as").alias("relation"), F.col("p_brand").alias("description"))
    return CG.import_form(concepts, rels)[1]
