"""Vector search and retrieval recipes; benchmark items are the questions."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import models
from ..functions import arrays as A
from ..functions.text import sha_id, short_key, triple_text
from ..operators.concept_graph import contained_names
from ..operators import extraction as X, graph as G, ranking as R, vectors as V
from ..plans import retrieve as Q
from ..session import cut_lineage, dense_index
from .base import TRIPLES, WITH_KG, documents, query, sq, table, words
from .graphs import keyed_edges, kg

DIM = models.ENCODER_DIM


def embed_sql(text: str) -> str:
    """SQL of the stand-in encoder: unit vector of hashed word counts."""
    w = words(f"lower({text})")
    b = f"list_transform({w}, lambda w: CAST(CAST('0x' || substring(md5(w), 1, 6) AS BIGINT) % {DIM} AS BIGINT))"
    counts = f"list_transform(range({DIM}), lambda i: len(list_filter(b, lambda x: x = i)))"
    return (f"(SELECT list_transform(c, lambda x: CAST(x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-12) AS FLOAT)) "
            f"FROM (SELECT {counts} AS c FROM (SELECT {b} AS b)))")


def dot_sql(a: str, b: str) -> str:
    return f"round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"


# ---- vectors ------------------------------------------------------------------------------------------

CENTROIDS = """
WITH flat AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label, list(a ORDER BY i) AS vec FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS a FROM flat GROUP BY label, i) GROUP BY label),
"""


def centroids(spark, d):
    """Mean vector of each label: the query set of the vector checks."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    # one list of `dimension` numbers per label
    return m.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda p: p["a"]).alias("vec"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("q_dot_topk", CENTROIDS + f"""
s AS (SELECT c.label AS query_id, e.vec_id AS id, {dot_sql('c.vec', 'e.embedding')} AS score FROM cen c, embeddings e)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 10""")
def dot_topk(spark, d):
    return V.topk(centroids(spark, d), vectors(spark, d), 10).select("query_id", "id", "score", "rank")


@query("q_cosine_topk", CENTROIDS + f"""
n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT c.label AS query_id, n.vec_id AS id, round(list_dot_product(c.vec, v) / (sqrt(list_dot_product(c.vec, c.vec)) * sqrt(list_dot_product(v, v))), 9) AS score FROM cen c, n)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 10""")
def cosine_topk(spark, d):
    return V.topk(centroids(spark, d), vectors(spark, d), 10, metric="cosine").select("query_id", "id", "score", "rank")


@query("q_minmax_scores", CENTROIDS + f"""
s AS (SELECT c.label AS query_id, e.vec_id AS id, {dot_sql('c.vec', 'e.embedding')} AS score FROM cen c, embeddings e)
SELECT query_id, id, round(0.05 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score FROM s WINDOW w AS (PARTITION BY query_id)""")
def minmax_scores(spark, d):
    return V.dense_scores(centroids(spark, d), vectors(spark, d), weight=0.05).withColumn("score", F.round("score", 6))


@query("q_vector_norms", """
SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))), 4) AS unit_sum
FROM embeddings""")
def vector_norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.round(A.norm("embedding"), 6).alias("norm"),
                    F.round(F.aggregate(A.l2_normalize("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("unit_sum"))


@query("q_vector_text_form", """SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings""")
def vector_text_form(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("t")).select("vec_id", A.parse_vector("t").alias("v"))
    return e.select("vec_id", F.size("v").cast("bigint").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("q_cell_search")
def cell_search(spark, d):
    v = vectors(spark, d)
    return V.cell_search(centroids(spark, d), v, V.train_cells(v, 16), 10, probes=8)


@query("q_code_search", f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 20 = 0)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 10""")
def code_search(spark, d):
    """Cells and codes with every cell visited: the candidates are wide enough that exact rescoring finds all."""
    v = vectors(spark, d)
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return V.code_search(V.build_code_index(v, cells=16), q, 10, probes=16, refine=40)


@query("q_code_recall")
def code_recall(spark, d):
    """Recall at 10 of a search in half of the cells, per query, against the exact search."""
    v = vectors(spark, d)
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return V.recall(V.code_search(V.build_code_index(v, cells=16), q, 10, probes=8), V.topk(q, v, 10))


# ---- scores and seeds ------------------------------------------------------------------------------------

@query("q_doc_freq_weight", WITH_KG + """
SELECT name AS id, 1.0 / count(DISTINCT doc_id) AS weight FROM mentions GROUP BY name""")
def doc_freq_weight(spark, d):
    t = kg(spark, d).triples
    return G.file_frequency_weight(X.mentions(t).select(F.col("name").alias("id"), F.col("ord.line_no").alias("file_id")))


@query("q_edge_to_node_mean", """
WITH x AS (SELECT l_returnflag AS query_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_discount AS score FROM lineitem)
SELECT query_id, id, round(avg(score), 9) AS score FROM (SELECT query_id, src AS id, score FROM x UNION ALL SELECT query_id, dst, score FROM x) GROUP BY ALL""")
def edge_to_node_mean(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
                                           F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_discount").alias("score"))
    return Q.mean_node_score(x).withColumn("score", F.round("score", 9))


@query("q_seed_merge", """
WITH n AS (SELECT c_mktsegment AS query_id, c_nationkey AS id, round(avg(c_acctbal), 6) AS score FROM customer GROUP BY ALL),
t AS (SELECT 'BUILDING' AS query_id, s_nationkey AS id, round(avg(s_acctbal), 6) AS score FROM supplier GROUP BY ALL)
SELECT coalesce(n.query_id, t.query_id) AS query_id, coalesce(n.id, t.id) AS id, coalesce(t.score, n.score) AS score
FROM n FULL JOIN t ON n.query_id = t.query_id AND n.id = t.id""")
def seed_merge(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("query_id"), F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal"), 6).alias("score"))
    t = table(spark, d, "supplier").groupBy(F.lit("BUILDING").alias("query_id"), F.col("s_nationkey").alias("id")).agg(F.round(F.avg("s_acctbal"), 6).alias("score"))
    return Q.merge_seeds(n, t)


@query("q_passage_scores", WITH_KG + """,
df AS (SELECT name, count(DISTINCT doc_id) AS f FROM mentions GROUP BY name),
s AS (SELECT n.type AS query_id, n.text_id, round(sum(1.0 / f), 9) AS score FROM nodes n JOIN df USING (name) GROUP BY n.type, n.text_id)
SELECT query_id, text_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text_id) <= 25""")
def passage_scores(spark, d):
    t = cut_lineage(kg(spark, d).triples)
    n = X.first_mentions(t)
    w = G.file_frequency_weight(X.mentions(t).select(F.col("name").alias("id"), F.col("ord.line_no").alias("file_id")))
    scores = n.select(F.col("type").alias("query_id"), F.col("name").alias("id")).join(w, "id").select("query_id", "id", F.col("weight").alias("score"))
    s = Q.passage_scores(scores, n.select(F.col("name").alias("id"), "text_id"), 1 << 30)
    s = s.withColumn("score", F.round("score", 9))
    from pyspark.sql import Window as W
    w2 = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("text_id"))
    return s.withColumn("rank", F.row_number().over(w2)).filter("rank <= 25")


@query("q_retrieved_text_count", WITH_KG + """
SELECT name AS id, count(DISTINCT text_id) AS n_texts FROM mentions GROUP BY name HAVING count(DISTINCT text_id) > 1""")
def retrieved_text_count(spark, d):
    t = kg(spark, d).triples
    return X.mentions(t).groupBy(F.col("name").alias("id")).agg(F.countDistinct("text_id").alias("n_texts")).filter("n_texts > 1")


# ---- recipes with SQL checks ---------------------------------------------------------------------------------

QUESTIONS = f"""
qs AS (SELECT item_id AS query_id, text, {embed_sql('text')} AS vec FROM benchmark),
"""


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", models.hash_embedding("text").alias("vec"))


def encode(c):
    return models.hash_embedding(c)


@query("q_text_retriever", "WITH " + QUESTIONS + f"""
ps AS (SELECT doc_id AS id, {embed_sql('text')} AS vec FROM documents),
s AS (SELECT q.query_id, p.id, {dot_sql('q.vec', 'p.vec')} AS score FROM qs q, ps p)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 5""")
def text_retriever(spark, d):
    p = documents(spark, d).select(F.col("doc_id").alias("id"), models.hash_embedding("text").alias("vec"))
    return Q.text_retriever(questions(spark, d), p, 5)


def kg_fact_rows(spark, d):
    """Distinct triples of all three kinds as searchable edges: their parts are stored, text and vector are made where they are read."""
    t = cut_lineage(kg(spark, d).triples.select("head", "relation", "tail").distinct())
    return t.withColumn("id", triple_text("head", "relation", "tail", "plain")).withColumn("vec", models.hash_embedding("id"))


@query("q_edge_retriever", WITH_KG + "," + QUESTIONS + f"""
es AS (SELECT id, text, {embed_sql('id')} AS vec FROM (
  SELECT DISTINCT head || ' ' || relation || ' ' || tail AS id, head || '  ' || relation || '  ' || tail AS text FROM triples)),
s AS (SELECT q.query_id, e.id, e.text, {dot_sql('q.vec', 'e.vec')} AS score FROM qs q, es e)
SELECT query_id, id, text, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 5""")
def edge_retriever(spark, d):
    return Q.edge_retriever(questions(spark, d), kg_fact_rows(spark, d), 5)


def kg_nodes(spark, d, flat=None):
    """Searchable nodes with vectors: id (name hash), name, vec."""
    f = flat or kg(spark, d)
    n = X.first_mentions(f.triples)
    return n.select(sha_id("name").alias("id"), "name", "type", F.col("text_id").alias("file_id"), models.hash_embedding("name").alias("vec"), "ord")


@query("q_degree_blend", WITH_KG + "," + QUESTIONS + f"""
ns AS (SELECT name AS id, {embed_sql('name')} AS vec FROM nodes),
e AS (SELECT DISTINCT head, tail FROM triples),
dg AS (SELECT name, count(*) AS c FROM (SELECT head AS name FROM e UNION ALL SELECT tail FROM e) GROUP BY name),
nd AS (SELECT ns.*, 0.3 * coalesce(dg.c, 0) / (SELECT max(c) FROM dg JOIN ns ON ns.id = dg.name) AS bias FROM ns LEFT JOIN dg ON dg.name = ns.id),
s AS (SELECT q.query_id, n.id, round(0.7 * list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(n.vec AS DOUBLE[])) /
  greatest(sqrt(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[]))) * sqrt(list_dot_product(CAST(n.vec AS DOUBLE[]), CAST(n.vec AS DOUBLE[]))), 1e-12) + n.bias, 9) AS score FROM qs q, nd n)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def degree_blend(spark, d):
    t = cut_lineage(kg(spark, d).triples)
    n = cut_lineage(X.first_mentions(t).select(F.col("name").alias("id"), short_key("name").alias("key"), models.hash_embedding("name").alias("vec")))
    return Q.degree_blend(questions(spark, d), n, keyed_edges(t), 3, key="key")


@query("q_first_nodes", WITH_KG + "," + QUESTIONS + f"""
ns AS (SELECT name AS id, {embed_sql('name')} AS vec FROM (SELECT name FROM (
  SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, kind, item, member, e) = 1) ORDER BY doc_id, kind, item, member, e LIMIT 20)),
s AS (SELECT q.query_id, n.id, {dot_sql('q.vec', 'n.vec')} AS score FROM qs q, ns n)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 3""")
def first_nodes(spark, d):
    n = X.first_mentions(kg(spark, d).triples).select(F.col("name").alias("id"), "ord", models.hash_embedding("name").alias("vec"))
    return Q.first_nodes(questions(spark, d), n, 3, order="ord")


@query("q_word_overlap", f"""
WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({words('lower(text)')})) AS word FROM benchmark),
n AS (SELECT doc_id AS id, list_distinct({words('lower(text)')}) AS w FROM documents),
h AS (SELECT query_id, id, count(*) * (1.0 / (1.0 + any_value(nw) / 10.0)) AS score FROM q
  JOIN (SELECT id, len(w) AS nw, unnest(w) AS word FROM n) USING (word) GROUP BY query_id, id)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM h
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def word_overlap(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return Q.word_overlap(q, documents(spark, d).select(F.col("doc_id").alias("id"), "text"), 3)


@query("q_first_words_match", WITH_KG + f"""
, q AS (SELECT DISTINCT item_id AS query_id, unnest(string_split({sq('lower(text)')}, ' ')[1:3]) AS part FROM benchmark)
SELECT query_id, count(DISTINCT name) AS n_nodes FROM q JOIN nodes ON contains(lower(name), part) WHERE part <> '' GROUP BY query_id""")
def first_words_match(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    # nodes are counted, so a short key stands for each
    n = X.first_mentions(kg(spark, d).triples).select(short_key("name").alias("id"), F.col("name").alias("text"))
    return Q.first_words_match(q, n).groupBy("query_id").agg(F.count("*").alias("n_nodes"))


@query("q_name_containment", WITH_KG + """
, t AS (SELECT DISTINCT lower(name) AS text FROM nodes WHERE type = 'event'), p AS (SELECT DISTINCT lower(name) AS part FROM nodes WHERE type = 'entity')
SELECT part, count(*) AS n_texts FROM t JOIN p ON contains(text, part) GROUP BY part""")
def name_containment(spark, d):
    """Events whose name contains an entity's name: all pairs, counted per entity."""
    n = cut_lineage(X.first_mentions(kg(spark, d).triples).select("type", F.lower("name").alias("name")).distinct())
    of = lambda kind, key, to: n.where(F.col("type") == kind).select(key.alias("key"), F.col("name").alias(to)).distinct()
    # events are counted, so a short key stands for each
    hit = contained_names(of("event", short_key("name"), "text"), of("entity", F.col("name"), "part"))
    return hit.groupBy(F.col("part_key").alias("part")).agg(F.count("*").alias("n_texts"))


@query("q_keyword_concepts", """
WITH c AS (SELECT p_partkey AS pos, p_name AS name, p_type AS type, lower(p_brand || ' ' || p_type) AS description FROM part),
q AS (SELECT DISTINCT p_name AS query_id, upper(substring(string_split(p_name, ' ')[1], 1, 1)) || substring(string_split(p_name, ' ')[1], 2) AS e1,
  upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) AS e2 FROM part),
e AS (SELECT query_id, e, unnest AS entity FROM (SELECT query_id || '/' || e2 AS query_id, unnest([0, 1]) AS e, unnest([lower(e1), lower(e2)]) AS unnest FROM q)),
h AS (SELECT query_id, name, min((0, e, k, pos)) AS o FROM (
  SELECT query_id, e, 0 AS k, pos, name FROM e JOIN c ON contains(lower(name), entity)
  UNION ALL SELECT query_id, e, 1, pos, name FROM e JOIN c ON contains(description, entity)) GROUP BY query_id, name),
r AS (SELECT DISTINCT p_name AS s, 'red ' || string_split(p_name, ' ')[-1] AS t FROM part),
l AS (SELECT s, t FROM r UNION ALL SELECT t, s FROM r),
k AS (SELECT name, min(pos) AS pos FROM c GROUP BY name),
m AS (SELECT query_id, name, o FROM h UNION ALL SELECT h.query_id, l.t, (1, h.o[2], h.o[3], k.pos) FROM h JOIN l ON l.s = h.name JOIN k ON k.name = l.t),
a AS (SELECT query_id, name, min(o) AS o FROM m GROUP BY query_id, name)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, name) AS INTEGER) AS rank, name,
       CASE WHEN o[1] = 1 THEN 'relation' WHEN o[3] = 0 THEN 'name' ELSE 'description' END AS source
FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o, name) <= 3""")
def keyword_concepts(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
                 F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("description"))
    adjective = F.initcap(F.element_at(F.split("p_name", " "), 1))
    q = p.select("p_name", F.initcap("p_type").alias("kind"), adjective.alias("adj")).distinct().select(
        F.concat_ws("/", "p_name", "kind").alias("query_id"), F.concat(F.lit("How does the "), "adj", F.lit(" and "), "kind", F.lit(" work")).alias("text"))
    r = p.select(F.col("p_name").alias("source"), F.concat(F.lit("red "), F.element_at(F.split("p_name", " "), -1)).alias("target")).distinct()
    return Q.keyword_concepts(q.filter("text IS NOT NULL"), c, r, 3)


# ---- recipes checked by brute force on small fixtures ----------------------------------------------------------

@query("q_neighbour_expansion")
def neighbour_expansion(spark, d):
    f = X.flatten(cut_lineage(models.rule_extraction(documents(spark, d))))
    n = kg_nodes(spark, d, f).select("id", "vec")
    e = f.triples.select(sha_id("head").alias("src"), sha_id("tail").alias("dst"))
    return Q.neighbour_expansion(questions(spark, d), n, e, 3)


def named_graph(spark, d):
    """(graph, nodes, triples): all nodes and first-wins edges of the three kinds of triples."""
    t = cut_lineage(kg(spark, d).triples)
    # vectors are searched once, and made where they are
    n = cut_lineage(X.first_mentions(t).select(sha_id("name").alias("id"), "name", "type", F.col("text_id").alias("file_id")))
    n = n.withColumn("vec", models.hash_embedding("name"))
    # ids travel as bytes, half as long as their digits
    e = t.groupBy(F.unhex(sha_id("head")).alias("src"), F.unhex(sha_id("tail")).alias("dst")).agg(
        F.min_by("relation", F.struct("line_no", "kind", "item", "member")).alias("relation"))
    e = cut_lineage(e.select(F.lower(F.hex("src")).alias("src"), F.lower(F.hex("dst")).alias("dst"), "relation"))
    return G.Graph(n.select("id", "name", "type", "file_id"), e), n, t


def mentioned_in(t):
    """(id, file_id): the passages that mention a node."""
    rows = X.mentions(t).select(F.unhex(sha_id("name")).alias("id"), F.unhex("text_id").alias("file_id")).distinct()
    return cut_lineage(rows.select(F.lower(F.hex("id")).alias("id"), F.lower(F.hex("file_id")).alias("file_id")))


# ---- personalised-rank retrieval over all three kinds of triples ----------------------------------------------

def rank_sql(alpha: float, tol: float, g: str = "g", v: str = "v", rounds: int = 20) -> str:
    """The recipe's rank as unrolled rounds over edges (src, dst, outdeg), vertices (id) and restart (query_id, id, w): a query
    keeps its ranks once their change falls below n * tol. The last table is r{rounds} (query_id, id, x)."""
    out = f"""
p AS MATERIALIZED (SELECT query_id, id, w / sum(w) OVER (PARTITION BY query_id) AS p FROM restart WHERE id IN (SELECT id FROM {v})),
q AS (SELECT DISTINCT query_id FROM p),
ends AS MATERIALIZED (SELECT id FROM {v} WHERE id NOT IN (SELECT src FROM {g})),
r0 AS MATERIALIZED (SELECT query_id, id, 1.0::DOUBLE / (SELECT count(*) FROM {v}) AS x FROM q, {v}),
f0 AS (SELECT query_id FROM q WHERE false),
"""
    for k in range(1, rounds + 1):
        j = k - 1
        out += f"""
d{k} AS (SELECT query_id, sum(x) AS d FROM r{j} WHERE id IN (SELECT id FROM ends) GROUP BY query_id),
m{k} AS (SELECT r.query_id, g.dst AS id, sum(r.x / g.outdeg) AS s FROM r{j} r JOIN {g} g ON g.src = r.id WHERE r.query_id NOT IN (SELECT query_id FROM f{j}) GROUP BY r.query_id, g.dst),
r{k} AS MATERIALIZED (SELECT r.query_id, r.id, CASE WHEN f.query_id IS NOT NULL THEN r.x ELSE {alpha} * coalesce(m.s, 0) + ({alpha} * coalesce(d.d, 0) + {round(1 - alpha, 10)}) * coalesce(p.p, 0) END AS x, r.x AS old
  FROM r{j} r LEFT JOIN f{j} f ON f.query_id = r.query_id LEFT JOIN m{k} m ON m.query_id = r.query_id AND m.id = r.id
  LEFT JOIN d{k} d ON d.query_id = r.query_id LEFT JOIN p ON p.query_id = r.query_id AND p.id = r.id),
f{k} AS MATERIALIZED (SELECT query_id FROM r{k} GROUP BY query_id HAVING sum(abs(x - old)) < (SELECT count(*) FROM {v}) * {tol}),
"""
    return out + f"ranks AS (SELECT query_id, id, x FROM r{rounds} WHERE query_id IN (SELECT query_id FROM f{rounds})),"


_RANKED = rank_sql(0.99, 1e-7) + """
s AS (SELECT query_id, id, round(x, 9) AS score FROM ranks JOIN ps USING (id) WHERE x > 0
  UNION ALL SELECT query_id, id, round(w, 9) FROM tx WHERE query_id NOT IN (SELECT query_id FROM nd))
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5"""
# the searchable graph: nodes, first-wins edges, passages, and each node's edge to the passage of its first mention
_WHOLE = "WITH " + TRIPLES + "," + QUESTIONS + f"""
ns AS MATERIALIZED (SELECT sha256(name) AS id, name, text_id, {embed_sql('name')} AS vec FROM nodes),
es AS MATERIALIZED (SELECT *, {embed_sql('id')} AS vec FROM (
  SELECT head, relation, tail, sha256(head) AS src, sha256(tail) AS dst, head || ' ' || relation || ' ' || tail AS id FROM (
    SELECT * FROM triples QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY doc_id, kind, item, member) = 1)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY head, tail) = 1)),
ps AS MATERIALIZED (SELECT text_id AS id, {embed_sql('p')} AS vec FROM (SELECT text_id, any_value(p) AS p FROM texts GROUP BY text_id)),
ge AS (SELECT src, dst FROM es UNION SELECT id, text_id FROM ns),
v AS MATERIALIZED (SELECT id FROM ns UNION SELECT id FROM ps),
g AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS outdeg FROM ge),
td AS (SELECT q.query_id, p.id, {dot_sql('q.vec', 'p.vec')} AS score FROM qs q, ps p),
tx AS MATERIALIZED (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS w
  FROM td WINDOW w AS (PARTITION BY query_id)),
"""
_RESTART = """
restart AS MATERIALIZED (SELECT query_id, id, w FROM nd WHERE id NOT IN (SELECT id FROM ps) UNION ALL SELECT query_id, id, w FROM tx WHERE query_id IN (SELECT query_id FROM nd)),
"""


# a question's entities and the node nearest to each (words with other than ASCII letters are blanked out: the
# SQL engine's word boundary knows ASCII only)
_ENTITIES = f"""
rn AS (SELECT query_id, text, list_filter(regexp_extract_all(regexp_replace(text, '[\\p{{L}}\\p{{Nd}}_]*[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}][\\p{{L}}\\p{{Nd}}_]*', '0', 'g'), '\\b[A-Z][a-z]+\\b(?:[ \\t\\n\\x0B\\f\\r]+[A-Z][a-z]+\\b)*'), lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in models.QUESTION_WORDS)}], x))[1:3] AS es FROM qs),
en AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(es) > 0 THEN es ELSE [text] END) AS entity FROM rn),
ev AS MATERIALIZED (SELECT entity, {embed_sql('entity')} AS vec FROM (SELECT DISTINCT entity FROM en)),
nq AS MATERIALIZED (SELECT ev.entity, n.id, {dot_sql('ev.vec', 'n.vec')} AS score FROM ev, ns n),
nb AS (SELECT entity, arg_max(id, (score, id)) AS id, max(score) AS score, min(score) AS lo, max(score) AS hi FROM nq GROUP BY entity),
"""


def whole_graph(spark, d):
    """(nodes, edges, passages, graph) of all three kinds of triples, with vectors."""
    records = X.with_text_ids(models.rule_extraction(documents(spark, d)))
    t = cut_lineage(X.all_triples(records))
    n = cut_lineage(X.first_mentions(t).select(sha_id("name").alias("id"), "name", "type", F.col("text_id").alias("file_id"), models.hash_embedding("name").alias("vec")))
    e = t.groupBy("head", "tail").agg(F.min_by("relation", F.struct("line_no", "kind", "item", "member")).alias("relation")).withColumn(
        "id", triple_text("head", "relation", "tail", "plain"))
    # a few names with spaces make equal facts: the first pair stands for the text
    e = e.groupBy("id").agg(F.min(F.struct("head", "tail", "relation")).alias("f")).select("id", "f.*")
    e = cut_lineage(e.select("id", "head", "relation", "tail", sha_id("head").alias("src"), sha_id("tail").alias("dst"), models.hash_embedding("id").alias("vec")))
    p = cut_lineage(records.groupBy(F.col("text_id").alias("id")).agg(F.min("passage").alias("text")).select("id", models.hash_embedding("text").alias("vec")))
    links = e.select("src", "dst").unionByName(n.select(F.col("id").alias("src"), F.col("file_id").alias("dst")))
    return n, e, p, R.store_edges(links, n.select("id").unionByName(p.select("id")))


def _passages(ranked):
    """Scores at nine places, ranked again so that ties follow the id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return ranked.select("query_id", "id", F.round("score", 9).alias("score")).withColumn("rank", F.row_number().over(w))


@query("q_fact_rank_passages", _WHOLE + f"""
ed AS MATERIALIZED (SELECT q.query_id, e.id, {dot_sql('q.vec', 'e.vec')} AS score FROM qs q, es e),
sp AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM ed GROUP BY query_id),
fx AS MATERIALIZED (SELECT query_id, id FROM ed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 50),
fv AS MATERIALIZED (SELECT id, vec FROM es WHERE id IN (SELECT id FROM fx)),
bk AS MATERIALIZED (SELECT f.id AS fact, arg_max(e.id, ({dot_sql('f.vec', 'e.vec')}, e.id)) AS id FROM fv f, es e GROUP BY f.id),
gr AS (SELECT fx.query_id, e.src, e.dst, CASE WHEN hi = lo THEN 1.0 ELSE ({dot_sql('q.vec', 'e.vec')} - lo) / (hi - lo) END AS score
  FROM fx JOIN bk ON bk.fact = fx.id JOIN es e ON e.id = bk.id JOIN qs q USING (query_id) JOIN sp USING (query_id)),
nd AS MATERIALIZED (SELECT query_id, id, avg(score) AS w FROM (SELECT query_id, src AS id, score FROM gr UNION ALL SELECT query_id, dst, score FROM gr) GROUP BY ALL),
""" + _RESTART + _RANKED)
def fact_rank_passages(spark, d):
    _, e, p, g = whole_graph(spark, d)
    return _passages(Q.fact_rank_passages(questions(spark, d), g, e, p, encode, 5))


@query("q_node_seed_passages", _WHOLE + f"""
nq AS (SELECT q.query_id, n.id, {dot_sql('q.vec', 'n.vec')} AS score FROM qs q, ns n),
nd AS MATERIALIZED (SELECT query_id, id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS w FROM (
  SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS r FROM nq) WHERE r <= 10),
""" + _RESTART + _RANKED)
def node_seed_passages(spark, d):
    """Seeds are the nodes nearest to the question."""
    n, e, p, g = whole_graph(spark, d)
    qs = questions(spark, d)
    return _passages(Q.fact_rank_passages(qs, g, e, p, encode, 5, seeds=Q.node_seeds(qs, n, Q.InferenceConfig.topk_nodes)))


@query("q_entity_seed_passages", _WHOLE + _ENTITIES + """
nm AS (SELECT query_id, id, max(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) AS w FROM en JOIN nb USING (entity) GROUP BY query_id, id),
nd AS MATERIALIZED (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, id) <= 20),
""" + _RESTART + _RANKED)
def entity_seed_passages(spark, d):
    """Seeds are the nodes nearest to the question's entities."""
    n, e, p, g = whole_graph(spark, d)
    qs = questions(spark, d)
    seeds = Q.entity_node_seeds(qs, n, models.capital_entities("text"), encode, Q.InferenceConfig.topk_nodes)
    return _passages(Q.fact_rank_passages(qs, g, e, p, encode, 5, seeds=seeds))


@query("q_entity_rank_passages", _WHOLE + _ENTITIES + """
gd AS (SELECT DISTINCT query_id, coalesce(x.id, nb.id) AS id FROM en JOIN nb USING (entity) LEFT JOIN ns x ON x.name = en.entity),
sd AS (SELECT * FROM gd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 20),
nf AS MATERIALIZED (SELECT DISTINCT sha256(name) AS id, text_id FROM mentions),
restart AS MATERIALIZED (SELECT query_id, id, 1.0 / f AS w FROM sd JOIN (SELECT id, count(*) AS f FROM nf GROUP BY id) USING (id)),
ev2 AS MATERIALIZED (SELECT id FROM ns),
eg AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS outdeg FROM (SELECT DISTINCT sha256(head) AS src, sha256(tail) AS dst FROM triples)),
""" + rank_sql(0.85, 1e-6, "eg", "ev2") + """
s AS (SELECT query_id, text_id AS file_id, round(sum(round(x, 4)), 4) AS score FROM ranks JOIN nf USING (id) WHERE round(x, 4) >= 0.001 GROUP BY ALL)
SELECT query_id, file_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) <= 5""")
def entity_rank_passages(spark, d):
    """The graph has no passages; every passage that mentions a node takes its rank."""
    t = cut_lineage(kg(spark, d).triples)
    n = cut_lineage(X.first_mentions(t).select(sha_id("name").alias("id"), "name", models.hash_embedding("name").alias("vec")))
    e = t.select(F.unhex(sha_id("head")).alias("src"), F.unhex(sha_id("tail")).alias("dst")).distinct().select(
        F.lower(F.hex("src")).alias("src"), F.lower(F.hex("dst")).alias("dst"))
    files = mentioned_in(t)
    r = Q.entity_rank_passages(questions(spark, d), G.Graph(n.select("id"), e), n, files, models.capital_entities("text"), encode, 5)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("file_id"))
    return r.select("query_id", "file_id", F.round("score", 4).alias("score")).withColumn("rank", F.row_number().over(w))


@query("q_path_retriever")
def path_retriever(spark, d):
    g, n, _ = named_graph(spark, d)
    return Q.path_retriever(questions(spark, d), g.edges, n, models.capital_entities("text"), encode,
                            lambda: F.pmod(F.xxhash64("query_id", "tail"), F.lit(6)))


@query("q_large_graph_passages")
def large_graph_passages(spark, d):
    g, n, t = named_graph(spark, d)
    return Q.large_graph_passages(questions(spark, d), g, n, mentioned_in(t).withColumnRenamed("file_id", "text_id"), models.capital_entities("text"), encode)


@query("q_large_graph_paths")
def large_graph_paths(spark, d):
    g, n, _ = named_graph(spark, d)
    return Q.large_graph_paths(questions(spark, d), g.edges, n, models.capital_entities("text"), encode,
                               score=F.size("path"), rate=F.pmod(F.xxhash64("query_id", "tail"), F.lit(6)), stop_words=["the", "of"])
