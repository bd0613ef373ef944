"""Retrieval recipes over batches of questions: DataFrames in, ranked DataFrames out.

Inputs share a few shapes: ``queries`` (query_id, text, and ``vec`` where vectors are used),
``nodes``/``edges``/``passages`` with an ``id`` and a ``vec``, and the graph tables of
``operators.graph``. Model calls are Column builders or DataFrame functions given by the caller.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import dot
from ..functions.text import phrase, squeeze, triple_text
from .. import models
from ..operators import graph as G, outputs as O, paths as P, ranking as R, vectors as V
from ..operators.concept_graph import contained_names
from ..operators.quality import fuzzy_keywords
from ..session import cut_lineage, dense_index


OVERLAP_BLOCK = 1024  # rows of a block of the word lists
R_DECIMALS = 12  # ranks are compared at this precision, so that equal ones tie


@dataclass(frozen=True)
class InferenceConfig:
    """The defaults of the retrieval recipes."""
    topk: int = 5
    depth: int = 4
    width: int = 4
    weight_adjust: float = 1.0
    topk_edges: int = 50
    topk_nodes: int = 10
    ppr_alpha: float = 0.99
    ppr_max_iter: int = 2000
    ppr_tol: float = 1e-7


@dataclass(frozen=True)
class LargeGraphConfig:
    """The defaults of the large-graph recipes."""
    topk: int = 5
    sources_per_entity: int = 10
    area: int = 250
    threshold: float = 0.00005
    per_seed: int = 50
    overall: int = 25
    restart: float = 0.4
    iterations: int = 30
    depth: int = 3
    width: int = 3
    neighbours: int = 3


# ---- flat retrievers -----------------------------------------------------------------------------

def edge_retriever(queries: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Best triples per question. ``edges``: id, head, relation, tail, vec."""
    hits = V.topk(queries, edges, k)
    return hits.join(edges.select("id", triple_text("head", "relation", "tail", "wide").alias("text")), "id").select(
        "query_id", "rank", "id", "text", "score")


def text_retriever(queries: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """Best passages per question by inner product."""
    return V.topk(queries, passages, k).select("query_id", "rank", "id", "score")


def flat_index(queries: DataFrame, rows: DataFrame, k: int = 5, normalized: bool = True) -> DataFrame:
    """Flat inner-product search, on unit vectors when ``normalized``."""
    return V.topk(queries, rows, k, metric="cosine" if normalized else "ip").select("query_id", "rank", "id", "score")


# ---- seeds ----------------------------------------------------------------------------------------

def entity_rows(queries: DataFrame, entities: Column) -> DataFrame:
    """(query_id, entity): recognised entities, or the question itself when there are none."""
    return queries.select("query_id", F.explode(F.when(F.size(entities) > 0, entities).otherwise(
        F.array("text"))).alias("entity")).distinct()


def ground_entities(entities: DataFrame, nodes: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Exact node of each entity name, else its single nearest node: (query_id, id)."""
    names = entities.select("entity").distinct()
    exact = names.join(nodes.select(F.col("name").alias("entity"), "id"), "entity").groupBy("entity").agg(F.min("id").alias("id"))
    rest = names.join(exact, "entity", "left_anti").select(F.col("entity").alias("query_id"), encode(F.col("entity")).alias("vec"))
    near = V.topk(rest, nodes, 1).select(F.col("query_id").alias("entity"), "id")
    return entities.join(exact.unionByName(near), "entity").select("query_id", "id").distinct()


def cap_seeds(seeds: DataFrame, limit: int, score: str | None = None) -> DataFrame:
    """At most ``limit`` seeds per question, best score (then id) first: the recipe's own cap."""
    order = ([F.desc(score)] if score else []) + [F.asc("id")]
    w = W.partitionBy("query_id").orderBy(*order)
    return seeds.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


# ---- model filters ----------------------------------------------------------------------------------

def model_fact_filter(questions: DataFrame, make_generator) -> Callable[[DataFrame], DataFrame]:
    """A ``keep_facts`` for `edge_seeds`: the model names the facts (query_id, head, relation, tail) to keep.

    One prompt per question, over its few retrieved facts. A call that fails, or an answer that cannot be read,
    passes the question's facts through unchanged; an answer with an empty list keeps none.
    """
    def keep(facts: DataFrame) -> DataFrame:
        facts = cut_lineage(facts.select("query_id", "head", "relation", "tail").distinct())
        return _filtered(questions, facts, F.array("head", "relation", "tail"), FACT_PROMPT, "fact", make_generator,
                         lambda rows: O.first_triplets(rows, "_a", "_k"), lambda k: (k[0].alias("head"), k[1].alias("relation"), k[2].alias("tail")), facts)
    return keep


def model_name_filter(questions: DataFrame, make_generator) -> Callable[[DataFrame], DataFrame]:
    """A ``keep_names`` for `large_graph_passages`: the model names the keywords (query_id, name) to keep, and
    failures pass all through, as in `model_fact_filter`."""
    def keep(names: DataFrame) -> DataFrame:
        names = cut_lineage(names.select("query_id", "name").distinct())
        return _filtered(questions, names, F.col("name"), NAME_PROMPT, "keywords", make_generator,
                         lambda rows: O.keywords(rows, "_a", "_k"), lambda k: (k.alias("name"),), names)
    return keep


FACT_PROMPT = "Question: {q}\nFacts: {x}\nAnswer with a JSON object whose list \"fact\" holds the facts that help, each as three texts."
NAME_PROMPT = "Question: {q}\nKeywords: {x}\nAnswer with a JSON object whose list \"keywords\" holds the keywords that help."


def _filtered(questions, rows, item: Column, prompt: str, field: str, make_generator, read, columns, every: DataFrame) -> DataFrame:
    """Rows that the model keeps of each question's few rows, all where its answer cannot be used."""
    head, middle, end = prompt.replace("{q}", "\0").replace("{x}", "\0").split("\0")
    listed = rows.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("_x")).join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    asked = models.generate(listed.withColumn("_p", F.concat(F.lit(head), "_q", F.lit(middle), "_x", F.lit(end))), "_p", "_a", make_generator)
    asked = cut_lineage(asked.select("query_id", "_a"))
    usable = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_a"), f"$.{field}", "variant"))
    good = asked.where(F.startswith(usable, F.lit("ARRAY")))
    kept = read(good).select("query_id", F.explode("_k").alias("k")).select("query_id", *columns(F.col("k")))
    return kept.distinct().unionByName(every.join(good.select("query_id"), "query_id", "left_anti"))


# ---- personalised-rank retrievers -------------------------------------------------------------------

def entity_rank_passages(queries: DataFrame, g: G.Graph, nodes: DataFrame, node_files: DataFrame, entities: Column,
                         encode: Callable[[Column], Column], k: int = 5, config: InferenceConfig = InferenceConfig(),
                         alpha: float = R.ALPHA, tol: float = R.TOL) -> DataFrame:
    """Entities -> nodes weighted by 1/document frequency -> rank -> passages by summed node rank.

    The graph excludes passages; ``node_files`` (id, file_id) tells which passages mention a node.
    Ranks are rounded to four places and dropped below 0.001 before they are summed.
    """
    seeds = cap_seeds(ground_entities(entity_rows(queries, entities), nodes, encode), 2 * config.topk_nodes)
    weights = seeds.join(G.file_frequency_weight(node_files), "id").select("query_id", "id", "weight")
    ranks = R.personalized_pagerank(g.edges, g.vertices, weights, alpha=alpha, tol=tol)
    sums = ranks.rounded().join(node_files.filter(F.col("file_id") != G.CONCEPT_FILE).distinct(), "id").groupBy(
        "query_id", "file_id").agg(F.round(F.sum("rank"), 9).alias("score"))  # sums of four places: equal ones tie
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("file_id"))
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def edge_seeds(queries: DataFrame, edges: DataFrame, k: int, encode: Callable[[Column], Column],
               keep_facts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Node seeds from the best edges: (query_id, id, score) with the mean scaled edge score.

    ``edges``: id, src, dst, head, relation, tail, vec. ``keep_facts`` may drop or rewrite facts
    (query_id, head, relation, tail); each is then grounded to its nearest edge again.
    """
    hits = V.topk(queries, edges, k)
    facts = hits.join(edges.select("id", "head", "relation", "tail"), "id").select("query_id", "head", "relation", "tail")
    if keep_facts is not None:
        facts = keep_facts(facts)
    facts = facts.withColumn("fact", triple_text("head", "relation", "tail", "plain"))
    back = V.topk(facts.select(F.col("fact").alias("query_id")).distinct().withColumn("vec", encode(F.col("query_id"))), edges, 1)
    # the grounded edge is scored against the question itself, over the range of all edges
    span = hits.select("query_id", "lo", "hi").distinct()
    grounded = facts.select("query_id", "fact").join(back.select(F.col("query_id").alias("fact"), "id"), "fact").join(
        queries.select("query_id", F.col("vec").alias("_q")), "query_id").join(edges.select("id", "src", "dst", "vec"), "id").join(span, "query_id")
    scored = grounded.withColumn("score", V.min_max(F.round(dot("_q", "vec"), V.DECIMALS), "lo", "hi"))
    return mean_node_score(scored)


def mean_node_score(edge_scores: DataFrame) -> DataFrame:
    """Mean score of the retrieved edges at each end node: (query_id, id, score)."""
    return edge_scores.select("query_id", "score", F.explode(F.array("src", "dst")).alias("id")).groupBy("query_id", "id").agg(
        F.avg("score").alias("score"))


def node_seeds(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Best nodes of the question vector with their scaled scores."""
    return V.topk(queries, nodes, k).select("query_id", "id", V.min_max("score", "lo", "hi").alias("score"))


def entity_node_seeds(queries: DataFrame, nodes: DataFrame, entities: Column, encode: Callable[[Column], Column], k: int) -> DataFrame:
    """Nearest node of each recognised entity with its scaled score, at most 2k per question."""
    e = entity_rows(queries, entities)
    hit = V.topk(e.select(F.col("entity").alias("query_id")).distinct().withColumn("vec", encode(F.col("query_id"))), nodes, 1)
    s = e.join(hit.select(F.col("query_id").alias("entity"), "id", V.min_max("score", "lo", "hi").alias("score")), "entity")
    return cap_seeds(s.groupBy("query_id", "id").agg(F.max("score").alias("score")), 2 * k, "score")


def merge_seeds(node_scores: DataFrame, text_scores: DataFrame) -> DataFrame:
    """Union of both score tables; where an id occurs in both the text score stands."""
    return node_scores.select("query_id", "id", F.col("score").alias("_n")).join(
        text_scores.select("query_id", "id", F.col("score").alias("_t")), ["query_id", "id"], "full").select(
        "query_id", "id", F.coalesce("_t", "_n").alias("score"))


def fact_rank_passages(queries: DataFrame, g: G.Graph | R.StoredEdges, edges: DataFrame, passages: DataFrame, encode: Callable[[Column], Column],
                       k: int = 5, config: InferenceConfig = InferenceConfig(), seeds: DataFrame | None = None,
                       keep_facts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Best facts and all passages seed the rank; the best passages are returned.

    A question without node seeds falls back to plain passage similarity. ``g`` must contain the
    searchable nodes and the passages. This form runs the recipe's rounds, from a uniform start until the change
    falls below n * tol, with one restart weight per question and passage; `converged_fact_passages` is
    the form for many questions and passages.
    """
    node_scores = cut_lineage(seeds if seeds is not None else edge_seeds(queries, edges, config.topk_edges, encode, keep_facts))
    text_scores = cut_lineage(V.dense_scores(queries, passages, config.weight_adjust))
    with_nodes = node_scores.select("query_id").distinct()
    weights = merge_seeds(node_scores, text_scores).join(with_nodes, "query_id", "left_semi").withColumnRenamed("score", "weight")
    ranks = R.personalized_pagerank(g if isinstance(g, R.StoredEdges) else g.edges, g.vertices, weights, config.ppr_alpha, config.ppr_max_iter, config.ppr_tol)
    ranked = ranks.top(passages, k).filter("rank > 0").select("query_id", "id", F.col("rank").alias("score"), F.col("position").alias("rank"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    plain = text_scores.join(with_nodes, "query_id", "left_anti").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.unionByName(plain.select("query_id", "id", "score", "rank"))


def converged_fact_passages(queries: DataFrame, g: G.Graph | R.StoredEdges, edges: DataFrame, passages: DataFrame, encode: Callable[[Column], Column],
                            k: int = 5, config: InferenceConfig = InferenceConfig(), seeds: DataFrame | None = None,
                            keep_facts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`fact_rank_passages` at the fixed point of the rank, without a row per question and passage.

    A question without node seeds falls back to plain passage similarity. ``g`` must contain the
    searchable nodes and the passages.

    The rank is linear in its restart, and a passage's restart weight, the scaled inner product, is linear in
    the question's vector. So one rank per vector dimension, and one of the constant, is made for all
    questions together; a question's part is an inner product with these, searched like any vectors. Only
    the few node seeds are pushed per question. ``config.ppr_tol`` bounds what is missing of each rank.
    """
    node_scores = cut_lineage(seeds if seeds is not None else edge_seeds(queries, edges, config.topk_edges, encode, keep_facts))
    near = cut_lineage(V.topk(queries, passages, k))
    scaled = V.min_max("score", "lo", "hi") * config.weight_adjust
    with_nodes = cut_lineage(node_scores.select("query_id").distinct())
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    plain = near.join(with_nodes, "query_id", "left_anti").select("query_id", "id", scaled.alias("score")).withColumn("rank", F.row_number().over(w))
    dims = (passages.select(F.size("vec")).first() or [None])[0]
    if dims is None:
        return plain
    graph = g if isinstance(g, R.StoredEdges) else R.store_edges(g.edges, g.vertices)

    # where an id is both node and passage the passage's score stands
    own = node_scores.join(passages.select("id"), "id", "left_anti").join(graph.vertices.select("id"), "id", "left_semi").where("score > 0")
    own = cut_lineage(own.groupBy("query_id", "id").agg(F.sum("score").alias("w")))
    mass = own.groupBy("query_id").agg(F.sum("w").alias("mass"))
    y = R.converged_rank(graph, own.join(mass, "query_id").select("query_id", "id", (F.col("w") / F.col("mass")).alias("y")),
                         config.ppr_alpha, config.ppr_tol, ["y"], ["query_id"])
    pushed = cut_lineage(y.join(mass, "query_id").select("query_id", "id", (F.col("y") * F.col("mass")).alias("y")))

    columns = [f"d{i}" for i in range(dims + 1)]
    basis = passages.select("id", *[F.col("vec")[i].cast("double").alias(c) for i, c in enumerate(columns[:-1])], F.lit(1.0).alias(columns[-1]))
    basis = cut_lineage(R.converged_rank(graph, basis, config.ppr_alpha, config.ppr_tol, columns).select("id", F.array(*columns).alias("vec")))
    sums = basis.agg(*[F.coalesce(F.sum(F.col("vec")[i]), F.lit(0.0)) for i in range(dims + 1)]).first()  # one number per dimension
    flat, span = F.col("hi") == F.col("lo"), F.col("hi") - F.col("lo")
    coefficients = queries.join(with_nodes, "query_id", "left_semi").join(near.select("query_id", "lo", "hi").distinct(), "query_id").select(
        "query_id", F.transform(F.concat(F.transform("vec", lambda x: F.when(flat, 0.0).otherwise(x.cast("double") / span)),
                                         F.array(F.when(flat, 1.0).otherwise(-F.col("lo") / span))), lambda x: x * config.weight_adjust).alias("vec"))
    coefficients = cut_lineage(coefficients)

    # what seeds push is never negative: a passage they do not reach needs one of the k best of the rest
    texts = basis.join(passages.select("id"), "id", "left_semi")
    best = V.topk(coefficients, texts, k, id_ascending=True).select("query_id", "id", F.lit(0.0).alias("y"))
    rows = best.unionByName(pushed.join(texts.select("id"), "id", "left_semi")).groupBy("query_id", "id").agg(F.sum("y").alias("y"))
    whole = pushed.groupBy("query_id").agg(F.sum("y").alias("pushed"))
    total = coefficients.join(whole, "query_id", "left").select("query_id", F.col("vec").alias("_c"), (F.coalesce("pushed", F.lit(0.0)) + dot(
        "vec", F.array(*[F.lit(float(x)) for x in sums]))).alias("total"))
    scored = rows.join(texts.select("id", "vec"), "id").join(total, "query_id").select(
        "query_id", "id", F.round((F.col("y") + dot("_c", "vec")) / F.col("total"), R_DECIMALS).alias("score"))
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.unionByName(plain)


def passage_scores(node_scores: DataFrame, text_edges: DataFrame, k: int) -> DataFrame:
    """Sum node scores per linked passage, best ``k``: node_scores (query_id, id, score), edges id -> text_id."""
    s = node_scores.join(text_edges, "id").groupBy("query_id", "text_id").agg(F.sum("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("text_id"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def large_graph_passages(queries: DataFrame, g: G.Graph, nodes: DataFrame, text_edges: DataFrame, entities: Column,
                         encode: Callable[[Column], Column], config: LargeGraphConfig = LargeGraphConfig(),
                         keep_names: Callable[[DataFrame], DataFrame] | None = None, words_filter: bool = False, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """Entities -> near nodes -> kept names -> one walk sample and rank per seed -> passages.

    ``keep_names`` filters (query_id, name) candidates; a returned name is matched exactly, else
    fuzzily. Sampling and ranking happen once per distinct seed node, for all questions together.
    """
    e = entity_rows(queries, entities)
    n_entities = e.groupBy("query_id").agg(F.count("*").alias("_e"))
    near = V.topk(e.select(F.col("entity").alias("query_id")).distinct().withColumn("vec", encode(F.col("query_id"))), nodes, config.sources_per_entity)
    cand = e.join(near.select(F.col("query_id").alias("entity"), "id", "score"), "entity").join(nodes.select("id", "name"), "id").groupBy(
        "query_id", "name").agg(F.max("score").alias("score"), F.min("id").alias("id"))
    if keep_names is not None:
        kept = keep_names(cand.select("query_id", "name")).select("query_id", F.col("name").alias("keyword"))
        # a question has at most entities x sources candidates
        pool = cand.groupBy("query_id").agg(F.collect_list("name").alias("_names"))
        matched = fuzzy_keywords(kept.join(pool, "query_id"), "keyword", "_names", "name")
        cand = cand.join(matched.select("query_id", "name").distinct(), ["query_id", "name"], "left_semi")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    seeds = cut_lineage(cand.join(n_entities, "query_id").withColumn("_r", F.row_number().over(w)).filter(
        F.col("_r") <= 2 * F.col("_e")).select("query_id", "id", "name"))
    weight = text_edges.join(seeds.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        (F.lit(1.0) / F.countDistinct("text_id")).alias("weight"))
    weighted = seeds.join(weight, "id")
    if words_filter:
        weighted = weighted.filter(F.col("weight") >= config.threshold)
    sample = R.walk_sample(g.edges, weighted.select("id"), config.area, config.restart)
    scores = R.source_rank(g.edges, sample, config.iterations)
    rows = weighted.select("query_id", F.col("id").alias("source"), "weight").join(scores, "source")
    if words_filter:
        # phrases of the seeds that pass the threshold, stop words out
        phrases = weighted.groupBy("query_id").agg(F.collect_set(phrase("name", KEYWORD_STOP if stop_words is None else stop_words)).alias("_p"))
        named = rows.join(nodes.select("id", "name"), "id").join(phrases, "query_id")
        rows = named.filter(F.exists("_p", lambda p: (p != "") & F.contains(F.lower("name"), p)))
    else:
        s = W.partitionBy("query_id", "source").orderBy(F.desc("score"), F.asc("id"))
        rows = rows.filter("score > 0").withColumn("_r", F.row_number().over(s)).filter(F.col("_r") <= config.per_seed)
    rows = rows.select("query_id", "source", "id", (F.col("score") * F.col("weight")).alias("score"))
    # the best rows over all seeds; a node found from two seeds stays twice and is summed later
    o = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"), F.asc("source"))
    best = rows.withColumn("_r", F.row_number().over(o)).filter(F.col("_r") <= config.overall)
    return passage_scores(best.select("query_id", "id", "score"), text_edges, config.topk)


# ---- path retrievers --------------------------------------------------------------------------------

def path_retriever(queries: DataFrame, edges: DataFrame, nodes: DataFrame, entities: Column, encode: Callable[[Column], Column],
                   rate: Callable[[], Column], enough: Callable[[DataFrame], DataFrame] | None = None, k: int = 5,
                   config: InferenceConfig = InferenceConfig()) -> DataFrame:
    """Seeds -> rounds of expansion and pruning -> triples along the kept paths."""
    e = entity_rows(queries, entities)
    per = e.groupBy("query_id").agg(F.count("*").alias("_n"))
    near = V.topk(e.select(F.col("entity").alias("query_id")).distinct().withColumn("vec", encode(F.col("query_id"))), nodes, k + 1)
    vec = e.join(per, "query_id").join(near.select(F.col("query_id").alias("entity"), "id", "score", "rank"), "entity").filter(
        F.col("rank") <= F.floor(F.lit(k) / F.col("_n")) + 1).select("query_id", "id", "score")
    exact = e.join(nodes.select(F.col("name").alias("entity"), "id"), "entity").select("query_id", "id", F.lit(float("inf")).alias("score"))
    seeds = vec.unionByName(exact).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    starts = cap_seeds(seeds, 2 * k, "score").select("query_id", "id")
    found = P.search(starts, edges, rate, config.depth, k, enough)
    return path_triples(found, nodes)


def path_triples(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Printed triples of paths whose nodes are ids: (query_id, path, place, triple)."""
    t = paths.select("query_id", "path", F.posexplode(G.path_triples("path")).alias("place", "t"))
    n = nodes.select("id", "name")
    return (t.join(n.select(F.col("id").alias("_h"), F.col("name").alias("head")), F.col("t.head") == F.col("_h"))
            .join(n.select(F.col("id").alias("_t"), F.col("name").alias("tail")), F.col("t.tail") == F.col("_t"))
            .select("query_id", "path", "place", triple_text("head", "t.relation", "tail").alias("triple")))


def large_graph_paths(queries: DataFrame, edges: DataFrame, nodes: DataFrame, entities: Column, encode: Callable[[Column], Column],
                      score: Column, rate: Column, enough: Callable[[DataFrame], DataFrame] | None = None,
                      stop_words: list[str] | None = None, config: LargeGraphConfig = LargeGraphConfig()) -> DataFrame:
    """Large-graph path search: three near nodes per entity, capped expansion, rating, pruning."""
    e = entity_rows(queries, entities)
    near = V.topk(e.select(F.col("entity").alias("query_id")).distinct().withColumn("vec", encode(F.col("query_id"))), nodes, config.neighbours)
    seeds = e.join(near.select(F.col("query_id").alias("entity"), "id"), "entity").select("query_id", "id").distinct()
    named = seeds.join(nodes.select("id", "name"), "id")
    live = named.select("query_id", F.array("name").alias("path"), F.array("id").alias("nodes"), F.col("id").alias("tail"),
                        F.lit("Node").alias("tail_type"))
    live, done = cut_lineage(live), None
    for _ in range(config.depth):
        grown = P.expand_capped(live, edges, nodes, stop_words or [], score, config.width)
        kept = P.prune(grown, rate, config.topk, drop_zero=True, path_desc=False).drop("rating", "place")
        # a question none of whose paths could grow keeps what it has
        stuck = live.join(kept.select("query_id").distinct(), "query_id", "left_anti")
        live = cut_lineage(kept.unionByName(stuck.select(*kept.columns)))
        if enough is not None:
            stop = cut_lineage(enough(live).select("query_id").distinct())
            out = live.join(stop, "query_id", "left_semi")
            done = out if done is None else done.unionByName(out)
            live = live.join(stop, "query_id", "left_anti")
    final = live if done is None else done.unionByName(live)
    return final.select("query_id", "path", F.posexplode(G.path_triples("path")).alias("place", "t")).select(
        "query_id", "path", "place", triple_text("t.head", "t.relation", "t.tail").alias("triple"))


# ---- heuristic graph retrievers ---------------------------------------------------------------------

def neighbour_expansion(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """Cosine top 2k, the first k//2+1 of them add two successors each; first k overall.

    Found nodes come first by similarity, added ones after them in the order of their parents.
    """
    hits = V.topk(queries, nodes, 2 * k, metric="cosine").select("query_id", "id", "rank")
    w = W.partitionBy("query_id", "src").orderBy("dst")
    more = hits.filter(F.col("rank") <= k // 2 + 1).withColumnRenamed("id", "src").join(edges.select("src", "dst").distinct(), "src").withColumn(
        "_n", F.row_number().over(w)).filter("_n <= 2").select("query_id", F.col("dst").alias("id"), F.struct(F.lit(1).alias("a"), F.col("rank").alias("b"), F.col("_n").alias("c")).alias("o"))
    rows = hits.select("query_id", "id", F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).alias("o")).unionByName(more)
    first = rows.groupBy("query_id", "id").agg(F.min("o").alias("o"))
    p = W.partitionBy("query_id").orderBy("o")
    return first.withColumn("rank", F.row_number().over(p)).filter(F.col("rank") <= k).drop("o")


def degree_blend(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3, degree_weight: float = 0.3,
                 similarity_weight: float = 0.7, key: str = "id") -> DataFrame:
    """Weighted sum of relative degree and cosine similarity, best ``k``. ``key``: the nodes' column that edges name."""
    deg = cut_lineage(G.degrees(nodes.select(F.col(key).alias("id")), edges).select(F.col("id").alias(key), "degree"))
    top = max(1, deg.agg(F.max("degree")).first()[0] or 0)
    rows = nodes.join(deg, key).select("id", "vec", (F.lit(degree_weight) * F.col("degree") / top).alias("bias"))
    return V.topk(queries, rows, k, metric="cosine", weight=similarity_weight, bias="bias", id_ascending=True).select("query_id", "id", "rank", "score")


def first_nodes(queries: DataFrame, nodes: DataFrame, k: int = 3, scan: int = 20, order: str = "pos") -> DataFrame:
    """Inner product over the first ``scan`` nodes only (the light-weight recipe's own limit)."""
    head = nodes.orderBy(order).limit(scan)
    return V.topk(queries, head, k).select("query_id", "id", "rank", "score")


def word_overlap(queries: DataFrame, nodes: DataFrame, k: int = 3, block: int = OVERLAP_BLOCK) -> DataFrame:
    """Shared words damped by length: overlap / (1 + words/10), best ``k`` with a positive score.

    A question without any shared word gets the first ``k`` nodes (score NULL). See `overlap_candidates`.
    """
    index = overlap_index(queries, nodes, block)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = index.scores(overlap_candidates(index, k)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = cut_lineage(best.select("query_id", "id", "score", "rank"))
    first = [r["id"] for r in nodes.select("id").orderBy("id").limit(k).collect()]  # k ids
    lost = queries.select("query_id").join(best.select("query_id").distinct(), "query_id", "left_anti")
    if not first:
        return best
    fallback = lost.select("query_id", F.posexplode(F.array(*[F.lit(x) for x in first])).alias("_p", "id")).select(
        "query_id", "id", F.lit(None).cast("double").alias("score"), (F.col("_p") + 1).alias("rank"))
    return best.unionByName(fallback)


@dataclass(frozen=True)
class OverlapIndex:
    """Inverted lists of the questions' words, each in blocks from short to long nodes.

    ``terms``: query_id, word, place (1 for the question's most frequent word); ``postings``: word, block, id,
    damp; ``blocks``: word, block, damp and id of its first row, which no later row beats.
    """

    texts: DataFrame
    nodes: DataFrame
    terms: DataFrame
    postings: DataFrame
    blocks: DataFrame

    def scores(self, pairs: DataFrame) -> DataFrame:
        """Exact scores of candidates (query_id, id) from the whole word sets."""
        both = pairs.distinct().join(self.nodes, "id").join(self.texts, "query_id")
        return both.select("query_id", "id", (F.size(F.array_intersect("words", "asked")) * F.col("damp")).alias("score"))


def overlap_index(queries: DataFrame, nodes: DataFrame, block: int = OVERLAP_BLOCK) -> OverlapIndex:
    split = lambda t: F.array_distinct(F.filter(F.split(squeeze(F.lower(t)), " "), lambda x: x != ""))
    texts = cut_lineage(queries.select("query_id", split(F.col("text")).alias("asked")))
    kept = cut_lineage(nodes.select("id", split(F.col("text")).alias("words")).select("id", "words", (F.lit(1.0) / (1.0 + F.size("words") / 10.0)).alias("damp")))
    wanted = cut_lineage(texts.select(F.explode("asked").alias("word")).distinct())
    lists = kept.select("id", "damp", F.explode("words").alias("word")).join(wanted, "word", "left_semi")
    # one parallel sort of all lists; a word that every node holds spans many partitions and many blocks
    postings = dense_index(lists, ["word", F.desc("damp"), "id"], "_at").withColumn("block", F.floor(F.col("_at") / block))
    counts = postings.groupBy("word").agg(F.count("*").alias("n"))
    w = W.partitionBy("query_id").orderBy(F.desc("n"), "word")  # the words of one question
    terms = texts.select("query_id", F.explode("asked").alias("word")).join(counts, "word").select("query_id", "word", F.row_number().over(w).alias("place"))
    first = F.min(F.struct((-F.col("damp")).alias("d"), "id")).alias("f")
    blocks = postings.groupBy("word", "block").agg(first).select("word", "block", (-F.col("f.d")).alias("damp"), F.col("f.id").alias("id"))
    return OverlapIndex(texts, kept, cut_lineage(terms), postings, cut_lineage(blocks))


def overlap_candidates(index: OverlapIndex, k: int) -> DataFrame:
    """(query_id, id): all nodes that may be among the best ``k``, found in the blocks that their bounds leave.

    The first block of every list, its shortest nodes, gives each question a k-th best score to beat. A node
    that shares o of a question's words is in the list of the rarest of them, whose place is at least o; so in the
    list at place i a node scores at most i * damp, and a block whose first row cannot reach the k-th best (or
    ties it behind the k-th id) is never opened. A word that all nodes hold is at place 1: of its list only nodes
    whose damping alone beats the k-th best are read.
    """
    lists = index.terms.join(index.blocks, "word")
    start = index.blocks.groupBy("word").agg((F.min("block") + 1).alias("start"))
    opened = lists.join(start, "word").where(F.col("block") <= F.col("start")).select("query_id", "word", "block")
    tried = cut_lineage(opened.join(index.postings.select("word", "block", "id"), ["word", "block"]).select("query_id", "id").distinct())
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    bar = index.scores(tried).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k).select("query_id", F.col("score").alias("bar"), F.col("id").alias("last"))
    reach = lambda: F.col("bar").isNull() | (F.col("place") * F.col("damp") > F.col("bar")) | (
        (F.col("place") * F.col("damp") == F.col("bar")) & (F.col("id") <= F.col("last")))
    left = lists.join(cut_lineage(bar), "query_id", "left").where(reach()).select("query_id", "word", "block", "place", "bar", "last")
    found = left.join(index.postings, ["word", "block"]).where(reach()).select("query_id", "id")
    return cut_lineage(tried.unionByName(found).distinct())


# Words never taken as entities by the keyword recipes.
KEYWORD_STOP = ("is", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
                "what", "who", "how", "where", "when", "why")


def keyword_entities(text) -> Column:
    """First three capitalised words that are no stop words, else the first three other words."""
    t = F.col(text) if isinstance(text, str) else text
    caps = F.filter(F.regexp_extract_all(t, F.lit(r"\b[A-Z][a-z]*\b"), 0), lambda w: ~F.lower(w).isin(*KEYWORD_STOP))
    rest = F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: ~w.isin(*KEYWORD_STOP))
    return F.slice(F.when(F.size(caps) > 0, caps).otherwise(rest), 1, 3)


def keyword_concepts(queries: DataFrame, concepts: DataFrame, rels: DataFrame, k: int = 3) -> DataFrame:
    """Concepts whose name (first) or description contains an entity, then their related concepts.

    ``concepts``: pos, name, type, description; ``rels``: source, target. Order: entity, name
    matches before description matches, then concept position; related concepts follow. Concepts without a
    position are left out.
    """
    e = queries.select("query_id", F.posexplode(F.transform(keyword_entities("text"), F.lower)).alias("_e", "part"))
    parts = cut_lineage(e.select("part").distinct()).select(F.col("part").alias("key"), "part")
    # each distinct text is searched once, and stands for the first concept of every name that has it
    held = concepts.where("pos IS NOT NULL").select("name", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.lower("name").alias("text")), F.struct(F.lit(1).alias("k"), F.lower("description").alias("text")))).alias("t"))
    held = cut_lineage(held.where("t.text IS NOT NULL").groupBy("t.k", "t.text", "name").agg(F.min("pos").alias("p")))
    found = contained_names(held.select(F.col("text").alias("key"), "text").distinct(), parts).select(F.col("text_key").alias("text"), F.col("part_key").alias("part"))
    named = held.join(found, "text").groupBy("part", "name").agg(F.min(F.struct("k", "p")).alias("o"))
    # the first ``k`` names of a query are among the first ``k`` of each of its entities; where a query has fewer, all its
    # names are kept, and only then do related concepts take a place
    best = W.partitionBy("part").orderBy("o", "name")
    top = cut_lineage(named.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"))
    hits = e.join(top, "part").select("query_id", "name", F.struct(F.lit(0).alias("s"), F.col("_e").alias("e"), F.col("o.k").alias("k"), F.col("o.p").alias("p")).alias("o"))
    first = cut_lineage(hits.groupBy("query_id", "name").agg(F.min("o").alias("o")))
    links = rels.select("source", "target").unionByName(rels.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    known = concepts.groupBy(F.col("name").alias("target")).agg(F.min("pos").alias("pos"))
    # likewise, the first ``k`` related concepts of a source are all that can take a place through it
    near = links.join(known, "target").withColumn("_r", F.row_number().over(W.partitionBy("source").orderBy("pos", "target"))).where(F.col("_r") <= k)
    more = first.withColumnRenamed("name", "source").join(near, "source").select(
        "query_id", F.col("target").alias("name"), F.struct(F.lit(1).alias("s"), F.col("o.e").alias("e"), F.col("o.k").alias("k"), F.col("pos").alias("p")).alias("o"))
    every = first.unionByName(more).groupBy("query_id", "name").agg(F.min("o").alias("o"))
    w = W.partitionBy("query_id").orderBy("o", "name")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "name", F.when(F.col("o.s") == 1, "relation").when(F.col("o.k") == 0, "name").otherwise("description").alias("source"))


def first_words_match(queries: DataFrame, nodes: DataFrame, n_words: int = 3) -> DataFrame:
    """Nodes whose text contains one of the question's first words: (query_id, id)."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.slice(F.split(squeeze(F.lower("text")), " "), 1, n_words))).alias("part")).filter("part <> ''")
    hit = contained_names(nodes.select(F.col("id").alias("key"), F.lower("text").alias("text")), q.select(F.col("part").alias("key"), "part").distinct())
    return q.join(hit.withColumnRenamed("part_key", "part"), "part").select("query_id", F.col("text_key").alias("id")).distinct()


def with_positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    return dense_index(nodes, order, "pos")
