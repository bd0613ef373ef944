"""Stored graphs and residual ranks, gram containment, overlap lists and code search: exactness and the shape of the work."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave import models
from kgweave.operators import concept_graph as CG, graph as G, outputs as O, ranking as R, vectors as V
from kgweave.plans import retrieve as Q


def power(edges, ids, seeds, alpha):
    """Fixed point of the personalised rank by dense algebra."""
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, d in set(edges):
        a[at[d], at[s]] = 1
    out = a.sum(axis=0)
    a = a / np.maximum(out, 1)
    p = np.zeros(len(ids))
    for v, w in seeds.items():
        p[at[v]] += w
    y = np.linalg.solve(np.eye(len(ids)) - alpha * a, p / p.sum())
    return dict(zip(ids, y / y.sum()))


@pytest.fixture(scope="module")
def graph():
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (150, 2))] + [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 30)]
    return edges, list(range(64))


def stored(spark, graph, per_salt=4):
    edges, ids = graph
    return R.store_edges(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in ids], "id long"), per_salt)


def test_converged_rank_is_the_fixed_point(spark, graph):
    g = stored(spark, graph)
    seeds = {"a": {0: 1.0}, "b": {5: 2.0, 61: 1.0}, "c": {7: 0.25, 8: 0.5, 9: 3.0}}
    s = spark.createDataFrame([(q, i, w) for q, d in seeds.items() for i, w in d.items()] + [("none", 999, 1.0), ("zero", 3, 0.0)], "query_id string, id long, weight double")
    got = {(x.query_id, x.id): x.rank for x in R.converged_pagerank(g, s, 0.6, 1e-8).collect()}
    assert {q for q, _ in got} == set(seeds)
    for q, d in seeds.items():
        want = power(*graph, d, 0.6)
        assert all(abs(got.get((q, i), 0.0) - w) < 1e-8 for i, w in want.items())


def test_what_is_missing_stays_within_the_bound(spark, graph):
    g = stored(spark, graph)
    s = spark.createDataFrame([(0, 1.0)], "id long, x double")
    ids = graph[1]
    a = np.zeros((len(ids), len(ids)))
    for x, y in set(graph[0]):
        a[y, x] = 1
    exact = dict(enumerate(np.linalg.solve(np.eye(len(ids)) - 0.7 * a / np.maximum(a.sum(axis=0), 1), np.eye(len(ids))[0])))
    for tol in (1.0, 1e-2):
        rough = {r.id: r.x for r in R.converged_rank(g, s, 0.7, tol, ["x"]).collect()}
        assert sum(abs(x - rough.get(i, 0.0)) for i, x in exact.items()) <= tol


def test_hub_edges_are_spread_over_salts(spark, graph):
    g = stored(spark, graph, 4)
    assert g.edges.groupBy("src", "salt").count().agg(F.max("count")).first()[0] <= 15
    assert g.edges.where("src = 0").select("salt").distinct().count() >= 10
    assert g.edges.count() == len(set(graph[0]))


def nodes_of(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes_of(plan.children().apply(i))


def test_a_round_exchanges_no_edges(spark, graph):
    g = stored(spark, graph)
    state = R.cut_lineage(g.vertices.select("id", "outdeg", "salts", F.lit(1.0).alias("r")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = R._push(state, g.edges, [], ["r"])._jdf.queryExecution().executedPlan()
        join = next(n for n in nodes_of(plan) if "Join" in n.nodeName())
        sides = [[n.nodeName() for n in nodes_of(join.children().apply(i))] for i in range(2)]
        held = [names for names in sides if any("Scan parquet" in n for n in names)]
        assert any("Exchange" not in " ".join(names) for names in held) and sum("Exchange" in " ".join(names) for names in sides) == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_many_queries_run_in_batches(spark, graph, monkeypatch):
    monkeypatch.setattr(R, "MAX_QUERIES", 3)
    s = spark.createDataFrame([(q, q % 60, 1.0) for q in range(10)], "query_id int, id long, weight double")
    got = R.personalized_pagerank(stored(spark, graph), None, s, rounds=2).dense()
    assert got.count() == 640 and got.select("query_id").distinct().count() == 10


def test_converged_facts_equal_dense_algebra(spark):
    r = np.random.default_rng(8)
    words = [f"n{i}" for i in range(20)]
    embed = lambda df, c: df.withColumn("vec", models.hash_embedding(c))
    facts = [(words[int(a)], "r", words[int(b)]) for a, b in r.integers(0, 20, (40, 2))]
    facts = list(dict.fromkeys(facts))
    edges = embed(spark.createDataFrame([(f"{h} {x} {t}", h, t, h, x, t) for h, x, t in facts], "id string, src string, dst string, head string, relation string, tail string"), "id")
    texts = {f"t{i}": " ".join(words[int(j)] for j in r.integers(0, 20, 6)) for i in range(9)}
    links = [(w, t) for t, x in texts.items() for w in set(x.split())]
    passages = embed(spark.createDataFrame(list(texts.items()), "id string, text string"), "text")
    qs = embed(spark.createDataFrame([(1, "n1 n2 r"), (2, "n5"), (3, "n7 n8 n9")], "query_id int, text string"), "text")
    ids = words + list(texts)
    g = G.Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(h, t) for h, _, t in facts] + links, "src string, dst string"))
    seeds = spark.createDataFrame([(1, "n1", 0.7), (1, "n2", 0.2), (2, "n5", 1.0), (2, "t1", 5.0)], "query_id int, id string, score double")
    got = Q.converged_fact_passages(qs, g, edges, passages, models.hash_embedding, 4, Q.InferenceConfig(ppr_tol=1e-6), seeds=seeds)
    tv = {x.id: np.array(x.vec, float) for x in passages.collect()}
    for q, v in {x.query_id: np.array(x.vec, float) for x in qs.collect()}.items():
        s = {t: float(v @ x) for t, x in tv.items()}
        s = {t: (x - min(s.values())) / (max(s.values()) - min(s.values())) for t, x in s.items()}
        own = {r.id: r.score for r in seeds.where(F.col("query_id") == q).collect() if r.id not in texts}
        want = power([(h, t) for h, _, t in facts] + links, ids, {**own, **s}, 0.99) if own else s
        best = sorted((t for t in texts if want[t] > 1e-15 or not own), key=lambda t: (-round(want[t], 10), t))[:4]
        rec = got.where(F.col("query_id") == q).orderBy("rank").collect()
        assert [x.id for x in rec] == best and all(abs(x.score - want[x.id]) < 1e-6 for x in rec)


# ---- containment ------------------------------------------------------------------------------------------

def containment_corpus():
    r = np.random.default_rng(4)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    parts = [f"the {word(6)}" if i % 3 == 0 else word(int(r.integers(1, 9))) for i in range(900)] + ["the ", "é\U0001f600x", "日本語", "a"]
    texts = [" ".join(r.choice(parts, int(r.integers(1, 9)))) for _ in range(500)] + ["", "the the the", None, "xxé\U0001f600xx 日本語"]
    return texts, parts


def test_gram_containment_equals_all_pairs(spark):
    texts, parts = containment_corpus()
    t = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    p = spark.createDataFrame(list(enumerate(parts)), "key int, part string")
    want = {(i, j) for i, x in enumerate(texts) for j, w in enumerate(parts) if x is not None and w in x}
    assert {tuple(x) for x in CG.contained_names(t, p, few=0).collect()} == want


def test_shared_beginnings_make_no_hot_key(spark, monkeypatch):
    monkeypatch.setattr(CG, "PIECES", 100)
    texts, parts = containment_corpus()
    t = spark.createDataFrame([(i, f"the {x}") for i, x in enumerate(texts * 4)], "key int, text string")
    p = spark.createDataFrame([(i, w) for i, w in enumerate(parts) if len(w) > 4], "key int, part string")
    held, keyed = CG.anchored(t, p)
    keys = ["gram", "text_piece", "part_piece"]
    met = held.join(keyed, keys).select("text_key", "part")
    assert keyed.where("gram = 'the '").count() == 0 and met.count() == met.distinct().count()
    for side in (held, keyed):
        tasks = [r[0] for r in side.repartition(8, *keys).groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(tasks) < 2 * np.median(tasks)


def test_a_gram_that_all_share_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(CG, "PIECES", 10)
    t = spark.createDataFrame([(i, f"zzzz{i}") for i in range(300)], "key int, text string")
    p = spark.createDataFrame([(i, "zzzz" + "z" * (i % 2) + str(i)) for i in range(200)], "key int, part string")
    held, keyed = CG.anchored(t, p.union(spark.createDataFrame([(1000, "zzzz")], p.schema)))
    assert held.join(keyed, ["gram", "text_piece", "part_piece"]).groupBy("gram", "text_piece", "part_piece").count().agg(F.max("count")).first()[0] <= 70 * 50
    want = {(i, j) for i in range(300) for j in range(200) if "zzzz" + "z" * (j % 2) + str(j) in f"zzzz{i}"}
    assert {tuple(x) for x in CG.contained_names(t, p, few=0).collect()} == want


# ---- word overlap -------------------------------------------------------------------------------------------

def brute_overlap(questions, texts, k):
    out = []
    for q, x in questions:
        asked = set(x.lower().split())
        s = []
        for i, t in texts:
            words = list(dict.fromkeys((t or "").lower().split()))
            n = len(asked & set(words))
            if n:
                s.append((-(n * (1.0 / (1.0 + len(words) / 10.0))), i))
        out += [(q, i, rank) for rank, (_, i) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


def overlap_corpus(n=1500):
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, "the " + " ".join(r.choice(words, int(r.integers(2, 40)), p=(w := 1 / np.arange(1, 301)) / w.sum()))) for i in range(n)] + [(n, None), (n + 1, "")]
    questions = [(q, "the " + " ".join(r.choice(words, int(r.integers(0, 5))))) for q in range(40)]
    return questions, texts


@pytest.mark.parametrize("block", [8, 1024])
def test_overlap_equals_all_pairs(spark, block):
    questions, texts = overlap_corpus()
    got = Q.word_overlap(spark.createDataFrame(questions, "query_id int, text string"), spark.createDataFrame(texts, "id int, text string"), 3, block)
    assert rows(got, "query_id", "id", "rank") == sorted(brute_overlap(questions, texts, 3), key=str)


def test_a_word_everywhere_is_not_joined_everywhere(spark):
    questions, texts = overlap_corpus()
    q = spark.createDataFrame(questions, "query_id int, text string")
    index = Q.overlap_index(q, spark.createDataFrame(texts, "id int, text string"), 16)
    assert index.postings.where("word = 'the'").count() == 1500
    assert Q.overlap_candidates(index, 3).count() < 0.2 * len(questions) * len(texts)


# ---- code search --------------------------------------------------------------------------------------------

def vectors(spark, n=3000, dims=16, seed=1):
    r = np.random.default_rng(seed)
    m = (r.normal(size=(12, dims)) * 2)[r.integers(0, 12, n)] + r.normal(size=(n, dims))
    m[: n // 3] = m[0] + 0.01 * r.normal(size=(n // 3, dims))  # a third of all rows in one cell
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<float>")


def test_code_search_recall_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 200)
    v = vectors(spark)
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = V.build_code_index(v, cells=12, subspaces=8)
    assert index.rows.count() == 3000 and index.rows.groupBy("cell", "piece").count().agg(F.max("count")).first()[0] <= 300
    found = V.recall(V.code_search(index, q, 10, probes=6), V.topk(q, v, 10)).agg((F.sum("hits") / F.sum("wanted")).alias("r"), F.count("*")).first()
    assert found[1] == 150 and found[0] >= 0.9
    every = V.code_search(index, q, 10, probes=12, refine=300)
    assert rows(every, "query_id", "id", "rank") == rows(V.topk(q, v, 10), "query_id", "id", "rank")


def test_code_index_of_odd_vectors(spark):
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [float("nan"), 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [0.0, 1.0, float("inf")]), (6, [1.0]), (7, []), (8, [0.0, 0.0, 1.0]),
                                 (9, [0.0, 0.0, 1.0])], "id int, vec array<double>")
    index = V.build_code_index(odd, cells=4, subspaces=8)
    q = spark.createDataFrame([("x", [0.0, 0.0, 1.0])], "query_id string, vec array<double>")
    assert rows(V.code_search(index, q, 5, probes=4), "rank", "id", "score") == [(1, 1, 3.0), (2, 9, 1.0), (3, 8, 1.0)]
    with pytest.raises(ValueError):
        V.build_code_index(odd.where("id = 2"))


# ---- long answers -------------------------------------------------------------------------------------------

def test_long_answers_and_names(spark):
    long = "x\\\"y" * 250_000
    df = spark.createDataFrame([(f'{{"keywords": ["a", "b"], "fact": [["h", "r", "{long}"]]}}', " ".join(["Ann"] * 5000) + " McX met Bob")], "a string, t string")
    got = O.first_triplets(O.keywords(df, "a", "k"), "a", "f").select("k", "f", models.capital_entities("t").alias("e")).first()
    assert got.k == ["a", "b"] and len(got.f[0][2]) == 750_000 and got.e[1] == "Bob" and got.e[0].count("Ann") == 5000


def test_keyword_concepts_search_each_text_once(spark, monkeypatch):
    """A thousand concepts share twelve names: each text is searched once and each entity hands on its first names only."""
    names = [f"{a} {b}" for a in ("big", "red", "old") for b in ("bolt", "gear", "bigring", "pin")] + ["lone", "kin 1", "kin 2"]
    concepts = [(i, names[i % 12], f"kind {i % 7}") for i in range(1000)] + [(1001, "lone", None), (1000, "kin 2", "x"), (1002, "kin 1", "x"), (1003, "kin 1", "x"), (1004, None, "Kind 3")]
    rels = [("lone", "kin 1"), ("kin 2", "lone"), ("red bolt", "lone"), ("lone", "lone")]
    questions = [(0, "Big Red"), (1, "Lone"), (2, "Kind"), (3, "Pin Lone"), (4, "Zzz")]
    calls = []

    def counted(texts, parts, *a, _run=Q.contained_names, **k):
        calls.append(texts.count())
        return _run(texts, parts, *a, **k)
    monkeypatch.setattr(Q, "contained_names", counted)
    got = Q.keyword_concepts(spark.createDataFrame(questions, "query_id int, text string"),
                             spark.createDataFrame([(i, n, "t", d) for i, n, d in concepts], "pos int, name string, type string, description string"),
                             spark.createDataFrame(rels, "source string, target string"), 3)
    first_pos = {}
    for i, n, _ in concepts:
        first_pos[n] = min(i, first_pos.get(n, i))
    want = []
    for q, text in questions:
        o = {}
        for e, w in enumerate(text.lower().split()):
            for i, n, d in concepts:
                for c in [(0, e, 0, i)] * (w in (n or "").lower()) + [(0, e, 1, i)] * (w in (d or "").lower()):
                    o[n] = min(c, o.get(n, c))
        found = dict(o)
        for s, t in rels + [(t, s) for s, t in rels]:
            if s in found:
                c = (1, *found[s][1:3], first_pos[t])
                o[t] = min(c, o.get(t, c))
        for r, (c, n) in enumerate(sorted((c, n or "") for n, c in o.items())[:3], 1):
            want.append((q, r, n, "relation" if c[0] else "description" if c[2] else "name"))
    assert rows(got.select("query_id", "rank", F.coalesce("name", F.lit("")), "source")) == sorted(want, key=str)
    assert sum(calls) < 30  # distinct names and descriptions
