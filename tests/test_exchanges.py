"""How often, and how large, the graph queries exchange rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.operators import concepts as C, graph as G, ranking as R


@pytest.fixture
def unsent(spark):
    """No table is small enough to be sent whole, as at size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def components_of(pairs, ids):
    root = {i: i for i in ids}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_tasks_join_their_own_edges_first(spark):
    """A task hands on one row per vertex of a piece, and pieces of any size give the same components."""
    draw = random.Random(3)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(500)]
    e = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    v = spark.createDataFrame([(i,) for i in [*range(400), *range(1000, 1501)]], "id long")
    want = components_of(pairs, [*range(400), *range(1000, 1501)])
    assert {r["id"]: r["component"] for r in R.connected_components(e, v).collect()} == want
    for piece in (1, 7, 10_000):
        rows = R._contracted(e, piece).collect()
        near = components_of([(r["id"], r["root"]) for r in rows], list(want))
        assert near == want
    whole = R._contracted(e.coalesce(1), 10_000)
    assert whole.count() == len({i for p in pairs for i in p})
    # a chain in one task is one component at once: no round runs over its edges
    assert whole.where("id >= 1000").select("root").distinct().count() == 1


def test_local_roots_follow_long_chains():
    at = np.random.default_rng(1).permutation(20_000)
    root = R.local_roots(at[:-1], at[1:], 20_000)
    assert (root == 0).all()
    assert R.local_roots(np.array([3, 1]), np.array([4, 0]), 5).tolist() == [0, 0, 2, 3, 3]


def test_name_context_exchanges_names_once(unsent):
    n = unsent.createDataFrame([("a",), ("b",), ("z",)], "name string")
    e = unsent.createDataFrame([("a", "b", "r"), ("b", "c", "s"), ("a", "b", "r")], "start_id string, end_id string, relation string")
    got = C.name_context(n, e)
    assert exchanges(got) <= 2
    assert {r["name"]: r["context"] for r in got.collect()} == {"a": "r b", "b": "a r, s c", "z": ""}


def test_edge_concepts_meet_in_one_exchange(unsent):
    e = unsent.createDataFrame([("a", "b", ["x"], 2), ("a", "b", ["z", "x"], 1), ("a", "b", ["x"], 3), ("c", "d", ["y"], 4)],
                               "src string, dst string, concepts array<string>, ord int")
    got = G.edge_concepts(e)
    assert exchanges(got) == 1
    assert sorted(map(tuple, got.collect())) == [("a", "b", "z,x"), ("c", "d", "y")]


def test_concept_edges_meet_by_name_once(unsent):
    """One exchange for the answers and one for the nodes; repeated names and concepts are one edge."""
    rows = C.concept_rows(unsent.createDataFrame([("a", "x, y", "entity"), ("a", "y", "entity"), ("a", "q", "relation"), ("c", "w", "event")],
                                                 "node string, conceptualized_node string, node_type string"))
    n = unsent.createDataFrame([("a", ["y", "v"]), ("a", None), ("b", ["u"]), ("d", None)], "name string, concepts array<string>")
    got = C.concept_edges(n, rows)
    assert exchanges(got) == 2
    assert sorted((r["start_id"], r["concept"]) for r in got.collect()) == [("a", "v"), ("a", "x"), ("a", "y"), ("b", "u")]


DOCS = [(1, "One two three. Four five six."), (2, "One two three."), (3, None)]


def stored(spark, tmp_path, monkeypatch, module, run):
    """Columns of the tables that a query stores, in order, and its result."""
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "What is One")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, keep = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(df.columns), keep(df))[1])
    return run(spark, str(tmp_path)).collect(), seen


def test_json_graph_extracts_once(spark, tmp_path, monkeypatch):
    from kgweave.catalog import graphs
    got, seen = stored(spark, tmp_path, monkeypatch, graphs, graphs.json_graph)
    assert [("head" in c, "tail" in c) for c in seen] == [(True, True)]
    # pairs: each sentence's words, each sentence with both its words, and one pair of neighbours
    assert {r["part"]: r["n"] for r in got}["relations"] == 7


def test_edge_retriever_stores_no_vectors(spark, tmp_path, monkeypatch):
    from kgweave.catalog import retrieval
    got, seen = stored(spark, tmp_path, monkeypatch, retrieval, retrieval.edge_retriever)
    assert seen == [["head", "relation", "tail"]]
    assert [r["rank"] for r in got] and got[0]["text"].count("  ") == 2


def test_whole_graph_stores_first_mentions(spark, tmp_path, monkeypatch):
    from kgweave.catalog import graphs
    got, seen = stored(spark, tmp_path, monkeypatch, graphs, graphs.full_graph)
    assert len(seen) == 3 and {"name", "type", "text_id", "ord"} == set(seen[1])
    assert {r["part"]: r["n"] for r in got}["triple"] == 7
