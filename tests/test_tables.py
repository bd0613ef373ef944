import gzip
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave import models
from kgweave.operators import concepts as C, extraction as X, graph as G, shaping as S
from kgweave.plans import build as B
from kgweave.session import dense_index, running_total
from kgweave.sources import readers as R, writers as K
from kgweave import schema as SC


def test_positions_are_dense_and_partition_independent(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = dense_index(df, ["k"]).filter("k <> pos").count()
        total = running_total(df, ["k"], "v", "t").filter("t <> 2 * k").count()
        assert (got, total) == (0, 0)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fixed_chunks(spark):
    w = S.chunk_width()
    assert w == 2884
    texts = {0: "", 1: "x" * w, 2: "y" * (w + 1), 3: "\U0001F600" * (2 * w + 3)}
    d = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in S.chunk_documents(d).orderBy("id", "chunk_id").collect():
        got.setdefault(r.id, []).append(r.text)
    assert {k: "".join(v) for k, v in got.items()} == {k: v for k, v in texts.items() if v}
    assert [len(x) for x in got[2]] == [w, 1]


def test_sentence_chunks(spark):
    t = ("word " * 30 + "end. ") * 20
    parts = S.sentence_spans(t, 200, 20)
    assert all(len(p) <= 200 for p in parts) and parts[0].endswith(".")
    assert S.sentence_spans("short", 200, 20) == ["short"]
    assert S.sentence_spans("a" * 12, 10, 3) == ["a" * 10, "a" * 5]
    d = spark.createDataFrame([("d", t)], "id string, text string")
    got = S.sentence_chunks(d, size=200, overlap=20).orderBy("chunk_id").collect()
    assert [r.text for r in got] == parts and got[0].total_chunks == len(parts) and got[0].original_length == len(t)


def test_shards_and_batches(spark):
    d = spark.range(23).withColumnRenamed("id", "k")
    sizes = [r[1] for r in S.balanced_shards(d, ["k"], 5).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [5, 5, 5, 4, 4]
    h = S.hashed_shards(d, ["k"], 5)
    assert h.count() == 23 and h.select("k").distinct().count() == 23 and h.groupBy("shard").count().agg(F.max("count")).first()[0] == 5
    b = S.batches(d, ["k"], 10, resume_from=1)
    assert rows(b.groupBy("batch").count()) == [(1, 10), (2, 3)]


RECORDS = [
    ("b.json", 0, "1", "pre Here is the passage.abc<|eot_id|>x",
     '[{"Head":"A","Relation":"r","Tail":1},{"Head":" A;b\\n","Relation":"r1","Tail":"C"},"x",{"Head":"q"},null,{"Head":"A","Relation":" ","Tail":"C"}]',
     '[{"Event":"E one","Entity":["C",2," ","Z"]},{"Event":1,"Entity":["a"]},{"Event":"e","Entity":"a"}]', "{bad"),
    ("a.json", 1, "2", "abc", '[{"Head":"C","Relation":"r2","Tail":"A,b"},{"Head":"C","Relation":"r3","Tail":"C"}]', "[]",
     '[{"Head":"C","Relation":"before","Tail":"E one"},{"Head":"C","Relation":"before","Tail":"E one"}]'),
]


@pytest.fixture(scope="module")
def flat(spark):
    return X.flatten(spark.createDataFrame(RECORDS, SC.RECORD))


def test_flatten_gates_types_and_first_mentions(flat):
    assert rows(flat.triples, "kind", "head", "relation", "tail") == sorted([
        (0, "A,b", "r1", "C"), (2, "E one", "is participated by", "C"), (2, "E one", "is participated by", "Z"),
        (0, "C", "r2", "A,b"), (0, "C", "r3", "C"), (1, "C", "before", "E one"), (1, "C", "before", "E one")], key=str)
    # file a.json sorts first: C is first an entity there, E one first an event
    assert rows(flat.nodes, "name", "type") == sorted([("A,b", "entity"), ("C", "entity"), ("E one", "event"), ("Z", "entity")], key=str)
    assert flat.text_nodes.count() == 1  # both records reduce to the passage "abc"
    assert flat.edges.count() == 7       # a multiset
    assert rows(flat.missing_concepts.groupBy("Type").count()) == [("Entity", 3), ("Event", 1), ("Relation", 5)]


def test_type_gate(spark):
    d = spark.createDataFrame([('{"k": 1}',), ('{"k": "1"}',), ("{",), ('{"j": 1}',)], "p string")
    assert X.type_gate(d, "p", "$.k", "STRING").count() == 1 and X.type_gate(d, "p", "$.k", "BIGINT").count() == 1


def test_graph_assembly(spark, flat):
    answered = spark.createDataFrame([("C", "letter, thing", "entity"), ("C", "thing,, shape", "entity"), ("r2", "rel", "relation")], SC.CONCEPTUALIZED)
    crows = C.concept_rows(answered)
    ce = C.concept_edges(flat.nodes, crows)
    cn = C.concept_nodes(ce)
    assert rows(ce, "start_id", "concept") == [("C", "letter"), ("C", "shape"), ("C", "thing")]
    g = G.full_graph(flat, cn, ce, C.edges_with_concepts(flat.edges, crows))
    kinds = dict(rows(g.vertices.groupBy("type").count()))
    assert kinds == {"entity": 3, "event": 1, "passage": 1, "concept": 3}
    named = G.named_edges(g)
    assert rows(named.filter("relation = 'r2'"), "src_name", "dst_name", "concepts") == [("C", "A,b", "rel")]
    assert named.filter("relation = 'mention in'").count() == 4 and named.filter("type = 'Concept'").count() == 3
    # every vertex with a file refers to the passage of its first mention
    assert g.vertices.filter("type = 'entity'").select("file_id").distinct().count() == 1
    sub = G.node_subset(g, True, False)
    e = G.induced_edges(g.edges, sub)
    assert e.filter("relation = 'mention in'").count() == 0
    with pytest.raises(ValueError):
        G.node_subset(g, False, True)
    d = dict(rows(G.degrees(g.vertices, g.edges).join(g.vertices, "id"), "name", "degree"))
    assert d["Z"] == 2  # one participation, one mention


def test_edge_concepts_keep_first_seen_order(spark):
    e = spark.createDataFrame([("a", "b", 2, ["y", "x"]), ("a", "b", 1, ["z"]), ("a", "b", 3, ["x", "w"]), ("b", "a", 1, [])],
                              "src string, dst string, ord int, concepts array<string>")
    assert rows(G.edge_concepts(e)) == [("a", "b", "z,y,x,w")]


def test_json_graph_last_write_wins(spark, flat):
    t = flat.triples.withColumn("passage", F.lit("abc")).withColumn("file_id", F.col("file_name"))
    g, files, edge_files = G.json_graph(t, spark.createDataFrame([("abc",), (" ",)], "text string"))
    names = dict(rows(g.vertices, "name", "type"))
    assert names["C"] == "entity" and names["abc"] == "passage"
    assert g.edges.filter("relation = 'mention in'").count() == 3  # A,b C E one; Z only participates
    assert files.count() == 6 and edge_files.count() >= 5


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x1.json").write_text(json.dumps([{"id": 1, "text": "a\nb", "metadata": {"lang": "en"}}, {"id": "s", "text": "c"}]))
    with gzip.open(tmp_path / "in" / "x2.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": 3, "text": "d", "metadata": {"lang": "zh-CN"}}) + "\n")
    (tmp_path / "in" / "other.json").write_text("[]")
    d = R.read_documents(spark, str(tmp_path / "in"), "x")
    assert rows(d, "id", "text") == [("1", "a\nb"), ("3", "d"), ("s", "c")]
    assert B.chunks(d).count() == 3
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "A.MD").write_text("# t\nbody")
    assert rows(R.read_markdown(spark, str(tmp_path / "md")), "id", "text", "file_name") == [("1", "# t\nbody", "A.MD")]
    (tmp_path / "t.tsv").write_text("a_b\tr\tc\n")
    assert rows(R.read_triples_tsv(spark, str(tmp_path / "t.tsv"), True)) == [("a b", "r", "c")]
    (tmp_path / "rec").mkdir()
    lines = [{"id": 7, "original_text": "t", "entity_relation_dict": [{"Head": "h", "Relation": "r", "Tail": 5}, {"Head": "h", "Relation": "r", "Tail": "t"}],
              "event_entity_relation_dict": [], "event_relation_dict": []}] * 2
    (tmp_path / "rec" / "k_2.json").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "rec" / "k_1.json").write_text(json.dumps(lines[0]))
    r = R.read_records(spark, str(tmp_path / "rec"), "k_")
    assert rows(r, "file_name", "line_no", "id") == [("k_1.json", 0, "7"), ("k_2.json", 1, "7"), ("k_2.json", 2, "7")]
    assert X.flatten(r).triples.count() == 3
    assert R.read_records(spark, str(tmp_path / "rec"), "k_", first_files=1).count() == 1
    q = [{"_id": "1", "question": "q", "answer": "a", "supporting_facts": [["T", 0], ["T", 1], ["U", 0]], "context": [["T", ["s1", "s2"]]]}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    assert rows(R.read_questions(spark, str(tmp_path / "q.json")), "pos", "question", "gold") == [(0, "q", ["T", "U"])]
    assert rows(R.read_question_contexts(spark, str(tmp_path / "q.json")), "doc_no", "title", "text") == [(0, "T", "s1 s2")]
    felm = {"index": "1", "prompt": "p", "response": "r", "segmented_response": ["s", "u"], "labels": [True, False], "domain": "math"}
    (tmp_path / "f.jsonl").write_text(json.dumps(felm))
    assert rows(R.read_factuality(spark, str(tmp_path / "f.jsonl")), "segment_no", "segment", "label") == [(0, "s", 1), (1, "u", 0)]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"text":"one"}\n{"text":"two"}\n')
    assert rows(R.read_archives(spark, str(tmp_path), ".jsonl.gz"), "offset", "text") == [(0, "one"), (1, "two")]


def test_written_tables_round_trip(spark, flat, tmp_path):
    K.write_graph_tables(flat, str(tmp_path / "csv"))
    t = R.read_graph_tables(spark, str(tmp_path / "csv"))
    for name in ("nodes", "edges", "text_nodes", "text_edges", "missing_concepts"):
        want = getattr(flat, name)
        cols = [c for c in t[name].columns if c in want.columns]
        assert rows(t[name], *cols) == rows(want, *cols), name
    n = B.numeric_tables(flat)["nodes"]
    assert sorted(r.numeric_id for r in n.collect()) == list(range(4))
    K.write_numeric_ids(n, str(tmp_path / "num"), SC.NODE_HEADER)
    assert R.read_table(spark, str(tmp_path / "num")).columns == ["name:ID", "type", "concepts", "synsets", "numeric_id", ":LABEL"]


def test_graphml_round_trip(spark, tmp_path):
    import xml.etree.ElementTree as ET
    v = spark.createDataFrame([("1", 'a<"&>', "entity"), ("2", "b", None)], "id string, name string, type string")
    e = spark.createDataFrame([("1", "2", "r&s", ["x"])], "src string, dst string, relation string, concepts array<string>")
    K.write_graphml(v, e, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text)
    assert len(root.findall(".//{*}node")) == 2 and len(root.findall(".//{*}edge")) == 1
    K.write_graphml(v, e, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    v2, e2 = R.read_graphml(spark, str(tmp_path / "one"))
    assert rows(v2.select("node", "id")) == [("1", 'a<"&>'), ("2", "b")]
    assert rows(e2.select("src", "dst", "relation")) == [("1", "2", "r&s")]


def test_vector_files(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.5])], "id string, vec array<float>")
    K.write_embeddings_csv(v, str(tmp_path / "e"))
    assert rows(R.read_embeddings_csv(spark, str(tmp_path / "e"), "id")) == [("a", [1.0, 2.5])]
    K.write_vectors(v, str(tmp_path / "p"))
    K.write_vectors(v.unionByName(v), str(tmp_path / "p"))  # kept as it was
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_build_graph_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann met Bob. Bob left the town."), (2, "Ann met Bob. Cy saw Ann.")], "doc_id int, text string")
    g = B.build_graph(spark, models.rule_extraction(docs), str(tmp_path))
    assert g.vertices.filter("type = 'passage'").count() == 2
    assert G.named_edges(g).filter("relation = 'met'").count() == 1
    assert spark.read.text(str(tmp_path / "run_log")).count() == 1

    class Enc:
        dim = 2

        def encode(self, texts):
            import numpy as np
            return np.array([[len(t), 1.0] for t in texts])
    emb = B.embed_graph(g, Enc)
    assert emb["nodes"].count() == g.vertices.filter("type <> 'passage'").count()
    assert emb["passages"].count() == 2


def test_arrays_of_strings_are_read_at_once_and_others_value_by_value(spark):
    from kgweave.functions.text import nothing_to_clean

    texts = ['["a b"]', '["a　b"]', '["é b"]', '["a  b"]', '["a;b"]', '["a\\tb"]']
    d = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    assert [r.t for r in d.orderBy("i").select(nothing_to_clean("j").alias("t")).collect()] == [True, False, True, False, False, False]
    facts = ['[{"Head":"a ","Relation":"r","Tail":"b"}]', '[{"Head":"a","Relation":"r","Tail":7},{"Head":"c;d","Relation":"r","Tail":"e\\u0007f"}]', "[null]", "[1]", "no"]
    events = ['[{"Event":"x y","Entity":["p"," ","q"]}]', '[{"Event":"x","Entity":["p",1,null,"q"]},{"Event":"z","Entity":"p"}]', "[]", '[{"Event":"x"}]', None]
    r = spark.createDataFrame([("f", i, "t", facts[i], "[]", events[i]) for i in range(5)],
                              "file_name string, line_no long, original_text string, entity_relation_dict string, event_relation_dict string, event_entity_relation_dict string")
    t = X.all_triples(r)
    got = sorted((x.line_no, x.kind, x.item, x.member, x.head, x.tail) for x in t.collect())
    assert got == [(0, 0, 0, 0, "a", "b"), (0, 2, 0, 0, "x y", "p"), (0, 2, 0, 2, "x y", "q"),
                   (1, 0, 1, 0, "c,d", "e f"), (1, 2, 0, 0, "x", "p"), (1, 2, 0, 3, "x", "q")]
