"""The corpus pipeline against a brute-force version of each stage on its own input."""
import collections
import re

import corpus_pipeline
from kgweave.llm import mixing, packing, quality_rules

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, FOLDER)
        if name != "packed":
            assert out.columns == corpus_pipeline.DOCUMENT
            rows = out.collect()
            at = spark.createDataFrame(rows, out.schema)
            kept.append({r.doc_id: r.text for r in rows})
        else:
            last = {(r.doc_id, r.piece): r.length for r in out.collect()}
    good, exact, near, mixed = kept
    scores = {r.doc_id: r.predicted for r in quality_rules.quality_scores(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert set(good) == {i for i, p in scores.items() if p}
    assert all(i in good for i, q in labels.items() if q == 1)
    largest = {}
    for i, t in good.items():
        largest[t] = max(i, largest.get(t, i))
    assert set(exact) == set(largest.values())
    sets = {}
    for i, t in exact.items():
        w = SPACE.findall(t.lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(near) == {i for i in sets if find(i) == i}
    slots = mixing.mix(spark.createDataFrame(list(near.items()), "doc_id long, text string").join(docs.select("doc_id", "source"), "doc_id")).collect()
    assert set(mixed) == {r.doc_id for r in slots if r.kept} and mixed
    encode = packing.Encoder(packing.default_tokenizer())
    lengths = collections.Counter()
    for (i, _), n in last.items():
        lengths[i] += n
    assert lengths == {i: len(encode(t or "")) + 1 for i, t in mixed.items()}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(last)


def test_mixture_keeps_and_orders_documents(spark):
    rows = [(i, f"{i} " + "x" * 40_000, "en", "hot" if i % 3 else f"s{i % 4}", 0) for i in range(60)] + [(100, "tiny", "en", "one", 4), (101, None, "en", None, 0), (None, "no id", "en", "hot", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, FOLDER).collect()]
    assert sorted(map(str, out)) == sorted(str(r[0]) for r in rows)
    slots = {r.doc_id: r.slot for r in mixing.mix(docs).collect()}
    assert [slots[i] for i in out] == sorted(slots.values())
    cut = mixing.mix(docs, {"hot": 1, "s0": 1}, size=10).collect()
    assert {r.doc_id for r in cut if r.kept} == {r.doc_id for r in cut if r.slot is not None and r.slot < 10} and 0 < sum(r.kept for r in cut) < len(cut)


def test_the_order_of_the_mixture_reaches_the_sequences(spark, tmp_path):
    rows = [(i, f"a short text {i % 7}", "en", "s", 10) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = {}
    for name, order in (("up", "doc_id"), ("down", "-doc_id")):
        docs.orderBy(*[corpus_pipeline.F.expr(order)]).write.parquet(f"{tmp_path}/{name}")
        stored = spark.read.parquet(f"{tmp_path}/{name}")
        assert [r.doc_id for r in corpus_pipeline.in_stored_order(stored).orderBy("place").collect()] == sorted(range(600), reverse=name == "down")
        out = corpus_pipeline.packed(spark, stored, FOLDER).collect()
        spans = sorted((r.sequence_id, r.offset, r.length) for r in out)
        assert len(out) == 600 and all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spans, spans[1:]))
        at[name] = {r.doc_id: r.sequence_id for r in out}
    n = max(at["up"].values())
    assert n == max(at["down"].values()) > 0
    assert (at["up"][0], at["up"][599]) == (0, n) and (at["down"][599], at["down"][0]) == (0, n)
