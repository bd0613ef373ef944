import itertools
import math
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave import models
from kgweave.functions import registry
from kgweave.functions.text import tokens
from kgweave.operators import contamination as D, metrics as M, outputs as O, quality as Q
from kgweave.plans import answer as A, evaluate as E


def test_group_means_and_errors(spark):
    d = spark.createDataFrame([("a", .3, .01, 20), ("b", .2, .02, 40), ("c", .4, .03, 100)], "task string, value double, stderr double, size long")
    r = d.agg(M.size_weighted_mean("value", "size", False).alias("u"), M.size_weighted_mean("value", "size").alias("w"), M.pooled_stderr("stderr", "size").alias("p")).first()
    assert abs(r.u - .3) < 1e-12 and abs(r.w - .3375) < 1e-12
    n, se = [20, 40, 100], [.01, .02, .03]
    assert abs(r.p - math.sqrt(sum((k - 1) * s * s * k for k, s in zip(n, se)) / (sum(n) - 3) / sum(n))) < 1e-15
    m = spark.createDataFrame([("top", "g"), ("g", "a"), ("g", "b"), ("top", "c")], "grp string, member string")
    up = M.roll_up(d.withColumn("metric", F.lit("acc")), M.group_closure(m))
    assert [(g, round(v, 6), s) for g, v, s in rows(up, "grp", "value", "size")] == [("g", round((.3 * 20 + .2 * 40) / 60, 6), 60), ("top", .3375, 160)]
    holes = M.roll_up(d.withColumn("metric", F.lit("acc")).withColumn("stderr", F.when(F.col("task") != "a", F.col("stderr"))), M.group_closure(m))
    assert holes.filter("stderr IS NULL").count() == 2


def test_pooled_error_is_near_the_direct_one(spark):
    rng = np.random.default_rng(0)
    rows_ = [("x", float(v)) for v in rng.integers(0, 2, 4000)] + [("y", float(v)) for v in rng.random(3000) < .3]
    d = spark.createDataFrame(rows_, "t string, v double")
    per = d.groupBy("t").agg(M.mean_stderr("v").alias("stderr"), F.count("*").alias("size"))
    pooled = per.agg(M.pooled_stderr("stderr", "size")).first()[0]
    assert abs(pooled - d.agg(M.mean_stderr("v")).first()[0]) < 1e-3


def test_combined_error(spark):
    items = [(.1, 10., .5), (.2, 20., .7), (.05, 5., .1)]
    var, size, score = items[0][0] ** 2, items[0][1], items[0][2]
    for se, n, s in items[1:]:
        score = (score * size + s * n) / (size + n)
        var = ((size - 1) * var + (n - 1) * se ** 2) / (size + n - 1) + size * n / ((size + n) * (size + n - 1)) * (score - s) ** 2
    d = spark.createDataFrame([(items,)], "a array<struct<stderr:double,size:double,score:double>>")
    assert abs(d.select(M.combined_stderr("a")).first()[0] - math.sqrt(var)) < 1e-12


def test_classification_scores(spark):
    rng = np.random.default_rng(2)
    g, p = rng.integers(0, 3, 400), rng.integers(0, 3, 400)
    p[:200] = g[:200]
    d = spark.createDataFrame([("t", int(a), int(b)) for a, b in zip(g, p)], "t string, g int, p int")
    c = np.zeros((3, 3))
    for a, b in zip(g, p):
        c[a, b] += 1
    s, t, k = c.sum(), np.trace(c), (c.sum(0) * c.sum(1)).sum()
    mcc = (t * s - k) / math.sqrt((s * s - (c.sum(0) ** 2).sum()) * (s * s - (c.sum(1) ** 2).sum()))
    f1 = [2 * c[i, i] / (c[i].sum() + c[:, i].sum()) for i in range(3)]
    assert abs(M.matthews(d, ["t"], "g", "p").first().mcc - mcc) < 1e-12
    assert abs(M.weighted_f1(d, ["t"], "g", "p").first().weighted_f1 - sum(f * c[i].sum() for i, f in enumerate(f1)) / s) < 1e-12
    b = d.filter("g < 2 AND p < 2")
    assert abs(b.agg(M.binary_mcc("g", "p")).first()[0] - M.matthews(b, ["t"], "g", "p").first().mcc) < 1e-9
    assert d.filter("g > 5").agg(M.binary_f1("g", "p")).first()[0] == 0.0


def test_positional_median_and_bootstrap(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([9, 1, 5, 3, 7])], "i int, v double")
    assert M.positional_median(d, "v", ["i"]).first()[0] == 5.0
    x = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("v"))
    se = M.bootstrap_stderr(x, "id", "v", 300).first()[0]
    assert abs(se - .5 / math.sqrt(2000)) < .0012
    assert M.bootstrap_stderr(x.repartition(3), "id", "v", 300).first()[0] == pytest.approx(se, abs=1e-12)
    assert M.bootstrap_iterations("ter") == 100 and M.bootstrap_iterations("median") == 100_000


def test_filters_registry_and_z(spark):
    d = spark.createDataFrame([(["b", "a", "a", "b", " C"],)], "r array<string>")
    one = lambda c: d.select(c.alias("x")).first()[0]
    assert one(M.majority_vote("r")) == "b" and one(M.take_first("r")) == "b" and one(M.take_first_k("r", 2)) == ["b", "a"]
    assert one(M.lstrip("r"))[-1] == "C" and one(M.uppercase("r"))[0] == "B" and one(M.mapped("r", {"a": "1"}, "?"))[:2] == ["?", "1"]
    assert one(M.regex_filter("r", "[ac]"))[:2] == ["[invalid]", "a"]
    with pytest.raises(ValueError):
        registry.metric("acc")(lambda: None)
    z = d.select(M.z_test(F.lit(.5), F.lit(.4), F.lit(.03), F.lit(.04)).alias("z")).select("z", M.two_sided_p("z").alias("p")).first()
    assert abs(z.z - 2) < 1e-9 and abs(z.p - math.erfc(2 / math.sqrt(2))) < 2e-7


def test_few_shot_never_uses_the_document(spark):
    d = spark.range(50).select(F.col("id").alias("k"))
    for mode in ("random", "first_n"):
        s = M.few_shot(d, d, "k", 4, mode)
        assert s.filter("doc = example").count() == 0 and s.groupBy("doc").count().filter("count <> 4").count() == 0
        assert s.select("doc", "example").distinct().count() == 200


def py_bleu(pairs):
    hit, tot, pl, rl = [0] * 4, [0] * 4, 0, 0
    for p, r in pairs:
        p, r = p.split(), r.split()
        pl, rl = pl + len(p), rl + len(r)
        for n in range(1, 5):
            gr = lambda t: [tuple(t[i:i + n]) for i in range(len(t) - n + 1)]
            for g in set(gr(p)):
                hit[n - 1] += min(gr(p).count(g), gr(r).count(g))
            tot[n - 1] += len(gr(p))
    bp = 1 if pl >= rl else math.exp(1 - rl / pl)
    return 0.0 if 0 in hit else 100 * bp * math.exp(sum(math.log(h / t) for h, t in zip(hit, tot)) / 4)


def test_bleu_and_chrf(spark):
    pairs = [("the cat sat on the mat today", "the cat sat on the red mat"), ("a b c d e", "a b c d f g h")]
    d = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "k int, p string, r string")
    assert abs(M.corpus_bleu(d, "p", "r", "k").first()[0] - py_bleu(pairs)) < 1e-9
    assert M.corpus_chrf(d.withColumn("r", F.col("p")), "p", "r", "k").first()[0] == pytest.approx(100.0)
    assert 0 < M.corpus_chrf(d, "p", "r", "k").first()[0] < 100
    assert M.shift_edits("b c a".split(), "a b c".split()) == 1 and M.shift_edits("a x c".split(), "a b c".split()) == 1
    assert M.corpus_ter(spark.createDataFrame([("b c a", "a b c"), ("a b", "a b c")], "p string, r string"), "p", "r").first()[0] == pytest.approx(100 * 2 / 6)


def test_answers_and_confusion(spark):
    d = spark.createDataFrame([("Answer: The Cat", "the cat"), ("", ""), ("x y", "y z")], "p string, r string")
    assert [(a, round(b, 6)) for a, b in rows(Q.judge(d, "p", "r"), "em", "f1")] == [(0, 0.0), (0, 0.5), (1, 1.0)]
    r = spark.createDataFrame([(["abc", "def", "x"], ["b", "x"]), (["a"], [])], "t array<string>, g array<string>")
    assert rows(Q.with_recall(r, "t", "g"), "recall_at_2", "recall_at_5") == [(0.0, 0.0), (0.5, 1.0)]
    gold = spark.createDataFrame([(1, "b"), (1, "x"), (2, "q")], "k int, gold string")
    got = spark.createDataFrame([(1, 1, "abc"), (1, 2, "def"), (1, 3, "x"), (2, 1, "z")], "k int, rank int, text string")
    assert rows(Q.recall_long(gold, got, "k")) == [(1, 0.5, 1.0), (2, 0.0, 0.0)]
    s = spark.createDataFrame([("m", 1, 1), ("m", 0, 0), ("m", 0, 1), ("n", 1, 1)], "domain string, label int, pred int")
    c = {x.domain: x for x in Q.confusion_scores(s).collect()}
    assert (c["m"].tp, c["m"].tn, c["m"].fp, c["m"].fn, c["m"].balanced) == (1, 1, 1, 0, 0.75) and c["n"].tnr is None and c["ALL"].tp == 2
    n = spark.createDataFrame([(10, 1, 3), (0, 0, 1), (2, 2, 0)], "n int, n_incorrect int, n_more int")
    assert rows(Q.count_scores(n), "precision", "recall", "f1") == sorted([(0.9, 0.75, 0.8182), (None, None, None), (None, None, None)], key=str)
    v = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "b", 3), (1, "a", 4), (2, "z", 1)], "k int, v string, o int")
    assert rows(M.vote_long(v, ["k"], "v", "o")) == [(1, "b", 2), (2, "z", 1)]
    sc = spark.createDataFrame([(1, "r1", "em", 1.0), (2, "r1", "em", 0.0), (1, "r2", "f1", .5)], "sample_id int, retriever string, metric string, value double")
    assert rows(Q.retriever_summary(sc)) == [("r1", "em", 0.5), ("r2", "f1", 0.5)]
    with pytest.raises(ValueError):
        Q.require_metrics(sc, ["em"])
    assert rows(Q.token_f1_long(spark.createDataFrame([(1, ["a", "b", "b"])], "k int, tokens array<string>"), spark.createDataFrame([(1, ["b", "b", "c"])], "k int, tokens array<string>"), "k")) == [(1, pytest.approx(2 / 3))]


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6)]:
        s = np.round(rng.random((n, m)), 2)
        r, c = Q.assign(s)
        k = min(n, m)
        best = max(sum(s[i, j] for i, j in zip(a, b)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        assert len(set(r)) == len(set(c)) == k and abs(s[r, c].sum() - best) < 1e-9


def test_matching_and_fuzzy(spark):
    d = spark.createDataFrame([(1, ["big cat", "dog"], ["cat", "dog", "cow"]), (2, [], ["a"])], "k int, g array<string>, p array<string>")
    got = rows(Q.matched_scores(d, "k", "g", "p"))
    t = 1 + 2 / 3
    assert got[0] == (1, pytest.approx(t / 3), pytest.approx(t / 2), pytest.approx(2 * (t / 3) * (t / 2) / (t / 3 + t / 2))) and got[1] == (2, 0, 0, 0)
    f = spark.createDataFrame([("Annx", ["Ann", "Bob"]), ("Bob", ["Bobb", "Bob"]), ("zz", ["Ann"])], "w string, c array<string>")
    assert rows(Q.fuzzy_keywords(f, "w", "c", "m"), "w", "m") == [("Annx", "Ann"), ("Bob", "Bob"), ("zz", None)]
    ch = spark.createDataFrame([(["so (B)", "I pick Red.", "final: A", "?"], ["red", "blue"])], "r array<string>, c array<string>")
    out = Q.choice_filter(ch, "r", "c", "o", r"\(([A-Z])\)", ignore_case=True, ignore_punctuation=True).first().o
    assert out == ["B", "(A)", "(A)", "[invalid]"]


# ---- contamination ------------------------------------------------------------------------------------

TABLE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)


def py_clean(text, dirt, n, window, cutoff, low):
    words = [(m.group(), m.start(), m.end() - 1) for m in re.finditer(r"\S+", text)]
    parts = [(words[i][1], words[i + n - 1][2]) for i in range(len(words) - n + 1) if " ".join(w[0] for w in words[i:i + n]).translate(TABLE) in dirt]
    out, at, end = [], 0, -1
    if len(parts) > cutoff:
        return []
    for s, e in parts:
        s, end = max(0, s - window), min(len(text), e + window)
        if s - at > low:
            out.append(text[at:s])
        at = end
    if end < len(text) - low:
        out.append(text[end + 1:])
    return out


def test_clean_chunks_and_overlaps(spark):
    rng = np.random.default_rng(9)
    words = ["Alpha", "beta,", "gam-ma", "delta", "eps.", "Zeta"]
    docs = [(i, "  ".join(rng.choice(words, 60))) for i in range(12)] + [(99, "clean words only here " * 6), (100, "short")]
    bench = [(0, docs[0][1][100:140]), (1, "delta eps zeta"), (2, "no such thing at all")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(bench, "item_id int, text string")
    n, norm = 3, lambda t: t.translate(TABLE).split()
    grams = lambda t: {" ".join(norm(t)[i:i + n]) for i in range(len(norm(t)) - n + 1)}
    dirt = set().union(*[grams(t) for _, t in bench])
    for cutoff in (2, 50):
        got = {}
        c = D.clean_chunks(d, "doc_id", D.document_ngrams(b, ["item_id"], n=n).select("ngram"), n=n, window=5, cutoff=cutoff, min_slice=8)
        for r in c.orderBy("doc_id", "chunk_id").collect():
            got.setdefault(r.doc_id, []).append(r.chunk)
        want = {i: x for i, x in ((i, py_clean(t, dirt, n, 5, cutoff, 8)) for i, t in docs) if x}
        assert got == want
    assert rows(D.overlaps(d, "doc_id", b, "item_id", n=n)) == sorted([(i, j) for i, t in docs for j, u in bench if grams(t) & grams(u)], key=str)
    assert rows(D.contaminated(d, "doc_id", b, ["item_id"], n=n)) == sorted([(j,) for j, u in bench if any(grams(t) & grams(u) for _, t in docs)], key=str)
    count = {}
    for _, t in docs:
        for g in grams(t):
            count[g] = count.get(g, 0) + 1
    assert dict(rows(D.common_ngrams(d, "doc_id", n=n, more_than=3))) == {g: c for g, c in count.items() if c > 3}
    assert D.bucketed_ngrams(d, "doc_id", 4, n=n).select("bucket").distinct().count() <= 4


# ---- models, outputs, loops ------------------------------------------------------------------------------

class Echo:
    def complete(self, prompts):
        return [p.upper() for p in prompts]


class Broken:
    def complete(self, prompts):
        raise RuntimeError("down")


def test_generation_retry_and_cache(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, p string")
    assert rows(models.generate(d, "p", "o", Echo), "k", "o") == [(1, "A"), (2, "B"), (3, "A")]
    assert rows(models.generate(d, "p", "o", Broken, attempts=2, wait=0), "o") == [("[]",)] * 3
    out, fresh = models.generate_cached(d, "p", "o", Echo, None)
    assert rows(out, "k", "o") == [(1, "A"), (2, "B"), (3, "A")] and fresh.count() == 2
    cache = fresh.select("key", F.lit("cached").alias("response"))
    out, fresh = models.generate_cached(d, "p", "o", Broken, cache)
    assert rows(out, "o") == [("cached",)] * 3 and fresh.count() == 0


def test_output_repair(spark):
    good = '{"Head":"a","Relation":"r","Tail":"b"}'
    cases = [f"text [{good},{good}]", f"[{good},", '[{"head ":"a","relation":"r","Tail entity":"b"}, 5, {"Head":"a"}]', "{'Head':'a','Relation':'r','Tail':'b'}", "junk", None,
             '[{"Head":1,"Relation":"r","Tail":"b"}]']
    d = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = dict(rows(O.repaired(d, "t", "o", "entity_relation"), "i", "o"))
    one = '[{"Head":"a","Relation":"r","Tail":"b"}]'
    assert got == {0: one, 1: one, 2: one, 3: one, 4: "[]", 5: "[]", 6: "[]"}
    ev = spark.createDataFrame([('[{"Event":"e","Entity":[" a ",3]},{"Event":"e","Entity":[]}]',)], "t string")
    fixed = O.repaired(ev, "t", "o", "event_entity")
    assert fixed.first().o == '[{"Event":"e","Entity":["a"]}]'
    assert fixed.select(O.valid_stage("o", "event_entity"), O.valid_stage("t", "event_entity"), O.valid_stage(F.lit('[{"Head":1}]'), "entity_relation")).first()[:] == (True, False, False)
    f = spark.createDataFrame([('{"fact": [["a","b","c"], [[["x","y","z"]], 1], ["a","b"], [1,2,3], "q"]}',), ("no",)], "t string")
    assert [r.o for r in O.first_triplets(f, "t", "o").collect()] == [[["a", "b", "c"], ["x", "y", "z"]], []]
    k = spark.createDataFrame([('{"keywords": ["a", ["b", ["%s"]], 4]}' % ("x" * 201),)], "t string")
    assert O.keywords(k, "t", "o").first().o == ["a", "b"]
    m = spark.createDataFrame([('[{"question":"q","options":[],"answer":"A"},{"x":1}]', "[]"), ('{"a":1}', "[]")], "mcq string, l string")
    g = O.gated_questions(m, ["mcq", "l"], {"mcq": ["question", "options", "answer"]})
    assert g.count() == 1 and g.select(F.size("mcq")).first()[0] == 1
    c, r = O.concept_records(spark.createDataFrame([("c1", '{"concepts":[{"name":"a","type":"t"},{"x":1}],"relationships":[{"source":"a","target":"b","relation":"r"}]}')], "k string, o string"), "o", "k")
    assert c.count() == 1 and r.count() == 1


class Reactor:
    """Answers once the context names the second passage; otherwise searches for it."""

    def complete(self, prompts):
        out = []
        for p in prompts:
            if "second" in p.split("Question:")[0] or "easy" in p:
                out.append("Thought: t\nAction: none\nAnswer: done")
            elif "never" in p:
                out.append("Thought: t\nAction: search for nothing\nAnswer: need more information")
            else:
                out.append("Thought: t\nAction: search for second\nAnswer: Need more information")
        return out


def test_reason_and_search(spark):
    q = spark.createDataFrame([(1, "easy one"), (2, "hard one"), (3, "never ending")], "query_id int, text string")

    def retrieve(d, k):
        return d.select("query_id", F.lit(1).alias("rank"), F.when(F.col("text") == "second", "the second passage").otherwise("the first passage").alias("text"))
    got = rows(A.reason_and_search(q, retrieve, Reactor, max_rounds=3))
    assert got == [(1, "done", 1), (2, "done", 2), (3, "need more information", 3)]


class Reader:
    def complete(self, prompts):
        return ["<think>x</think> Answer: blue" if "sky is blue" in p else "Answer: none" for p in prompts]


def test_benchmark_and_chat(spark):
    s = spark.createDataFrame([(1, "colour of the sky", "blue", ["sky is blue"]), (2, "colour of grass", "green", ["grass is green"])], "query_id int, text string, answer string, gold array<string>")
    hit = lambda q: q.select("query_id", F.lit(1).alias("rank"), F.lit("the sky is blue").alias("text"))
    long, avg = A.benchmark(s, {"flat": hit}, Reader)
    assert long.count() == 8
    assert dict(((m, v) for _, m, v in rows(avg))) == {"em": 0.5, "f1": 0.5, "recall_at_2": 0.5, "recall_at_5": 0.5}
    m = A.chat_questions(spark.createDataFrame([(1, "Q Question: a Question: what sky"), (2, "MC pick"), (3, "skip me")], "query_id int, prompt string"), ["skip"], ["MC"])
    assert set(r[0] for r in rows(m, "text")) == {"MC pick", None, "what sky"}
    ans = A.chat_answers(m, m.select("query_id", F.lit(1).alias("rank"), F.lit("sky is blue").alias("text")), Echo)
    got = dict(rows(ans, "query_id", "answer"))
    assert got[3] == "SKIP ME" and "PASSAGE 1: SKY IS BLUE" in got[1] and "(X)" in got[2]


def test_task_evaluation(spark):
    d = spark.createDataFrame([(1, "q one", ["long answer", "ab"], 1), (2, "q two", ["x", "yy"], 1)], "id int, q string, c array<string>, g int")
    mc = E.Task("mc", "multiple_choice", lambda: F.col("q"), lambda: F.col("g"), lambda: F.col("c"), metrics=("acc", "acc_norm"))
    gen = E.Task("gen", "generate", lambda: F.col("q"), lambda: F.lit("one"), metrics=("exact_match",), repeats=3, filters=(("majority_vote", {}),))
    groups = spark.createDataFrame([("all", "mc"), ("all", "gen")], "grp string, member string")
    res, grp = E.evaluate({"mc": d, "gen": d}, [mc, gen], E.LengthModel, "id", groups)
    assert {(t, m): v for t, m, v in rows(res, "task", "metric", "value")} == {("mc", "acc"): .5, ("mc", "acc_norm"): 0.0, ("gen", "exact_match"): .5}
    assert grp.filter("metric = 'acc'").first().value == .5
    roll = E.Task("r", "rolling", lambda: F.col("q"), lambda: F.lit(0), metrics=("byte_perplexity", "bits_per_byte"))
    # the stand-in's likelihood is minus the number of characters, one byte each
    got = {r.metric: r.value for r in E.evaluate({"r": d}, [roll], E.LengthModel, "id")[0].collect()}
    assert got == {"byte_perplexity": pytest.approx(math.e), "bits_per_byte": pytest.approx(1 / math.log(2))}
    cost = E.estimate_cost(E.requests(d, gen, "id"), "generate", lambda c: F.size(tokens(c)))
    assert cost.first().tokens == 6 * (2 + 256)
    assert len(E.document_hashes(d, "q", "q", "q").first().doc_hash) == 64


def test_group_closure_is_deep_and_rejects_cycles(spark):
    chain = spark.createDataFrame([(f"g{i}", f"g{i + 1}") for i in range(24)] + [("g24", "task")], "grp string, member string")
    assert M.group_closure(chain).filter("grp = 'g0'").first().task == "task"
    with pytest.raises(ValueError):
        M.group_closure(spark.createDataFrame([("a", "b"), ("b", "a")], "grp string, member string"))
