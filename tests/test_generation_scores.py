"""BLEU against a brute-force version, resampled metrics against sampling by hand, n-gram hashes and edge concepts."""
import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave.operators import contamination as D, graph as G, metrics as M


def tokens(t):
    t = t.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(a, b)
    t = f" {t} "
    t = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", t)
    t = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", t)
    t = re.sub(r"([\.,])([^0-9])", r" \1 \2", t)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", t).split()


def bleu(data, smooth=True):
    hit, total, pl, rl = [0] * 4, [0] * 4, 0, 0
    grams = lambda t, n: collections.Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    for p, refs in data:
        p, refs = tokens(p), [tokens(r) for r in refs]
        pl, rl = pl + len(p), rl + min((abs(len(r) - len(p)), len(r)) for r in refs)[1]
        for n in range(1, 5):
            most = collections.Counter()
            for r in refs:
                most |= grams(r, n)
            hit[n - 1] += sum((grams(p, n) & most).values())
            total[n - 1] += sum(grams(p, n).values())
    if not any(hit) or 0 in total:
        return 0.0
    half, logs = 1.0, []
    for h, t in zip(hit, total):
        if not h:
            half *= 2
            if not smooth:
                return 0.0
        logs.append(math.log((h or 1 / half) / t))
    return 100 * (1 if pl >= rl else math.exp(1 - rl / pl)) * math.exp(sum(logs) / 4)


DATA = [("The cat's mat, 3.5-4 m &amp; more.", ["The cat's mat is 3.5-4 m; more.", "A cat & a mat, 3.5-4 m &lt;"]), ("So it goes-\non", ["So it goeson then"]), ("", ["nothing here"]), ("x y", ["x y z", "x"])]


def frame(spark, data):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(data)], "k int, p string, r array<string>")


@pytest.mark.parametrize("data", [DATA, [("a b c d e", ["a c b e d"])], [("a b", ["c d"])], [("a b", ["a b"])], [("a b c d", [""])]])
def test_bleu_equals_brute_force(spark, data):
    assert M.corpus_bleu(frame(spark, data), "p", "r", "k").first()[0] == pytest.approx(bleu(data), abs=1e-9)
    assert M.corpus_bleu(frame(spark, data), "p", "r", "k", smooth=False).first()[0] == pytest.approx(bleu(data, False), abs=1e-9)


def test_tokens_of_the_scorer(spark):
    got = frame(spark, DATA).select("k", M.tokens_13a("p").alias("t")).orderBy("k").collect()
    assert [list(r.t) for r in got] == [tokens(p) for p, _ in DATA]


def test_bleu_of_an_empty_table_and_null_texts(spark):
    assert M.corpus_bleu(frame(spark, []), "p", "r", "k").first()[0] == 0.0
    assert M.corpus_bleu(frame(spark, [(None, None), ("a b c d", ["a b c d"])]), "p", "r", "k").first()[0] == pytest.approx(100.0)


def test_resampled_sums_are_those_of_the_draws(spark):
    r = np.random.default_rng(1)
    data = [(i, float(r.integers(0, 2)), float(r.normal())) for i in range(300)]
    df = spark.createDataFrame([*data, (900, None, None)], "id long, a double, b double")
    got = {x.iteration: (x.a, x.b) for x in M.resampled(df, "id", ["a", "b"], 40).collect()}
    assert sorted(got) == list(range(40))
    times = lambda k, i: next(m for c, m in M.POISSON_BYTES if hashlib.md5(f"42:{k}:{i // 16}".encode()).digest()[i % 16] < c)
    for i in (0, 7, 39):
        assert got[i] == pytest.approx(tuple(sum(times(k, i) * v[j] for k, *v in data) for j in (0, 1)))
    again = {x.iteration: (x.a, x.b) for x in M.resampled(df.repartition(5), "id", ["a", "b"], 40).collect()}
    assert all(got[i] == pytest.approx(again[i]) for i in got)


def test_resampled_stderr_is_near_theory(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4 == 0).cast("int").alias("hit"), F.lit(1).alias("n"))
    e = M.resampled_stderr(M.resampled(df, "id", ["hit", "n"], 1000), {"acc": F.col("hit") / F.col("n")}).first()
    assert abs(e["mean"] - 0.25) < 0.002 and abs(e["stderr"] - math.sqrt(0.25 * 0.75 / 4000)) < 0.0006
    c = spark.createDataFrame([(3.0, 1.0, 2.0, 4.0), (0.0, 0.0, 0.0, 5.0)], "tp double, fp double, fn double, tn double")
    m = M.confusion_metrics()
    assert rows(c.select(F.round(m["f1"], 6), F.round(m["mcc"], 6))) == [(0.0, 0.0), (round(6 / 9, 6), round(10 / math.sqrt(4 * 5 * 5 * 6), 6))]


def test_common_ngrams_name_their_text(spark):
    text = "one two three four five"
    docs = spark.createDataFrame([(i, f"w{i} {text}, w{i}") for i in range(12)] + [(99, None), (98, "")], "id long, text string")
    got = dict(rows(D.common_ngrams(docs, "id", n=3, more_than=10)))
    assert got == {"one two three": 12, "two three four": 12, "three four five": 12}
    assert D.common_ngrams(docs.where("id > 90"), "id", n=3).count() == 0


def test_common_ngrams_are_shuffled_packed(spark, tmp_path, monkeypatch):
    """No row per n-gram is shuffled; long documents, repeated and null keys, and several batches give the right counts."""
    import random

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice((1, 5, 60, 1500)))) for _ in range(60)] + ["W1, w2 w3!"] * 3 + [None, ""]
    want = {}
    for t in texts:
        w = (t or "").lower().replace(",", "").replace("!", "").split()
        for g in {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}:
            want[g] = want.get(g, 0) + 1
    for keys in ([str(i) for i in range(len(texts))], [str(i % 50) for i in range(len(texts))], [None if i % 3 else str(i) for i in range(len(texts))]):
        docs = spark.createDataFrame([*zip(keys, texts)], "id string, text string").repartition(3)
        kept = []

        def keep(df, _run=D.cut_lineage):
            kept.append(df._jdf.queryExecution().toString())
            return _run(df)
        monkeypatch.setattr(D, "cut_lineage", keep)
        assert dict(rows(D.common_ngrams(docs, "id", n=3, more_than=1))) == {g: c for g, c in want.items() if c > 1}
        monkeypatch.undo()
        assert len(rows(D.common_ngrams(docs, "id", n=3, more_than=1))) == len({g for g, c in want.items() if c > 1})
        assert "hashpartitioning(bucket" in kept[0] and "hashpartitioning(h1" not in kept[0]


def test_edge_concepts_keep_first_seen_order(spark):
    e = spark.createDataFrame([("a", "b", ["x", "y"], 3), ("a", "b", ["z", "x"], 1), ("a", "b", ["x", "y"], 2), ("a", "c", [], 1), ("a", "d", None, 1), ("d", "a", ["q", "q"], 1)],
                              "src string, dst string, concepts array<string>, ord int")
    assert rows(G.edge_concepts(e)) == [("a", "b", "z,x,y"), ("d", "a", "q")]
