"""Token usage, filters that pass through on errors, and the store of answers."""
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave import models
from kgweave.plans import retrieve as Q
from kgweave.sources import responses as S


class Counting:
    """Answers in capitals; counts words."""

    def complete_with_usage(self, prompts):
        return [(p.upper(), len(p.split()), 1) for p in prompts]

    def complete(self, prompts):
        return [p.upper() for p in prompts]


class Plain:
    def complete(self, prompts):
        return ["ok"] * len(prompts)


class Never:
    def complete(self, prompts):
        raise AssertionError("asked")


class Picky:
    """Keeps the first item of the second question's list; fails or talks nonsense for others."""

    def complete(self, prompts):
        out = []
        for p in prompts:
            items = json.loads(p.split("\n")[1].split(": ", 1)[1])
            field = "fact" if "Facts" in p else "keywords"
            out.append({"1": "no json", "2": json.dumps({field: items[:1]}), "3": json.dumps({field: []})}.get(p.split("Question: ")[1][0], "[]"))
        return out


def test_usage_and_time(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e f")], "k int, p string")
    got = models.generate_with_usage(d, "p", "u", Counting)
    assert rows(got.select("k", "u.response", "u.prompt_tokens", "u.completion_tokens", "u.total_tokens")) == [(1, "A B", 2, 1, 3), (2, "C", 1, 1, 2), (3, "D E F", 3, 1, 4)]
    t = models.usage_totals(got, "u").first()
    assert (t.calls, t.prompt_tokens, t.total_tokens) == (3, 6, 9) and t.time > 0
    assert rows(models.generate_with_usage(d, "p", "u", Plain).select("u.response", "u.total_tokens")) == [("ok", None)] * 3
    assert rows(models.generate_with_usage(d, "p", "u", Never, attempts=1, wait=0).select("u.response", "u.total_tokens")) == [("[]", 0)] * 3


def test_filters_pass_through_on_errors(spark):
    qs = spark.createDataFrame([(1, "1 x"), (2, "2 x"), (3, "3 x"), (4, "4 x")], "query_id int, text string")
    facts = spark.createDataFrame([(q, h, "r", "t") for q in (1, 2, 3, 4) for h in ("a", "b")], "query_id int, head string, relation string, tail string")
    got = rows(Q.model_fact_filter(qs, Picky)(facts).select("query_id", "head", "relation", "tail"))
    assert got == [(1, "a", "r", "t"), (1, "b", "r", "t"), (2, "a", "r", "t"), (4, "a", "r", "t"), (4, "b", "r", "t")]
    names = facts.select("query_id", F.col("head").alias("name"))
    assert rows(Q.model_name_filter(qs, Picky)(names).select("query_id", "name")) == [(1, "a"), (1, "b"), (2, "a"), (4, "a"), (4, "b")]


def nodes_of(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes_of(plan.children().apply(i))


def test_answers_are_stored_once(spark, tmp_path):
    store = S.ResponseStore(spark, str(tmp_path / "store"), buckets=4)
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, p string")
    assert rows(S.answer_stored(d, "p", "o", Counting, store, "one"), "k", "o") == [(1, "A"), (2, "B"), (3, "A"), (4, "")]
    # asked again, under the same name or another: the model is not called
    assert rows(S.answer_stored(d, "p", "o", Never, store, "one"), "k", "o") == [(1, "A"), (2, "B"), (3, "A"), (4, "")]
    more = d.union(spark.createDataFrame([(5, "c")], d.schema))
    assert rows(S.answer_stored(more, "p", "o", Counting, store, "two"), "k", "o") == [(1, "A"), (2, "B"), (3, "A"), (4, ""), (5, "C")]
    assert store.parts() == ["one", "two"] and store.part("two").count() == 1
    assert rows(S.answer_stored(d, "p", "o", Plain, store, "x", sampling=True), "o") == [("ok",)] * 4 and store.parts() == ["one", "two"]
    # other parameters are other keys
    assert rows(S.answer_stored(d.limit(1), "p", "o", Plain, store, "three", params="t=1"), "o") == [("ok",)]


def test_lookups_exchange_no_part_of_the_store(spark, tmp_path):
    store = S.ResponseStore(spark, str(tmp_path / "store"), buckets=8)
    d = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").alias("response"))
    store.append(d, "a")
    store.append(d.where("false"), "b")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left = store.missing(spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("key")))
        assert left.count() == 50
        plan = left._jdf.queryExecution().executedPlan()
        assert sum("Exchange" in n.nodeName() for n in nodes_of(plan)) == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_an_interrupted_part_is_written_again(spark, tmp_path):
    store = S.ResponseStore(spark, str(tmp_path / "store"), buckets=2)
    (tmp_path / "store" / "one").mkdir(parents=True)
    d = spark.createDataFrame([(1, "a")], "k int, p string")
    assert store.parts() == [] and rows(S.answer_stored(d, "p", "o", Counting, store, "one"), "o") == [("A",)]
    assert store.parts() == ["one"]
