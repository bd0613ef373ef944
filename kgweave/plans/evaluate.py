"""Task evaluation: requests, responses, filters, metrics, aggregation, group roll-up."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.registry import FILTERS, METRICS
from ..operators import metrics as M


class TaskModel(Protocol):
    """The three verbs a scored model offers; each takes and returns a batch."""

    def loglikelihood(self, contexts: list[str], continuations: list[str]) -> list[float]: ...

    def loglikelihood_rolling(self, texts: list[str]) -> list[float]: ...

    def generate_until(self, contexts: list[str]) -> list[str]: ...


class LengthModel:
    """Stand-in model: shorter continuations are likelier, generation repeats the last word."""

    def loglikelihood(self, contexts, continuations):
        return [-float(len(c)) for c in continuations]

    def loglikelihood_rolling(self, texts):
        return [-float(len(t)) for t in texts]

    def generate_until(self, contexts):
        return [(c.split() or [""])[-1] for c in contexts]


@dataclass(frozen=True)
class Task:
    """One task: how a document becomes a request and how its response is scored."""
    name: str
    kind: str                                   # "multiple_choice", "generate" or "rolling"
    prompt: Callable[[], Column]
    gold: Callable[[], Column]
    choices: Callable[[], Column] | None = None
    filters: tuple[tuple[str, dict], ...] = (("take_first", {}),)
    metrics: tuple[str, ...] = ("acc",)
    repeats: int = 1
    options: dict = field(default_factory=dict)


def result_rows(answered: DataFrame, task: str, key: str, metrics: dict[str, Column]) -> DataFrame:
    """(task, doc_id, metric, value) from a task's own result hook: a column per metric over an answered row.

    A hook may name any metrics; a null value is a metric that the row does not have. The rows go on to
    `aggregate` like those of the built-in metrics.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])
    return answered.select(F.lit(task).alias("task"), F.col(key).alias("doc_id"), F.explode(values).alias("x")).select("task", "doc_id", "x.*").where("value IS NOT NULL")


def requests(docs: DataFrame, task: Task, key: str) -> DataFrame:
    """Request rows (task, doc_id, idx, prompt, continuation, gold): one per choice or repeat."""
    base = docs.select(F.lit(task.name).alias("task"), F.col(key).alias("doc_id"), task.prompt().alias("prompt"), task.gold().alias("gold"),
                       *([task.choices().alias("choices")] if task.choices else []))
    if task.kind == "multiple_choice":
        return base.select("*", F.posexplode("choices").alias("idx", "continuation"))
    return base.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(task.repeats - 1)))).withColumn("continuation", F.lit(None).cast("string"))


def respond(reqs: DataFrame, task: Task, make_model: Callable[[], TaskModel]) -> DataFrame:
    """Model responses for request rows, a batch per Arrow block and one model per task."""
    if task.kind == "multiple_choice":
        @F.pandas_udf("double")
        def ll(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make_model()
            for p, c in parts:
                yield pd.Series(model.loglikelihood(p.tolist(), c.tolist()))
        return reqs.withColumn("resp", ll("prompt", "continuation"))
    if task.kind == "rolling":
        @F.pandas_udf("double")
        def roll(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make_model()
            for p in parts:
                yield pd.Series(model.loglikelihood_rolling(p.tolist()))
        return reqs.withColumn("resp", roll("prompt"))

    @F.pandas_udf("string")
    def gen(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for p in parts:
            yield pd.Series(model.generate_until(p.tolist()))
    return reqs.withColumn("resp", gen("prompt"))


def score(responses: DataFrame, task: Task) -> DataFrame:
    """Per-document metric rows (task, doc_id, metric, value, weight); lists hold one document's choices.

    The weight of a rolling likelihood is the number of words or bytes it covers.
    """
    units: dict[str, Column] = {}
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "resp"))), lambda x: x["resp"])
    firsts = [F.first(c).alias(c) for c in ("gold", "choices", "prompt") if c in responses.columns]
    d = responses.groupBy("task", "doc_id").agg(listed.alias("resps"), *firsts)
    if task.kind == "multiple_choice":
        cols = {"acc": METRICS["acc"]("resps", "gold"), "acc_norm": METRICS["acc_norm"]("resps", "choices", "gold")}
    elif task.kind == "rolling":
        from ..functions.text import utf8_bytes, word_count
        r = F.get("resps", F.lit(0))
        units = {"word_perplexity": word_count("prompt"), "byte_perplexity": utf8_bytes("prompt"), "bits_per_byte": utf8_bytes("prompt")}
        cols = dict.fromkeys(units, r)
    else:
        value = F.col("resps")
        for name, args in task.filters:
            value = FILTERS[name](value, **args)
        cols = {"exact_match": METRICS["exact_match"](value, F.col("gold"), **task.options)}
    use = {k: F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), units.get(k, F.lit(1)).cast("double").alias("weight"))
           for k, v in cols.items() if k in task.metrics}
    return d.select("task", "doc_id", F.explode(F.array(*use.values())).alias("m")).select(
        "task", "doc_id", "m.*")


def aggregate(scores: DataFrame) -> DataFrame:
    """Task results: value, standard error and size per metric.

    Perplexities and bits per byte come from the sums of likelihoods and of units and have no standard
    error here; every other metric is a mean.
    """
    perplexity = F.col("metric").isin("word_perplexity", "byte_perplexity")
    weighted = perplexity | (F.col("metric") == "bits_per_byte")
    found = scores.groupBy("task", "metric").agg(
        M.mean("value").alias("mean"), M.weighted_perplexity("value", "weight").alias("perplexity"), M.bits_per_byte("value", "weight").alias("bits"),
        M.mean_stderr("value").alias("stderr"), F.count("*").alias("size"))
    return found.select("task", "metric", F.when(perplexity, F.col("perplexity")).when(weighted, F.col("bits")).otherwise(F.col("mean")).alias("value"),
                        F.when(~weighted, F.col("stderr")).alias("stderr"), "size")


def evaluate(docs: dict[str, DataFrame], tasks: list[Task], make_model: Callable[[], TaskModel], key: str,
             groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Task results and, with ``groups`` (grp, member), the rolled-up group results."""
    rows = None
    for t in tasks:
        s = score(respond(requests(docs[t.name], t, key), t, make_model), t)
        rows = s if rows is None else rows.unionByName(s)
    results = aggregate(rows)
    return results, M.roll_up(results, M.group_closure(groups)) if groups is not None else None


def estimate_cost(reqs: DataFrame, kind: str, tokens: Callable[[Column], Column], generate_extra: int = 256, rolling_extra: int = 2048) -> DataFrame:
    """Tokens a task would send: prompt tokens plus a flat allowance per generated or rolling request."""
    extra = {"generate": generate_extra, "rolling": rolling_extra}.get(kind, 0)
    return reqs.groupBy("task").agg(F.sum(tokens(F.col("prompt")) + F.lit(extra)).alias("tokens"))


def document_hashes(docs: DataFrame, doc: str, prompt: str, target: str) -> DataFrame:
    return docs.withColumn("doc_hash", F.sha2(doc, 256)).withColumn("prompt_hash", F.sha2(prompt, 256)).withColumn("target_hash", F.sha2(target, 256))
