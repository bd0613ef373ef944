"""Evaluation harness: per-document metrics, aggregations, standard errors, group roll-up."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import argmax, let
from ..functions.registry import aggregation, metric, response_filter
from ..functions.text import _col, exact_match_form, regex_pick, first_char_choice
from ..session import cut_lineage, dense_index

# Constant score of a skipped metric, bootstrap iterations and their cap.
BYPASS = 999
BOOTSTRAP_ITERATIONS, SLOW_METRIC_ITERATIONS = 100_000, 100
SLOW_METRICS = ("bleu", "chrf", "ter")


# ---- aggregations over a column -------------------------------------------------------------

@aggregation("mean")
def mean(x) -> Column:
    return F.avg(x)


@aggregation("perplexity")
def perplexity(x) -> Column:
    return F.exp(-F.avg(x))


@aggregation("weighted_mean")
def weighted_mean(value, weight) -> Column:
    return F.sum(value) / F.sum(weight)


@aggregation("weighted_perplexity")
def weighted_perplexity(value, weight) -> Column:
    return F.exp(-weighted_mean(value, weight))


@aggregation("bits_per_byte")
def bits_per_byte(value, weight) -> Column:
    return -weighted_mean(value, weight) / math.log(2)


@aggregation("bypass")
def bypass(*_) -> Column:
    return F.lit(BYPASS)


@aggregation("f1")
def binary_f1(gold, pred) -> Column:
    """F1 of class 1; 0 when it neither occurs nor is predicted."""
    g, p = _col(gold), _col(pred)
    tp = F.count_if((g == 1) & (p == 1))
    return F.coalesce(2 * tp / F.nullif(F.count_if(g == 1) + F.count_if(p == 1), F.lit(0)), F.lit(0.0))


@aggregation("sample_stddev")
def sample_stddev(x) -> Column:
    return F.stddev_samp(x)


@aggregation("population_stddev")
def population_stddev(x) -> Column:
    return F.stddev_pop(x)


@aggregation("mean_stderr")
def mean_stderr(x) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


@aggregation("binary_mcc")
def binary_mcc(gold, pred) -> Column:
    return F.corr(_col(gold).cast("double"), _col(pred).cast("double"))


@aggregation("pooled_stderr")
def pooled_stderr(stderr, size) -> Column:
    """Standard error of pooled samples from per-task errors and sizes."""
    s, n = _col(stderr), _col(size)
    return F.sqrt(F.sum((n - 1) * s * s * n) / (F.sum(n) - F.count(n)) / F.sum(n))


@aggregation("size_weighted_mean")
def size_weighted_mean(value, size, weight_by_size: bool = True) -> Column:
    return F.sum(_col(value) * _col(size)) / F.sum(size) if weight_by_size else F.avg(value)


def group_by(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def positional_median(df: DataFrame, value: str, order_by: list[str]) -> DataFrame:
    """Middle element by *position*, unsorted, as recorded runs use it; see ``true_median``."""
    pos = dense_index(df.select(value, *[c for c in order_by if c != value]), order_by, "pos")
    return pos.filter(F.col("pos") == pos.count() // 2).select(F.col(value).alias("median"))


def true_median(value) -> Column:
    return F.median(value)


def confusion(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    """Per class: support, predicted, correct and F1, from a confusion table (not from rows)."""
    c = confusion(df, keys, gold, pred)
    g = c.groupBy(*keys, F.col("gold").alias("cls")).agg(F.sum("n").alias("support"))
    p = c.groupBy(*keys, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    t = c.filter("gold = pred").select(*keys, F.col("gold").alias("cls"), F.col("n").alias("correct"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return g.join(p, [*keys, "cls"], "full").join(t, [*keys, "cls"], "left").select(
        *keys, "cls", z("support"), z("predicted"), z("correct"),
        F.coalesce(2 * F.coalesce("correct", F.lit(0)) / (F.coalesce("support", F.lit(0)) + F.coalesce("predicted", F.lit(0))), F.lit(0.0)).alias("f1"))


def weighted_f1(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    s = class_scores(df, keys, gold, pred)
    return s.groupBy(*keys).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def matthews(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    """Multi-class Matthews correlation from class totals; 0 when undefined."""
    s = class_scores(df, keys, gold, pred)
    a = s.groupBy(*keys).agg(F.sum("correct").alias("c"), F.sum("support").alias("n"),
                             F.sum(F.col("support") * F.col("predicted")).alias("pt"),
                             F.sum(F.col("predicted") * F.col("predicted")).alias("pp"),
                             F.sum(F.col("support") * F.col("support")).alias("tt"))
    d = lambda x: F.col(x).cast("double")
    den = F.sqrt((d("n") * d("n") - d("pp")) * (d("n") * d("n") - d("tt")))
    return a.select(*keys, F.when(den == 0, 0.0).otherwise((d("c") * d("n") - d("pt")) / den).alias("mcc"))


# ---- per-document metrics ----------------------------------------------------------------------

@metric("acc")
def acc(lls, gold) -> Column:
    return (argmax(lls) == _col(gold)).cast("double")


@metric("acc_norm")
def acc_norm(lls, choices, gold) -> Column:
    """Log-likelihood per character of the choice text."""
    per = F.zip_with(_col(lls), _col(choices), lambda a, c: a / F.length(c))
    return (argmax(per) == _col(gold)).cast("double")


@metric("acc_mutual_info")
def acc_mutual_info(lls, unconditional, gold) -> Column:
    return (argmax(F.zip_with(_col(lls), _col(unconditional), lambda a, b: a - b)) == _col(gold)).cast("double")


@metric("exact_match")
def exact_match(pred, gold, **ignore) -> Column:
    return (exact_match_form(pred, **ignore) == exact_match_form(gold, **ignore)).cast("double")


@metric("max_over_golds")
def max_over_golds(pred, golds, fn) -> Column:
    return F.array_max(F.transform(_col(golds), lambda g: fn(_col(pred), g)))


def acc_all(df: DataFrame) -> DataFrame:
    """Share of (paragraph, question) groups answered fully right, with the error over questions."""
    ok = (F.col("pred") == F.col("gold"))
    q = df.groupBy("paragraph", "question").agg(F.bool_and(ok).cast("int").alias("ok")).agg(
        F.avg("ok").alias("acc_all"), F.lit(None).cast("double").alias("acc_all_stderr"))
    e = df.groupBy("question").agg(F.bool_and(ok).cast("int").alias("ok")).agg(
        F.lit(None).cast("double").alias("acc_all"), mean_stderr("ok").alias("acc_all_stderr"))
    return q.unionByName(e).agg(F.max("acc_all").alias("acc_all"), F.max("acc_all_stderr").alias("acc_all_stderr"))


# ---- resampling and comparison ------------------------------------------------------------------

def bootstrap(df: DataFrame, key: str, value: str, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Means of resamples, one row per iteration, without moving a sample once per iteration.

    Every row draws its own multiplicity for each iteration (Poisson(1), the standard distributed
    form of the bootstrap) from a hash, so an iteration is a sum that combines on the map side.
    Equal in distribution to sampling with replacement, and repeatable.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("iteration")), F.lit(1 << 53)) / float(1 << 53))
    e = math.exp(-1)
    cdf, term, times = 0.0, e, F.lit(12)
    steps = []
    for k in range(12):
        cdf += term
        steps.append((cdf, k))
        term /= k + 1
    for c, k in reversed(steps):
        times = F.when(u < c, k).otherwise(times)
    rows = df.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")).withColumn("m", times)
    return rows.groupBy("iteration").agg((F.sum(F.col(value) * F.col("m")) / F.nullif(F.sum("m"), F.lit(0))).alias("statistic"))


def bootstrap_stderr(df: DataFrame, key: str, value: str, iterations: int = 1000, seed: int = 42) -> DataFrame:
    return bootstrap(df, key, value, iterations, seed).agg(F.stddev_samp("statistic").alias("stderr"))


# Poisson(1) multiplicities for the 256 values of a byte: the cumulated probabilities to the nearest 1/256
POISSON_BYTES = [(94, 0), (188, 1), (235, 2), (251, 3), (255, 4), (256, 5)]


def resampled(df: DataFrame, key: str, stats: list[str], iterations: int = 1000, seed: int = 42) -> DataFrame:
    """(iteration, stats): sums of additive statistics over ``iterations`` resamples of the rows.

    Any metric that is a function of sums (confusion counts, likelihoods and lengths, matches per n-gram order)
    is resampled by its sums. Every byte of md5("seed:key:block") is a row's Poisson(1) multiplicity in one
    iteration, so the draws are the same for any partitioning and in SQL. A task multiplies the multiplicities of
    its rows with their statistics and sends iterations x statistics numbers, however many rows it has; no row is
    moved. ``key`` should be unique (rows that share one share their draws); nulls count as 0.
    """
    import hashlib

    table = np.repeat([m for _, m in POISSON_BYTES], np.diff([0, *(c for c, _ in POISSON_BYTES)])).astype(np.float64)
    blocks = -(-iterations // 16)
    step = max(1, 4_000_000 // max(1, iterations))

    def run(frames):
        total = np.zeros((iterations, len(stats)))
        for f in frames:
            keys, values = f["_key"].tolist(), f[stats].to_numpy(np.float64)
            for a in range(0, len(keys), step):
                drawn = b"".join(hashlib.md5(f"{seed}:{k}:{b}".encode()).digest() for k in keys[a:a + step] for b in range(blocks))
                times = table[np.frombuffer(drawn, np.uint8).reshape(-1, 16 * blocks)[:, :iterations]]
                total += times.T @ values[a:a + step]
        yield pd.DataFrame({"iteration": np.arange(iterations), **{c: total[:, i] for i, c in enumerate(stats)}})

    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in stats])
    return rows.mapInPandas(run, "iteration int, " + ", ".join(f"{c} double" for c in stats)).groupBy("iteration").agg(*[F.sum(c).alias(c) for c in stats])


def confusion_metrics(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    """f1 and mcc from confusion sums; without any positive, or with a constant side, 0."""
    a, b, c, d = (F.col(x) for x in (tp, fp, fn, tn))
    f1 = F.when(2 * a + b + c == 0, 0.0).otherwise(2 * a / (2 * a + b + c))
    under = (a + b) * (a + c) * (d + b) * (d + c)
    return {"f1": f1, "mcc": F.when(under == 0, 0.0).otherwise((a * d - b * c) / F.sqrt(under))}


def resampled_stderr(sums: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, mean, stderr) of metrics of the sums over all resamples."""
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])).alias("x")).select("x.*")
    return each.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stderr"))


def bootstrap_iterations(metric_name: str, iterations: int = BOOTSTRAP_ITERATIONS) -> int:
    return min(iterations, SLOW_METRIC_ITERATIONS) if metric_name in SLOW_METRICS else iterations


def combined_stderr(items) -> Column:
    """Pairwise fold over an ordered array of (stderr, size, score); kept for comparison only."""
    a = _col(items)
    one = F.get(a, F.lit(0))

    def fold(s, x):
        n = s["size"] + x["size"]
        score = (s["score"] * s["size"] + x["score"] * x["size"]) / n
        var = (((s["size"] - 1) * s["var"] + (x["size"] - 1) * x["stderr"] * x["stderr"]) / (n - 1)
               + s["size"] * x["size"] / (n * (n - 1)) * (score - x["score"]) * (score - x["score"]))
        # the size stays that of the first part, as in recorded runs
        return F.struct(var.alias("var"), s["size"].alias("size"), score.alias("score"))
    start = F.struct((one["stderr"] * one["stderr"]).alias("var"), one["size"].cast("double").alias("size"), one["score"].alias("score"))
    return F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), start, fold, lambda s: F.sqrt(s["var"]))


def z_test(a, b, se_a, se_b) -> Column:
    """Difference of two scores in standard errors."""
    return (_col(a) - _col(b)) / F.sqrt(_col(se_a) * _col(se_a) + _col(se_b) * _col(se_b))


def two_sided_p(z) -> Column:
    """Two-sided p-value of a normal score (rational approximation of erfc, error below 1.5e-7)."""
    x = F.abs(_col(z)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Regression table: value of both runs and the change."""
    return a.select(*keys, F.col("value").alias("before")).join(b.select(*keys, F.col("value").alias("after")), keys, "full").withColumn(
        "change", F.col("after") - F.col("before"))


# ---- groups of tasks ----------------------------------------------------------------------------

def group_closure(members: DataFrame) -> DataFrame:
    """(grp, task) for every task below a group at any depth. ``members``: grp, member.

    A group that contains itself at some depth is an error.
    """
    step = members.select("grp", "member")
    every = step
    while True:
        if not step.filter("grp = member").isEmpty():
            raise ValueError("a group contains itself")
        step = cut_lineage(step.join(members.select(F.col("grp").alias("member"), F.col("member").alias("_m")), "member").select(
            "grp", F.col("_m").alias("member")).distinct())
        if step.isEmpty():
            break
        every = every.unionByName(step)
    groups = members.select(F.col("grp").alias("member")).distinct()
    return every.join(groups, "member", "left_anti").select("grp", F.col("member").alias("task"))


def roll_up(results: DataFrame, closure: DataFrame, weight_by_size: bool = True) -> DataFrame:
    """Group scores from task results (task, metric, value, stderr, size).

    A NULL standard error of any task makes the group's NULL.
    """
    r = closure.join(results, "task")
    return r.groupBy("grp", "metric").agg(
        size_weighted_mean("value", "size", weight_by_size).alias("value"),
        F.when(F.count("stderr") == F.count("*"), pooled_stderr("stderr", "size")).alias("stderr"),
        F.sum("size").alias("size"))


# ---- response filters -----------------------------------------------------------------------------

@response_filter("take_first")
def take_first(resps) -> Column:
    return F.get(_col(resps), F.lit(0))


@response_filter("take_first_k")
def take_first_k(resps, k: int) -> Column:
    return F.slice(_col(resps), 1, k)


@response_filter("majority_vote")
def majority_vote(resps) -> Column:
    """Most frequent response of a short list; ties go to the one seen first."""
    from ..functions.arrays import let
    return let(resps, lambda r: F.get(F.array_sort(F.transform(F.array_distinct(r), lambda x: F.struct(
        (-F.size(F.filter(r, lambda y: y == x))).alias("n"), F.array_position(r, x).alias("p"), x.alias("v")))), F.lit(0))["v"])


@response_filter("lowercase")
def lowercase(resps) -> Column:
    return F.transform(_col(resps), F.lower)


@response_filter("uppercase")
def uppercase(resps) -> Column:
    return F.transform(_col(resps), F.upper)


@response_filter("remove_whitespace")
def lstrip(resps) -> Column:
    from ..functions.text import PY_WS
    return F.transform(_col(resps), lambda x: F.regexp_replace(x, "^" + PY_WS + "+", ""))


@response_filter("map")
def mapped(resps, mapping: dict[str, str], default: str | None = None) -> Column:
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.transform(_col(resps), lambda x: F.coalesce(F.try_element_at(m, x), F.lit(default)))


@response_filter("regex")
def regex_filter(resps, pattern: str, group: int = 0, select: int = 0, fallback: str = "[invalid]") -> Column:
    return F.transform(_col(resps), lambda x: regex_pick(x, pattern, group, select, fallback))


@response_filter("first_char")
def first_char(resps, pattern: str, fallback: str = "[invalid]") -> Column:
    return F.transform(_col(resps), lambda x: first_char_choice(x, pattern, fallback))


def vote_long(votes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Majority vote over vote rows: most frequent value per key, ties to the earliest."""
    n = votes.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("_first")).alias("o"))).alias("winner"),
                                F.max("n").alias("votes"))


# ---- few-shot examples and text generation scores -------------------------------------------------

def few_shot(docs: DataFrame, pool: DataFrame, key: str, n: int, mode: str = "random", seed: int = 42) -> DataFrame:
    """(key, example, place): ``n`` examples per document, never the document itself.

    The pool is ordered once by a seeded hash (or by key for ``first_n``); each document takes a
    window of it starting at a hashed place, so nothing is paired beyond the examples used.
    """
    if mode not in ("random", "first_n"):
        raise ValueError("mode must be 'random' or 'first_n'")
    order = [F.xxhash64(F.lit(seed), key)] if mode == "random" else []
    shuffled = dense_index(pool.select(key).withColumn("_h", order[0] if order else F.lit(0)), ["_h", key], "pos")
    total = shuffled.count()
    start = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(max(total, 1))) if mode == "random" else F.lit(0)
    want = docs.select(F.col(key).alias("doc"), start.alias("_s")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(min(n, max(total - 1, 0)))))).withColumn(
        "pos", (F.col("_s") + F.col("_i")) % F.lit(max(total, 1)))
    got = want.join(shuffled.select("pos", F.col(key).alias("example")), "pos").filter("doc <> example")
    w = W.partitionBy("doc").orderBy("_i")
    return got.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("doc", "example", "place")


# The published evaluation tokenizer "13a", as replacements made one after the other on the text with
# a blank before and behind it.
TOKENS_13A = (
    ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "), (r"([^0-9])([\.,])", r"$1 $2 "), (r"([\.,])([^0-9])", r" $1 $2"), (r"([0-9])(-)", r"$1 $2 "))


def tokens_13a(text) -> Column:
    """Tokens of machine-translation scoring: punctuation and symbols apart, numbers whole."""
    c = F.rtrim(F.col(text) if isinstance(text, str) else text)
    for old, new in TOKENS_13A[:7]:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for old, new in TOKENS_13A[7:]:
        c = F.regexp_replace(c, old, new)
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def corpus_bleu(df: DataFrame, pred: str, ref: str, key: str, order: int = 4, smooth: bool = True) -> DataFrame:
    """Corpus BLEU over 13a tokens: one row (bleu). ``ref`` is a text or an array of texts.

    Clipped n-gram counts are summed per order, never gathered; a prediction's n-gram counts at most as often as
    in the reference that has it most, and the reference nearest in length (the shorter of two) makes the
    brevity penalty. With ``smooth`` an order without a match counts as half, a quarter, .. of a match, in turn;
    without any match the score is 0. Null texts count as empty.
    """
    from ..functions.arrays import ngrams
    many = df.schema[ref].dataType.simpleString().startswith("array")
    refs = F.coalesce(ref, F.array().cast("array<string>")) if many else F.array(ref)
    t = cut_lineage(df.select(F.col(key).alias("k"), tokens_13a(F.coalesce(pred, F.lit(""))).alias("p"), F.transform(
        refs, lambda r: tokens_13a(F.coalesce(r, F.lit("")))).alias("rs")))

    def grams(side):
        of = lambda n: F.transform(ngrams(side, n), lambda g: F.struct(F.lit(n).alias("n"), F.array_join(g, " ").alias("g")))
        return F.flatten(F.array(*[of(n) for n in range(1, order + 1)]))
    said = t.select("k", F.explode(grams("p")).alias("x")).groupBy("k", "x.n", "x.g").agg(F.count("*").alias("c"))
    given = t.select("k", F.posexplode("rs").alias("i", "r")).select("k", "i", F.explode(grams("r")).alias("x")).groupBy("k", "i", "x.n", "x.g").agg(F.count("*").alias("c"))
    most = given.groupBy("k", "n", "g").agg(F.max("c").alias("rc"))
    hits = said.join(most, ["k", "n", "g"], "left").groupBy("n").agg(F.sum(F.least("c", F.coalesce("rc", F.lit(0)))).alias("hit"), F.sum("c").alias("all"))
    near = F.array_min(F.transform("rs", lambda r: F.struct(F.abs(F.size(r) - F.size("p")).alias("d"), F.size(r).alias("n"))))["n"]
    lengths = t.agg(F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("pl"), F.coalesce(F.sum(near), F.lit(0)).alias("rl"))
    # at most ``order`` rows from here on
    w = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    share = F.when(F.col("hit") > 0, F.col("hit")).otherwise(F.pow(F.lit(2.0), -F.sum((F.col("hit") == 0).cast("int")).over(w)) if smooth else F.lit(0.0)) / F.col("all")
    parts = hits.withColumn("share", share).agg(F.sum("hit").alias("any"), F.count("*").alias("orders"), F.min("share").alias("least"), F.avg(F.log("share")).alias("lp"))
    bp = F.when(F.col("pl") >= F.col("rl"), 1.0).when(F.col("pl") == 0, 0.0).otherwise(F.exp(1 - F.col("rl") / F.col("pl")))
    none = (F.coalesce("any", F.lit(0)) == 0) | (F.col("orders") < order) | (F.col("least") == 0)
    return parts.withColumn("_one", F.lit(1)).join(lengths.withColumn("_one", F.lit(1)), "_one").select(F.when(none, 0.0).otherwise(100 * bp * F.exp("lp")).alias("bleu"))


def corpus_ter(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Corpus translation edit rate: word edits after greedy block shifts, per reference word."""
    @F.pandas_udf("struct<edits:double,words:double>")
    def run(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = [(float(shift_edits(a.split(), b.split())), float(len(b.split()))) for a, b in zip(p, r)]
        return pd.DataFrame(out, columns=["edits", "words"])
    return df.select(run(pred, ref).alias("x")).agg((100 * F.sum("x.edits") / F.nullif(F.sum("x.words"), F.lit(0.0))).alias("ter"))


def word_edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance over words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shift_edits(hyp: list[str], ref: list[str], max_size: int = 10, max_distance: int = 50) -> int:
    """Edits plus shifts: as long as moving a block that occurs in the reference lowers the distance."""
    shifts, cost = 0, word_edits(hyp, ref)
    while cost:
        best = None
        for i in range(len(hyp)):
            for n in range(1, min(max_size, len(hyp) - i) + 1):
                block = hyp[i:i + n]
                spots = [j for j in range(len(ref) - n + 1) if ref[j:j + n] == block and j != i and abs(j - i) <= max_distance]
                if not spots:
                    break
                rest = hyp[:i] + hyp[i + n:]
                for j in spots:
                    moved = rest[:j] + block + rest[j:]
                    c = word_edits(moved, ref)
                    if c < cost and (best is None or (c, -n) < best[0]):
                        best = ((c, -n), moved)
        if best is None:
            break
        hyp, cost, shifts = best[1], best[0][0], shifts + 1
    return cost + shifts


def corpus_chrf(df: DataFrame, pred: str, ref: str, key: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF: character n-gram F-score averaged over orders 1..6, white space removed."""
    from ..functions.text import PY_WS
    # stored, so that the cleaning is not done again for every position inside the lambdas below
    t = cut_lineage(df.select(key, *[F.regexp_replace(c, PY_WS, "").alias(a) for c, a in ((pred, "p"), (ref, "r"))]))

    def of_order(chars: Column, n: int) -> Column:
        one = lambda i: F.struct(F.lit(n).alias("n"), F.concat(*[F.get(chars, i + j) for j in range(n)]).alias("g"))
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), one)).otherwise(F.array().cast("array<struct<n:int,g:string>>"))

    def grams(side):
        return let(F.split(side, ""), lambda c: F.flatten(F.array(*[of_order(c, n) for n in range(1, order + 1)])))
    rows = t.select(key, F.explode(grams("p")).alias("x"), F.lit(1).alias("pc"), F.lit(0).alias("rc")).unionByName(
        t.select(key, F.explode(grams("r")).alias("x"), F.lit(0).alias("pc"), F.lit(1).alias("rc")))
    c = rows.groupBy(key, "x.n", "x.g").agg(F.sum("pc").alias("pc"), F.sum("rc").alias("rc"))
    per = c.groupBy("n").agg(F.sum(F.least("pc", "rc")).alias("h"), F.sum("pc").alias("p"), F.sum("rc").alias("r")).filter("p > 0 AND r > 0")
    avg = per.agg(F.avg(F.col("h") / F.col("p")).alias("prec"), F.avg(F.col("h") / F.col("r")).alias("rec"))
    b2 = beta * beta
    return avg.select(F.when(F.coalesce(F.col("prec") + F.col("rec"), F.lit(0.0)) == 0, 0.0).otherwise(
        100 * (1 + b2) * F.col("prec") * F.col("rec") / (b2 * F.col("prec") + F.col("rec"))).alias("chrf"))
