"""Array and vector expressions: n-grams, token windows, soft-max, similarity, token overlap."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import _col, tokens

EPS = 1e-12


def let(value, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Catalyst may inline a projected expression into a lambda, where it would be evaluated again
    for every element; a lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def ngrams(words, n: int) -> Column:
    """All runs of ``n`` consecutive elements of a token array (none when it is shorter)."""
    return let(words, lambda w: F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n)),
    ).otherwise(F.array().cast("array<array<string>>")))


def word_ngrams(text, n: int) -> Column:
    return F.transform(ngrams(tokens(text), n), lambda g: F.array_join(g, " "))


def word_spans(text) -> Column:
    """Words with inclusive character offsets. A growing array in a column expression would be
    copied for every word; a scan in an Arrow batch is linear."""
    @F.pandas_udf("array<struct<w:string,s:int,e:int>>")
    def spans(t: pd.Series) -> pd.Series:
        import re
        word = re.compile(r"\S+")
        return t.map(lambda x: [(m.group(), m.start(), m.end() - 1) for m in word.finditer(x or "")])
    return spans(_col(text))


def word_ngrams_with_offsets(text, n: int) -> Column:
    """Word n-grams with inclusive character offsets (start, end) in the original text."""
    return let(word_spans(text), lambda w: F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)),
        lambda i: F.struct(
            F.array_join(F.transform(F.slice(w, i, n), lambda x: x["w"]), " ").alias("ngram"),
            F.get(w, i - 1)["s"].alias("start"),
            F.get(w, i + n - 2)["e"].alias("end")),
    )).otherwise(F.array().cast("array<struct<ngram:string,start:int,end:int>>")))


def rolling_windows(token_array, prefix, max_len: int, context_len: int) -> Column:
    """Windows (context, predicted) that score every token exactly once.

    The first window predicts up to ``max_len`` tokens behind ``prefix``; each later one predicts
    ``max_len - context_len + 1`` more, seeing the ``max_len`` tokens before its last position.
    """
    if not 1 <= context_len <= max_len:
        raise ValueError("context_len must lie between 1 and max_len")
    step = max_len - context_len + 1

    def windows(t):
        n = F.size(t)
        more = F.greatest(F.ceil((n - max_len) / step).cast("int"), F.lit(0))

        def window(k):
            end = F.least(n, max_len + k * step)
            done = F.when(k == 0, F.lit(0)).otherwise(max_len + (k - 1) * step)
            lo = F.greatest(end - max_len, F.lit(0))
            # the token before t[i] is t[i-1], or the prefix for i = 0
            context = F.when(lo == 0, F.concat(F.array(prefix), F.slice(t, 1, end - 1))).otherwise(
                F.slice(t, lo, end - lo))
            return F.struct(context.alias("context"), F.slice(t, done + 1, end - done).alias("predicted"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), more), window)).otherwise(
            F.array().cast("array<struct<context:array<bigint>,predicted:array<bigint>>>"))
    return let(token_array, windows)


def disjoint_window(context, predicted) -> Column:
    """Shorten the context so that it no longer overlaps the predicted tokens."""
    c, p = _col(context), _col(predicted)
    return F.slice(c, 1, F.size(c) - (F.size(p) - 1))


def softmax(c) -> Column:
    def scaled(x):
        return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(let(c, scaled), lambda e: let(
        F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))


def argmax(c) -> Column:
    """0-based position of the maximum, the first one on ties."""
    x = _col(c)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """NULL when either vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a) -> Column:
    """Zero vectors stay zero: the length is floored at a tiny constant."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(EPS)), lambda length: F.transform(
        v, lambda x: (x.cast("double") / length).cast("float"))))


def parse_vector(c) -> Column:
    """Embedding stored as a list literal in text."""
    return F.from_json(_col(c), "array<float>")


def common_tokens(a, b) -> Column:
    """Size of the multiset intersection of two short token arrays."""
    def both(x, y):
        return F.aggregate(
            F.array_distinct(x), F.lit(0),
            lambda s, t: s + F.least(F.size(F.filter(x, lambda v: v == t)),
                                     F.size(F.filter(y, lambda v: v == t))))
    return let(a, lambda x: let(b, lambda y: both(x, y)))


def token_f1(pred, gold) -> Column:
    """F1 over token multisets; 0 without overlap, even for two empty answers."""
    p, g = _col(pred), _col(gold)
    same = common_tokens(p, g).cast("double")
    return let(same, lambda s: F.when(s == 0, F.lit(0.0)).otherwise(
        2 * (s / F.size(p)) * (s / F.size(g)) / (s / F.size(p) + s / F.size(g))))


def recall_at(retrieved, gold, k: int) -> Column:
    """Share of gold strings contained in one of the first ``k`` retrieved texts; 0 without gold."""
    r, g = F.slice(_col(retrieved), 1, k), _col(gold)
    hits = F.size(F.filter(g, lambda x: F.exists(r, lambda t: F.contains(t, x))))
    return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(hits / F.size(g))


def brier(probabilities, gold) -> Column:
    """Squared distance between a probability vector and the one-hot gold class."""
    p = _col(probabilities)
    return F.aggregate(
        F.transform(p, lambda x, i: F.pow(x - F.when(i == _col(gold), 1.0).otherwise(0.0), F.lit(2.0))),
        F.lit(0.0), lambda s, v: s + v)


def has_intersection(words, text, substring: bool = False) -> Column:
    """Word overlap of a set with a name, or substring-any when ``substring``."""
    if substring:
        return F.exists(_col(words), lambda p: F.contains(_col(text), p))
    return F.arrays_overlap(_col(words), tokens(_col(text)))


def validate_keys(required: list[str], present) -> Column:
    """Required keys that an output object lacks."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), _col(present))
