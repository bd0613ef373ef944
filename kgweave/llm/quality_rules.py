"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are fitted to a sample of labelled documents; every path from a root is a rule, a
conjunction of comparisons of statistics. Lasso logistic regression over the rules keeps a few, and these
become one Spark column expression: scoring a corpus is a projection without Python, joins or shuffles.

Only the fit is bounded: at most `SAMPLE` labelled rows, the first by hash of the id.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 20_000
TREES, DEPTH, LEAF = 30, 3, 20
LASSO = 0.002
THRESHOLD = 0.3
FEATURES = ["log_words", "word_length", "distinct", "distinct_share", "upper", "digits", "shouts", "marks", "bars", "stops", "commas",
            "brackets", "words_per_line"]


def statistics(text: str) -> dict[str, Column]:
    """Statistics of a text column, each a Spark expression over the whole text; 0 for empty texts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1))

    def of(marks: str) -> Column:
        left = t
        for m in marks:
            left = F.replace(left, F.lit(m), F.lit(""))
        return (F.length(t) - F.length(left)) / chars

    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.replace(t, F.lit(" "), F.lit(""))) / count,
        "distinct": F.size(F.array_distinct(words)) / F.sqrt(count.cast("double")),
        "distinct_share": F.size(F.array_distinct(words)) / count,
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / chars,
        "shouts": of("!"),
        "marks": of("*&#%$"),
        "bars": of("|"),
        "stops": of("."),
        "commas": of(","),
        "brackets": of("<>{}[]=/\\_"),
        "words_per_line": F.log1p(count / lines),
    }


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray):
    """Best (gain, feature, threshold) of a node by second-order gain over candidate quantiles."""
    best = (1e-6, -1, 0.0)
    total_g, total_h = g.sum(), h.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut >= LEAF - 1) & (cut < len(v) - LEAF)]
        if not len(cut):
            continue
        lg, lh = cg[cut], ch[cut]
        gain = lg ** 2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g ** 2 / (total_h + 1)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Distinct rules of boosted trees: tuples of (feature, is_above, threshold)."""
    rules: dict[tuple, None] = {}
    rng = np.random.default_rng(5)
    margin = np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        used = rng.random(len(y)) < 0.7
        nodes = [(np.ones(len(y), bool), ())]
        for depth in range(DEPTH + 1):
            below = []
            for inside, path in nodes:
                here = inside & used
                found = _split(x[here], g[here], h[here]) if depth < DEPTH and here.sum() >= 2 * LEAF else (0, -1, 0)
                if found[1] < 0:
                    margin[inside] += 0.3 * g[here].sum() / (h[here].sum() + 1)
                    continue
                _, f, at = found
                above = x[:, f] > at
                for side, rows in ((True, inside & above), (False, inside & ~above)):
                    step = path + ((f, side, round(at, 6)),)
                    rules[step] = None
                    below.append((rows, step))
            nodes = below
    return list(rules)


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, at in rule:
        out &= (x[:, f] > at) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, k = z.shape
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n) if k else 4.0
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y
        nw = vw - step * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleModel:
    rules: list[tuple]
    weights: list[float]
    intercept: float

    def expression(self, statistic: dict[str, Column]) -> Column:
        """The score as a Spark column over columns of statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            test = F.lit(True)
            for f, above, at in rule:
                c = statistic[FEATURES[f]]
                test = test & ((c > F.lit(at)) if above else (c <= F.lit(at)))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Without both classes in the sample the model is the class share alone."""
    if not len(y):
        return RuleModel([], [], 0.0)
    if y.min() == y.max():
        return RuleModel([], [], 4.0 if y[0] else -4.0)
    rules = grow_rules(x, y)
    z = np.stack([holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    w, b = lasso_logistic(z, y)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with one struct column ``_statistics``."""
    return docs.withColumn("_statistics", F.struct(*[c.cast("double").alias(n) for n, c in statistics(text).items()]))


def _columns() -> dict[str, Column]:
    return {n: F.col(f"_statistics.{n}") for n in FEATURES}


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Fit on labelled rows that are not held out. ``rows`` has doc_id and _statistics; labels that are null
    or not 0 or 1 are left out, and of several labels of one document the smallest counts."""
    marked = (labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    got = (rows.select("doc_id", "_statistics.*").join(marked, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas())
    return fit(got[FEATURES].to_numpy(float), got["y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Inputs of the score are statistics of the whole text alone. Null and empty texts get the score of zero
    statistics. Rows are independent of each other, so repeated rows get equal scores; a null doc_id is
    scored and not held out. Other columns are ignored; an empty table gives an empty table.
    """
    from .common import save

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    measured = save(with_statistics(rows).drop("text"), "statistics")
    score = train(measured, labels).expression(_columns())
    return measured.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns unchanged, that the classifier does not reject."""
    from .common import save

    names = docs.columns
    model = train(save(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        labels.select("doc_id").distinct(), "doc_id", "left_semi")).drop("text"), "statistics"), labels)
    return with_statistics(docs).where(model.expression(_columns()) >= THRESHOLD).select(*names)
