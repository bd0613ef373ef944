"""Answer scoring, harness metrics and n-gram contamination over the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A, templates, text as T
from ..operators import contamination as D, metrics as M, quality as Q, shaping as S
from ..session import dense_index
from .base import documents, query, sq, table, words

PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
NORM = sq("regexp_replace(replace(lower({x}), '-', ' '), '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')").replace(
    T.PY_WS, T.PY_WS.replace("{", "{{").replace("}", "}}"))


def norm_sql(x: str) -> str:
    """SQL of the answer normalisation."""
    return NORM.format(x=x)


# ---- answers: each assistant turn answers the user turn before it ----------------------------------------

PAIRS = """
pairs AS (SELECT a.conv_id, a.turn, a.text AS pred, u.text AS gold FROM conversations a JOIN conversations u
          ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
"""


def pairs(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred")).join(u, ["conv_id", "turn"])


F1_SQL = "WITH" + PAIRS + f"""
tk AS (SELECT conv_id, turn, list_filter(string_split({norm_sql('pred')}, ' '), lambda w: w <> '') AS p,
              list_filter(string_split({norm_sql('gold')}, ' '), lambda w: w <> '') AS g FROM pairs),
pc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS w FROM tk) GROUP BY ALL),
gc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS w FROM tk) GROUP BY ALL),
sm AS (SELECT conv_id, turn, sum(least(pc.c, gc.c)) AS s FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, CAST(p = g AS INTEGER) AS em,
       coalesce(round(2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)), 9), 0.0) AS f1
FROM tk LEFT JOIN sm USING (conv_id, turn)"""


@query("q_token_f1", F1_SQL)
def token_f1(spark, d):
    return Q.judge(pairs(spark, d), "pred", "gold").select("conv_id", "turn", "em", F.round("f1", 9).alias("f1"))


@query("q_token_f1_long", F1_SQL.replace("CAST(p = g AS INTEGER) AS em,", ""))
def token_f1_long(spark, d):
    t = pairs(spark, d).select(F.struct("conv_id", "turn").alias("k"), T.tokens(T.normalize_answer("pred")).alias("p"), T.tokens(T.normalize_answer("gold")).alias("g"))
    out = Q.token_f1_long(t.select("k", F.col("p").alias("tokens")), t.select("k", F.col("g").alias("tokens")), "k")
    return out.select("k.conv_id", "k.turn", F.round("f1", 9).alias("f1"))


@query("q_exact_match", f"""
WITH n AS (SELECT doc_id, lang, {norm_sql('text')} AS t FROM documents), b AS (SELECT DISTINCT {norm_sql('text')} AS t FROM benchmark)
SELECT lang, count(*) FILTER (t IN (SELECT t FROM b)) AS n_equal, count(*) AS n_docs FROM n GROUP BY lang""")
def exact_match(spark, d):
    n = documents(spark, d).select("lang", T.sha_id(T.normalize_answer("text")).alias("h"))
    b = table(spark, d, "benchmark").select(T.sha_id(T.normalize_answer("text")).alias("h")).distinct().withColumn("hit", F.lit(1))
    return n.join(b, "h", "left").groupBy("lang").agg(F.count("hit").alias("n_equal"), F.count("*").alias("n_docs"))


RECALL_SQL = """
WITH r AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS retrieved,
                  flatten(list(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''))) AS gold FROM conversations GROUP BY conv_id)
"""


@query("q_recall_at_k", RECALL_SQL + """
SELECT conv_id, list_count(list_filter(gold, lambda g: len(list_filter(retrieved[1:2], lambda t: contains(t, g))) > 0)) / len(gold) AS recall_at_2,
       list_count(list_filter(gold, lambda g: len(list_filter(retrieved[1:5], lambda t: contains(t, g))) > 0)) / len(gold) AS recall_at_5 FROM r""")
def recall_at_k(spark, d):
    from pyspark.sql import Window as W
    c = table(spark, d, "conversations")
    gold = c.select("conv_id", F.explode(F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: x != "")).alias("gold"))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    found = c.filter("role = 'assistant'").withColumn("rank", rank).filter("rank <= 5").select("conv_id", "rank", "text")
    return Q.recall_long(gold, found, "conv_id")


@query("q_retriever_summary", "WITH s AS (" + F1_SQL.split("SELECT conv_id, turn, CAST")[0].replace("WITH", "WITH ", 1) + """SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS retriever,
  CAST(p = g AS INTEGER) AS em, coalesce(2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)), 0.0) AS f1 FROM tk LEFT JOIN sm USING (conv_id, turn))
SELECT retriever, 'em' AS metric, avg(em) AS value FROM s GROUP BY retriever UNION ALL SELECT retriever, 'f1', avg(f1) FROM s GROUP BY retriever""")
def retriever_summary(spark, d):
    j = Q.judge(pairs(spark, d), "pred", "gold").withColumn("retriever", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    long = j.select(F.struct("conv_id", "turn").alias("sample_id"), "retriever", F.explode(F.array(
        F.struct(F.lit("em").alias("metric"), F.col("em").cast("double").alias("value")), F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value")))).alias("m"))
    return Q.retriever_summary(long.select("sample_id", "retriever", "m.*"))


# ---- label based metrics: labels against a length rule of the documents -------------------------------------

LABELLED = """
lab AS (SELECT doc_id, lang, source, quality AS gold, CAST(n_chars > 900 AS INTEGER) AS pred, toxic, n_chars FROM labels JOIN documents USING (doc_id))
"""


def labelled(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").join(doc, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("gold"), (F.col("n_chars") > 900).cast("int").alias("pred"), "toxic", "n_chars")


@query("q_confusion_rollup", "WITH" + LABELLED + """,
c AS (SELECT coalesce(lang, 'ALL') AS domain, count(*) FILTER (pred = 1 AND gold = 1) AS tp, count(*) FILTER (pred = 0 AND gold = 0) AS tn,
  count(*) FILTER (pred = 1 AND gold = 0) AS fp, count(*) FILTER (pred = 0 AND gold = 1) AS fn FROM lab GROUP BY ROLLUP (lang)),
r AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr, tn / nullif(tn + fn, 0) AS p FROM c)
SELECT domain, tp, tn, fp, fn, tpr, tnr, 0.5 * (tpr + tnr) AS balanced, p, tnr AS r, 2 * tnr * p / nullif(tnr + p, 0) AS f1 FROM r""")
def confusion_rollup(spark, d):
    return Q.confusion_scores(labelled(spark, d).withColumnRenamed("lang", "domain"), label="gold")


@query("q_majority_vote", """
SELECT user_id, event_type AS winner, votes FROM (
  SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1""")
def majority_vote(spark, d):
    return M.vote_long(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("q_prf_counts", """
WITH c AS (SELECT l_suppkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_incorrect, count(*) FILTER (l_linestatus = 'O') AS n_more FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, round((n - n_incorrect) / n, 4) AS precision, round((n - n_incorrect) / (n - n_incorrect + n_more), 4) AS recall FROM c)
SELECT id, precision, recall, round(2 * precision * recall / (precision + recall), 4) AS f1 FROM r WHERE n > n_incorrect""")
def prf_counts(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_incorrect"), F.count_if(F.col("l_linestatus") == "O").alias("n_more"))
    return Q.count_scores(c).filter("precision IS NOT NULL").select("id", "precision", "recall", "f1")


@query("q_mcq_accuracy", """
SELECT role, avg(CAST(upper(regexp_extract(text, '[a-dA-D]', 0)) = chr(CAST(65 + conv_id % 4 AS INTEGER)) AS INTEGER)) AS accuracy, count(*) AS n FROM conversations GROUP BY role""")
def mcq_accuracy(spark, d):
    c = table(spark, d, "conversations").withColumn("gold", F.char(F.lit(65) + F.col("conv_id") % 4))
    return Q.choice_accuracy(c, ["role"], "text", "gold")


@query("q_category_macro", "WITH" + LABELLED + """,
s AS (SELECT source AS subject, min(lang) AS category, avg(CAST(gold = pred AS INTEGER)) AS accuracy FROM lab GROUP BY source)
SELECT coalesce(category, 'ALL') AS category, 100 * avg(accuracy) AS score FROM s GROUP BY ROLLUP (category)""")
def category_macro(spark, d):
    s = labelled(spark, d).groupBy(F.col("source").alias("subject")).agg(F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("accuracy"), F.min("lang").alias("category"))
    return Q.category_accuracy(s.select("subject", "accuracy"), s.select("subject", "category"))


@query("q_success_rates", """
SELECT event_type AS method, count(*) FILTER (value > 10) AS ok, count(*) FILTER (NOT value > 10) AS failed, avg(CAST(value > 10 AS INTEGER)) AS rate FROM events GROUP BY event_type""")
def success_rates(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), F.when(F.col("value") > 10, F.array("value")).otherwise(F.array().cast("array<double>")).alias("results"))
    return Q.success_rates(e)


@query("q_typed_entities", """
SELECT n_name AS entity, n_regionkey AS type FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def typed_entities(spark, d):
    n = table(spark, d, "nation")
    used = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    t = used.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("h")), "k").select("h", F.col("h").alias("t"))
    return Q.typed_entities(n.select(F.col("n_name").alias("entity"), F.col("n_regionkey").alias("type")), t)


# ---- harness aggregations -------------------------------------------------------------------------------------

@query("q_weighted_mean", """
SELECT l_returnflag AS task, avg(l_discount) AS mean, exp(-avg(l_discount)) AS perplexity, sum(l_extendedprice) / sum(l_quantity) AS weighted_mean,
       -(sum(l_discount) / sum(l_quantity)) / ln(2) AS bits_per_byte, exp(-(sum(l_discount) / sum(l_quantity))) AS weighted_perplexity,
       stddev_samp(l_discount) AS sd, stddev_samp(l_discount) / sqrt(count(*)) AS stderr, stddev_pop(l_discount) AS population_sd, 999 AS bypass FROM lineitem GROUP BY 1""")
def weighted_mean(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "task")
    return M.group_by(li, ["task"], mean=M.mean("l_discount"), perplexity=M.perplexity("l_discount"), weighted_mean=M.weighted_mean("l_extendedprice", "l_quantity"),
                      bits_per_byte=M.bits_per_byte("l_discount", "l_quantity"), weighted_perplexity=M.weighted_perplexity("l_discount", "l_quantity"),
                      sd=M.sample_stddev("l_discount"), stderr=M.mean_stderr("l_discount"), population_sd=M.population_stddev("l_discount"), bypass=M.bypass())


@query("q_positional_median", """
SELECT value AS median FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos = (SELECT count(*) // 2 FROM events)""")
def positional_median(spark, d):
    return M.positional_median(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"])


@query("q_classification", "WITH" + LABELLED + """,
c AS (SELECT lang, gold, pred, count(*) AS n FROM lab GROUP BY ALL),
k AS (SELECT lang, cls, sum(n) FILTER (gold = cls) AS support, sum(n) FILTER (pred = cls) AS predicted, coalesce(sum(n) FILTER (gold = cls AND pred = cls), 0) AS correct
      FROM (SELECT c.*, unnest([0, 1]) AS cls FROM c) GROUP BY lang, cls),
s AS (SELECT lang, cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, correct, coalesce(2.0 * correct / nullif(coalesce(support, 0) + coalesce(predicted, 0), 0), 0) AS f1 FROM k),
m AS (SELECT lang, sum(correct) AS cc, sum(support) AS nn, sum(support * predicted) AS pt, sum(predicted * predicted) AS pp, sum(support * support) AS tt,
      sum(f1 * support) / sum(support) AS weighted_f1, max(f1) FILTER (cls = 1) AS f1 FROM s GROUP BY lang)
SELECT lang, f1, weighted_f1, CASE WHEN (nn * nn - pp) * (nn * nn - tt) = 0 THEN 0.0 ELSE (cc * nn - pt) / sqrt(CAST(nn * nn - pp AS DOUBLE) * CAST(nn * nn - tt AS DOUBLE)) END AS mcc FROM m""")
def classification(spark, d):
    lab = labelled(spark, d)
    f1 = lab.groupBy("lang").agg(M.binary_f1("gold", "pred").alias("f1"))
    return f1.join(M.weighted_f1(lab, ["lang"], "gold", "pred"), "lang").join(M.matthews(lab, ["lang"], "gold", "pred"), "lang")


CHOICES = """
ch AS (SELECT l_orderkey AS id, l_linenumber AS line, [l_discount - 1, l_tax - 1, -l_quantity / 50] AS lls, [l_tax - 2, l_discount - 1, -1.0] AS unc,
  ['aa', l_returnflag || 'bcd', 'e' || l_linestatus] AS choices, CAST(l_partkey % 3 AS INTEGER) AS gold, l_suppkey AS task FROM lineitem)
"""


def choice_rows(spark, d):
    li = table(spark, d, "lineitem")
    c = F.col
    return li.select(c("l_suppkey").alias("task"), F.array(c("l_discount") - 1, c("l_tax") - 1, -c("l_quantity") / 50).alias("lls"),
                     F.array(c("l_tax") - 2, c("l_discount") - 1, F.lit(-1.0)).alias("unc"),
                     F.array(F.lit("aa"), F.concat("l_returnflag", F.lit("bcd")), F.concat(F.lit("e"), "l_linestatus")).alias("choices"),
                     (c("l_partkey") % 3).cast("int").alias("gold"))


@query("q_choice_metrics", "WITH" + CHOICES + """
SELECT task, avg(CAST(list_position(lls, list_max(lls)) - 1 = gold AS INTEGER)) AS acc,
       avg(CAST(list_position([lls[1] / 2, lls[2] / 4, lls[3] / 2], list_max([lls[1] / 2, lls[2] / 4, lls[3] / 2])) - 1 = gold AS INTEGER)) AS acc_norm,
       avg(CAST(list_position([lls[1] - unc[1], lls[2] - unc[2], lls[3] - unc[3]], list_max([lls[1] - unc[1], lls[2] - unc[2], lls[3] - unc[3]])) - 1 = gold AS INTEGER)) AS acc_mutual_info
FROM ch GROUP BY task""")
def choice_metrics(spark, d):
    return M.group_by(choice_rows(spark, d), ["task"], acc=F.avg(M.acc("lls", "gold")), acc_norm=F.avg(M.acc_norm("lls", "choices", "gold")),
                      acc_mutual_info=F.avg(M.acc_mutual_info("lls", "unc", "gold")))


@query("q_brier", "WITH" + CHOICES + """,
sm AS (SELECT task, gold, list_transform(lls, lambda x: exp(x - list_max(lls))) AS e FROM ch)
SELECT task, round(avg(list_sum(list_transform([0, 1, 2], lambda i: pow(e[i + 1] / list_sum(e) - CASE WHEN i = gold THEN 1 ELSE 0 END, 2)))), 9) AS brier FROM sm GROUP BY task""")
def brier(spark, d):
    return choice_rows(spark, d).withColumn("p", A.softmax("lls")).groupBy("task").agg(F.round(F.avg(A.brier("p", "gold")), 9).alias("brier"))


@query("q_text_units", f"""
SELECT lang, sum(len(regexp_split_to_array(text, '{T.PY_WS}+'))) AS n_words, sum(strlen(text)) AS n_bytes FROM documents GROUP BY lang""")
def text_units(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(T.word_count("text")).alias("n_words"), F.sum(T.utf8_bytes("text").cast("bigint")).alias("n_bytes"))


@query("q_acc_all", """
WITH i AS (SELECT l_orderkey AS paragraph, l_suppkey AS question, CAST(l_tax > 0.02 AS INTEGER) AS pred, CAST(l_discount > 0.01 AS INTEGER) AS gold FROM lineitem),
q AS (SELECT bool_and(pred = gold) AS ok FROM i GROUP BY paragraph, question), e AS (SELECT CAST(bool_and(pred = gold) AS INTEGER) AS ok FROM i GROUP BY question)
SELECT (SELECT avg(CAST(ok AS INTEGER)) FROM q) AS acc_all, (SELECT stddev_samp(ok) / sqrt(count(ok)) FROM e) AS acc_all_stderr""")
def acc_all(spark, d):
    li = table(spark, d, "lineitem")
    return M.acc_all(li.select(F.col("l_orderkey").alias("paragraph"), F.col("l_suppkey").alias("question"),
                               (F.col("l_tax") > 0.02).cast("int").alias("pred"), (F.col("l_discount") > 0.01).cast("int").alias("gold")))


@query("q_max_over_golds", """
SELECT conv_id, CAST(max(CAST(left(text, 1) = 'T' AS DOUBLE)) AS DOUBLE) AS best FROM conversations GROUP BY conv_id""")
def max_over_golds(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(M.exact_match(F.lit("T"), F.substring("text", 1, 1))).alias("best"))


@query("q_best_of_golds", "WITH" + PAIRS + """
a AS (SELECT conv_id, turn, lower(left(pred, 1)) AS p, [lower(left(gold, 1)), lower(right(gold, 1)), chr((97 + conv_id % 26)::INT)] AS golds FROM pairs)
SELECT conv_id, turn, list_max(list_transform(golds, lambda g: CAST(g = p AS DOUBLE))) AS best FROM a""")
def best_of_golds(spark, d):
    """Exact match of an answer's first letter against the best of three accepted ones."""
    p = pairs(spark, d)
    golds = F.array(F.lower(F.substring("gold", 1, 1)), F.lower(F.right("gold", F.lit(1))), F.chr((97 + F.col("conv_id") % 26).cast("long")))
    a = p.select("conv_id", "turn", F.lower(F.substring("pred", 1, 1)).alias("p"), golds.alias("golds"))
    return a.select("conv_id", "turn", M.max_over_golds("p", "golds", M.exact_match).cast("double").alias("best"))


TASKS = """
res AS (SELECT CAST(s_nationkey AS VARCHAR) AS task, 'acc' AS metric, avg(s_acctbal) AS value, stddev_samp(s_acctbal) / sqrt(count(*)) AS stderr, count(*) AS size FROM supplier GROUP BY s_nationkey)
"""


def task_results(spark, d):
    s = table(spark, d, "supplier")
    return s.groupBy(F.col("s_nationkey").cast("string").alias("task")).agg(F.avg("s_acctbal").alias("value"), M.mean_stderr("s_acctbal").alias("stderr"), F.count("*").alias("size")).withColumn("metric", F.lit("acc"))


@query("q_group_rollup", "WITH" + TASKS + """,
cl AS (SELECT r_name AS grp, CAST(n_nationkey AS VARCHAR) AS task FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'WORLD', CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT grp, metric, round(sum(value * size) / sum(size), 6) AS value,
       CASE WHEN count(stderr) = count(*) THEN round(sqrt(sum((size - 1) * stderr * stderr * size) / (sum(size) - count(*)) / sum(size)), 6) END AS stderr, CAST(sum(size) AS BIGINT) AS size
FROM cl JOIN res USING (task) GROUP BY grp, metric""")
def group_rollup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    members = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("grp"), F.col("n_nationkey").cast("string").alias("member")).unionByName(
        r.select(F.lit("WORLD").alias("grp"), F.col("r_name").alias("member")))
    out = M.roll_up(task_results(spark, d), M.group_closure(members))
    return out.withColumn("value", F.round("value", 6)).withColumn("stderr", F.round("stderr", 6))


@query("q_pooled_stderr", "WITH" + TASKS + """
SELECT round(sqrt(sum((size - 1) * stderr * stderr * size) / (sum(size) - count(*)) / sum(size)), 6) AS pooled, round(avg(value), 6) AS unweighted FROM res WHERE stderr IS NOT NULL""")
def pooled_stderr(spark, d):
    r = task_results(spark, d).filter("stderr IS NOT NULL")
    return r.agg(F.round(M.pooled_stderr("stderr", "size"), 6).alias("pooled"), F.round(M.size_weighted_mean("value", "size", False), 6).alias("unweighted"))


@query("q_run_comparison", """
WITH a AS (SELECT l_shipdate, l_returnflag, l_linestatus, l_discount FROM lineitem),
x AS (SELECT l_returnflag AS task, avg(l_discount) AS v, stddev_samp(l_discount) / sqrt(count(*)) AS e FROM a WHERE l_linestatus = 'F' GROUP BY 1),
y AS (SELECT l_returnflag AS task, avg(l_discount) AS v, stddev_samp(l_discount) / sqrt(count(*)) AS e FROM a WHERE l_linestatus = 'O' GROUP BY 1)
SELECT task, x.v AS before, y.v AS after, y.v - x.v AS change, round((x.v - y.v) / sqrt(x.e * x.e + y.e * y.e), 6) AS z FROM x JOIN y USING (task)""")
def run_comparison(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "task")
    run = lambda s: li.filter(F.col("l_linestatus") == s).groupBy("task").agg(F.avg("l_discount").alias("value"), M.mean_stderr("l_discount").alias("e"))
    x, y = run("F"), run("O")
    z = x.withColumnRenamed("value", "v1").withColumnRenamed("e", "e1").join(y.withColumnRenamed("value", "v2").withColumnRenamed("e", "e2"), "task").select(
        "task", F.round(M.z_test("v1", "v2", "e1", "e2"), 6).alias("z"))
    return M.compare_runs(x, y, ["task"]).join(z, "task")


@query("q_bootstrap_stderr", """
WITH h AS (SELECT event_id, value, k, md5('42:' || event_id || ':' || k) AS h FROM (SELECT event_id, value, unnest(range(63)) AS k FROM events)),
y AS (SELECT value, k * 16 + j AS iteration, ('0x' || substring(h, 2 * j + 1, 2))::INT AS v FROM (SELECT value, k, h, unnest(range(16)) AS j FROM h)),
w AS (SELECT value, iteration, CASE WHEN v < 94 THEN 0 WHEN v < 188 THEN 1 WHEN v < 235 THEN 2 WHEN v < 251 THEN 3 WHEN v < 255 THEN 4 ELSE 5 END AS m FROM y WHERE iteration < 1000),
s AS (SELECT iteration, sum(m * value) / sum(m) AS mean FROM w GROUP BY iteration)
SELECT round(stddev_samp(mean), 8) AS stderr FROM s""")
def bootstrap_stderr(spark, d):
    """Standard error of the mean over all events, from 1,000 resamples."""
    sums = M.resampled(table(spark, d, "events").select("event_id", "value", F.lit(1).alias("n")), "event_id", ["value", "n"])
    return M.resampled_stderr(sums, {"mean": F.col("value") / F.col("n")}).select(F.round("stderr", 8).alias("stderr"))


@query("q_few_shot")
def few_shot(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return M.few_shot(docs, docs, "doc_id", 3)


@query("q_bootstrap_metrics", """
WITH d AS MATERIALIZED (SELECT doc_id, (lang = 'en') AS g, (n_chars % 2 = 0) AS p, -ln(1 + length(text)) AS ll, strlen(text)::DOUBLE AS b FROM documents),
h AS (SELECT doc_id, k, md5('42:' || doc_id || ':' || k) AS h FROM (SELECT doc_id, unnest(range(63)) AS k FROM d)),
y AS (SELECT doc_id, k * 16 + j AS iteration, ('0x' || substring(h, 2 * j + 1, 2))::INT AS v FROM (SELECT doc_id, k, h, unnest(range(16)) AS j FROM h)),
w AS (SELECT doc_id, iteration, CASE WHEN v < 94 THEN 0 WHEN v < 188 THEN 1 WHEN v < 235 THEN 2 WHEN v < 251 THEN 3 WHEN v < 255 THEN 4 ELSE 5 END AS m FROM y WHERE iteration < 1000),
s AS (SELECT iteration, sum(m * (g AND p)::INT)::DOUBLE AS tp, sum(m * (p AND NOT g)::INT)::DOUBLE AS fp, sum(m * (g AND NOT p)::INT)::DOUBLE AS fn,
  sum(m * (NOT g AND NOT p)::INT)::DOUBLE AS tn, sum(m * ll) AS ll, sum(m * b) AS b FROM w JOIN d USING (doc_id) GROUP BY iteration),
x AS (SELECT 'f1' AS metric, 2 * tp / (2 * tp + fp + fn) AS v FROM s UNION ALL SELECT 'mcc', (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) FROM s
  UNION ALL SELECT 'byte_perplexity', exp(-ll / b) FROM s)
SELECT metric, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS stderr FROM x GROUP BY metric""")
def bootstrap_metrics(spark, d):
    """Standard errors of f1, mcc and byte perplexity over all documents, from 1,000 resamples of their sums."""
    g, p = F.col("lang") == "en", F.col("n_chars") % 2 == 0
    r = documents(spark, d).select("doc_id", *[c.cast("int").alias(n) for n, c in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p))],
                                   (-F.log(F.length("text") + F.lit(1))).alias("ll"), T.utf8_bytes("text").cast("double").alias("b"))
    sums = M.resampled(r, "doc_id", ["tp", "fp", "fn", "tn", "ll", "b"])
    out = M.resampled_stderr(sums, {**M.confusion_metrics(), "byte_perplexity": F.exp(-F.col("ll") / F.col("b"))})
    return out.select("metric", F.round("mean", 8).alias("mean"), F.round("stderr", 8).alias("stderr"))


# two tasks' prompts as templates
SUMMARY_TASK = """{% if lang == 'en' %}Read the text{% elif lang == 'de' %}Lies den Text{% else %}Text ({{ lang|upper }}){% endif %} {{ doc_id }}{% if n_chars > 500 and source != 'web' %} (long){% endif %}:
{{ text|trim }}
{%- if not lang in ['en'] %}
Language: {{ lang|capitalize }}
{%- endif %}
Answer:
"""
WORDS_TASK = """Item {{ item.id }}, {{ words|length }} words:
{% for w in words %}{{ loop.index }}/{{ w|lower }}{% if not loop.last %}, {% endif %}{% endfor %}
First: {{ words[0]|default('none') }}"""


@query("q_template_prompts", f"""
SELECT 'summary' AS task, doc_id AS id, sha256(CASE lang WHEN 'en' THEN 'Read the text' WHEN 'de' THEN 'Lies den Text' ELSE 'Text (' || coalesce(upper(lang), 'None') || ')' END || ' ' || doc_id
  || CASE WHEN n_chars > 500 AND source IS DISTINCT FROM 'web' THEN ' (long)' ELSE '' END || E':\n' || regexp_replace(text, '^{T.PY_WS}+|{T.PY_WS}+$', '', 'g')
  || CASE WHEN coalesce(lang = 'en', false) THEN '' ELSE E'\nLanguage: ' || upper(lang[1]) || lower(lang[2:]) END || E'\nAnswer:') AS prompt_sha FROM documents
UNION ALL
SELECT 'words', item_id, sha256('Item ' || item_id || ', ' || len(w) || E' words:\n' || array_to_string(list_transform(w, lambda x, i: i || '/' || lower(x)), ', ') || E'\nFirst: ' || coalesce(w[1], 'none'))
FROM (SELECT item_id, {words('text')} AS w FROM benchmark)""")
def template_prompts(spark, d):
    a = table(spark, d, "documents").select(F.lit("summary").alias("task"), F.col("doc_id").alias("id"), templates.parse(SUMMARY_TASK).column().alias("prompt"))
    b = table(spark, d, "benchmark").select(F.struct(F.col("item_id").alias("id")).alias("item"), T.tokens("text").alias("words"))
    b = templates.parse(WORDS_TASK).render(b, "prompt").select(F.lit("words").alias("task"), F.col("item.id").alias("id"), "prompt")
    return a.unionByName(b).select("task", "id", F.sha2("prompt", 256).alias("prompt_sha"))


def tokens_13a_sql(text: str) -> str:
    out = f"rtrim({text})"
    for old, new in M.TOKENS_13A[:7]:
        out = "replace(" + out + ", '" + old.replace("\n", "' || chr(10) || '") + "', '" + new + "')"
    out = f"' ' || {out} || ' '"
    for old, new in M.TOKENS_13A[7:]:
        out = "regexp_replace(" + out + ", '" + old + "', '" + new.replace("$", "\\") + "', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda w: w <> '')"


# predictions against the question itself and the conversation's first question
_BLEU_SQL = "WITH" + PAIRS + f"""
two AS (SELECT conv_id, turn, pred, gold, min_by(gold, turn) OVER (PARTITION BY conv_id) AS other FROM pairs),
tk AS MATERIALIZED (SELECT row_number() OVER () AS k, {tokens_13a_sql('pred')} AS p, {tokens_13a_sql('gold')} AS a, {tokens_13a_sql('other')} AS b FROM two),
nn AS (SELECT unnest([1, 2, 3, 4]) AS n),
gp AS (SELECT k, n, array_to_string(p[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT k, n, p, unnest(range(1, len(p) - n + 2)) AS i FROM tk, nn) GROUP BY ALL),
ga AS (SELECT k, n, array_to_string(a[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT k, n, a, unnest(range(1, len(a) - n + 2)) AS i FROM tk, nn) GROUP BY ALL),
gb AS (SELECT k, n, array_to_string(b[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT k, n, b, unnest(range(1, len(b) - n + 2)) AS i FROM tk, nn) GROUP BY ALL),
h AS (SELECT n, sum(least(gp.c, greatest(coalesce(ga.c, 0), coalesce(gb.c, 0)))) AS hit, sum(gp.c) AS total FROM gp LEFT JOIN ga USING (k, n, g) LEFT JOIN gb USING (k, n, g) GROUP BY n),
sh AS (SELECT n, CASE WHEN hit > 0 THEN hit ELSE pow(2.0, -sum((hit = 0)::INT) OVER (ORDER BY n)) END / total AS share FROM h),
ln AS (SELECT sum(len(p)) AS pl, sum(CASE WHEN (abs(len(a) - len(p)), len(a)) <= (abs(len(b) - len(p)), len(b)) THEN len(a) ELSE len(b) END) AS rl FROM tk),
cs AS MATERIALIZED (SELECT row_number() OVER () AS k, regexp_replace(pred, '{T.PY_WS}', '', 'g') AS p, regexp_replace(gold, '{T.PY_WS}', '', 'g') AS r FROM pairs),
n6 AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n),
cp AS (SELECT k, n, substring(p, i, n) AS g, count(*) AS c FROM (SELECT k, n, p, unnest(range(1, length(p) - n + 2)) AS i FROM cs, n6) GROUP BY ALL),
cr AS (SELECT k, n, substring(r, i, n) AS g, count(*) AS c FROM (SELECT k, n, r, unnest(range(1, length(r) - n + 2)) AS i FROM cs, n6) GROUP BY ALL),
pn AS (SELECT n, sum(c) AS p FROM cp GROUP BY n), rn AS (SELECT n, sum(c) AS r FROM cr GROUP BY n),
hn AS (SELECT n, sum(least(cp.c, cr.c)) AS h FROM cp JOIN cr USING (k, n, g) GROUP BY n),
av AS (SELECT avg(coalesce(h, 0) / p) AS ap, avg(coalesce(h, 0) / r) AS ar FROM pn JOIN rn USING (n) LEFT JOIN hn USING (n))
SELECT 'bleu' AS metric, round((SELECT 100 * CASE WHEN pl >= rl THEN 1.0 ELSE exp(1 - rl / pl) END FROM ln) * (SELECT exp(avg(ln(share))) FROM sh), 8) AS value
UNION ALL SELECT 'chrf', round(100 * 5 * ap * ar / (4 * ap + ar), 8) FROM av"""


@query("q_bleu_chrf", _BLEU_SQL)
def bleu_chrf(spark, d):
    p = pairs(spark, d).withColumn("k", F.struct("conv_id", "turn"))
    other = p.groupBy("conv_id").agg(F.min_by("gold", "turn").alias("other"))
    b = M.corpus_bleu(p.join(other, "conv_id").withColumn("refs", F.array("gold", "other")), "pred", "refs", "k")
    c = M.corpus_chrf(p, "pred", "gold", "k")
    return b.select(F.lit("bleu").alias("metric"), F.round("bleu", 8).alias("value")).unionByName(c.select(F.lit("chrf").alias("metric"), F.round("chrf", 8).alias("value")))


# ---- contamination -----------------------------------------------------------------------------------------------

def grams_sql(name: str, src: str, key: str, n: int) -> str:
    norm = f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {PUNCT}, 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
{name}_w AS (SELECT {key}, {words(norm)} AS w FROM {src}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i + 1 : i + {n}], ' ') AS ngram FROM (SELECT {key}, w, unnest(range(0, greatest(len(w) - {n - 1}, 0))) AS i FROM {name}_w)),
"""


@query("q_ngram13", "WITH" + grams_sql("g", "documents", "doc_id", 13) + """
o AS (SELECT doc_id, count(*) AS n_ngrams FROM g GROUP BY doc_id) SELECT doc_id, n_ngrams FROM o""")
def ngram13(spark, d):
    # counted inside the row: nothing is exploded or shuffled
    from ..operators.contamination import ngram_normalize, word_ngrams
    n = documents(spark, d).select("doc_id", F.size(F.array_distinct(word_ngrams(ngram_normalize("text"), 13))).cast("bigint").alias("n_ngrams"))
    return n.filter("n_ngrams > 0")


@query("q_common_ngrams", "WITH" + grams_sql("g", "documents", "doc_id", 13) + """
o AS (SELECT ngram, count(*) AS n_docs FROM g GROUP BY ngram HAVING count(*) > 10) SELECT * FROM o""")
def common_ngrams(spark, d):
    return D.common_ngrams(documents(spark, d), "doc_id")


@query("q_repeated_ngrams", "WITH" + grams_sql("g", "documents", "doc_id", 13) + """
o AS (SELECT ngram, count(*) AS n_docs FROM g GROUP BY ngram HAVING count(*) > 1) SELECT * FROM o""")
def repeated_ngrams(spark, d):
    """13-grams in more than one document, whatever the size of the corpus."""
    return D.common_ngrams(documents(spark, d), "doc_id", more_than=1)


@query("q_common_short_ngrams", "WITH" + grams_sql("g", "documents", "doc_id", 3) + """
o AS (SELECT ngram, count(*) AS n_docs FROM g GROUP BY ngram HAVING count(*) > 10) SELECT * FROM o""")
def common_short_ngrams(spark, d):
    return D.common_ngrams(documents(spark, d), "doc_id", n=3)


@query("q_contaminated_docs", "WITH" + grams_sql("g", "documents", "doc_id", 13) + grams_sql("b", "benchmark", "item_id", 13) + """
o AS (SELECT DISTINCT doc_id, item_id FROM g JOIN b USING (ngram)) SELECT * FROM o""")
def contaminated_docs(spark, d):
    return D.overlaps(documents(spark, d), "doc_id", table(spark, d, "benchmark"), "item_id")


@query("q_contaminated_items", "WITH" + grams_sql("g", "documents", "doc_id", 13) + grams_sql("b", "benchmark", "item_id", 13) + """
o AS (SELECT DISTINCT item_id FROM b WHERE ngram IN (SELECT ngram FROM g)) SELECT * FROM o""")
def contaminated_items(spark, d):
    return D.contaminated(documents(spark, d), "doc_id", table(spark, d, "benchmark"), ["item_id"])


@query("q_clean_chunks")
def clean_chunks(spark, d):
    dirt = D.document_ngrams(table(spark, d, "benchmark"), ["item_id"]).select("ngram")
    return D.clean_chunks(documents(spark, d).select("doc_id", "text"), "doc_id", dirt)


@query("q_ngram_offsets", f"""
WITH w AS (SELECT item_id, string_split({sq('text')}, ' ') AS w FROM benchmark)
SELECT item_id, len(w) - 4 AS n_ngrams FROM w""")
def ngram_offsets(spark, d):
    g = table(spark, d, "benchmark").select("item_id", F.explode(A.word_ngrams_with_offsets("text", 5)).alias("g"), "text")
    # an offset pair must point back at its own words
    ok = F.expr("substring(text, g.start + 1, g.end - g.start + 1)")
    return g.filter(T.squeeze(ok) == F.col("g.ngram")).groupBy("item_id").agg(F.count("*").alias("n_ngrams"))


@query("q_document_offsets", """
SELECT doc_id, strlen(text) AS n_bytes, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents""")
def document_offsets(spark, d):
    return D.document_offsets(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query("q_sample_fraction", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos < ceil((SELECT count(*) FROM documents) * 0.25)""")
def sample_fraction(spark, d):
    pos = dense_index(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return pos.filter(F.col("pos") < S.sample_limit(pos.count(), 0.25)).select("doc_id")
