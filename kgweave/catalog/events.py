"""Event roll-ups, chains of events as a graph, and answers that name segments."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..plans import evaluate as E
from ..session import scratch_path
from ..streaming import events as SE, ingest as SI
from .base import ORACLES, WITH_KG, documents, query, table


@query("q_event_windows", """
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(sum(value), 6) AS total
FROM events GROUP BY ALL""")
def event_windows(spark, d):
    """Tumbling one-hour windows per event type."""
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 6).alias("total")).select(
        F.col("w.start").alias("hour"), "event_type", "n_events", "n_users", "total")


@query("q_event_sessions", """
WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS last_event, count(*) AS n_events FROM s GROUP BY user_id, session""")
def event_sessions(spark, d):
    """Sessions of a user: events no more than six hours apart."""
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours"))
    return e.agg(F.min("ts").alias("started"), F.max("ts").alias("last_event"), F.count("*").alias("n_events")).select(
        "user_id", "started", "last_event", "n_events")


def _files(spark, d, name, schema):
    """A given table as a stream of files."""
    stream = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream  # stored without a time zone


@query("q_event_windows_stream", ORACLES["q_event_windows"])
def event_windows_stream(spark, d):
    """The same windows from a stream of files under a watermark."""
    base = scratch_path(spark, "windows")
    events = _files(spark, d, "events", table(spark, d, "events").schema).select("ts", "user_id", "event_type", "value")
    SE.write_windows(events, f"{base}/out", f"{base}/state").awaitTermination()
    return SE.read_windows(spark.read.parquet(f"{base}/out")).withColumn("total", F.round("total", 6)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("q_event_sessions_stream", ORACLES["q_event_sessions"])
def event_sessions_stream(spark, d):
    """The same sessions from a stream of files; rows far ahead, in two batches, close those still open."""
    base = scratch_path(spark, "sessions")
    for day in (1, 2):
        spark.range(1).select(F.lit(f"2200-01-0{day}").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("user_id")).write.mode("append").parquet(f"{base}/end")
    ends = spark.readStream.schema("ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/end")
    events = _files(spark, d, "events", table(spark, d, "events").schema).select("ts", "user_id")
    SE.write_sessions(events.unionByName(ends), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "last_event")], "n_events")


@query("q_ingest_keys", WITH_KG + "SELECT 'node' AS kind, name AS key FROM nodes UNION ALL SELECT DISTINCT 'text', text_id FROM texts")
def ingest_keys(spark, d):
    """Nodes and passages that the keyed ingest writes for a stream of all documents."""
    base = scratch_path(spark, "ingest")
    docs = _files(spark, d, "documents", table(spark, d, "documents").schema).select(F.col("doc_id").cast("string").alias("id"), "text")
    SI.ingest(docs, f"{base}/out", f"{base}/state").awaitTermination()
    read = lambda t, c: spark.read.parquet(f"{base}/out/{t}").select(F.lit(t.split("_")[0].rstrip("s")).alias("kind"), F.col(c).alias("key"))
    return read("nodes", "name").unionByName(read("text_nodes", "text_id"))


@query("q_event_chains", "SELECT min(event_id) AS component, count(*) AS n_nodes FROM events GROUP BY user_id")
def event_chains(spark, d):
    """Components of the graph that links each event with the user's next one: one chain per user."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    edges = e.where("next IS NOT NULL").select(F.col("event_id").alias("src"), F.col("next").alias("dst"))
    return R.connected_components(edges, e.select(F.col("event_id").alias("id"))).groupBy("component").agg(F.count("*").alias("n_nodes"))


@query("q_wrong_segments", r"""
WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' 2 facts'
    WHEN 1 THEN text || ' Answer: ' || turn || ', ' || conv_id % 9 || E'\nAnswer: ' || conv_id % 7 ELSE 'Answer: 1 ALL_CORRECT' END AS answer FROM conversations),
n AS (SELECT conv_id, turn, answer, unnest(regexp_extract_all(regexp_extract(answer, '(?s)Answer: (.*)', 1), '\d+'))::BIGINT AS k FROM a)
SELECT conv_id, turn, k AS segment FROM n WHERE k BETWEEN 1 AND 6 AND NOT contains(answer, 'ALL_CORRECT') GROUP BY ALL""")
def wrong_segments(spark, d):
    a = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" 2 facts"))).when(F.col("turn") % 3 == 1, F.concat(
        "text", F.lit(" Answer: "), F.col("turn").cast("string"), F.lit(", "), (F.col("conv_id") % 9).cast("string"), F.lit("\nAnswer: "), (F.col("conv_id") % 7).cast("string"))
    ).otherwise(F.lit("Answer: 1 ALL_CORRECT"))
    c = table(spark, d, "conversations").select("conv_id", "turn", a.alias("answer"))
    return c.select("conv_id", "turn", F.explode(T.wrong_segment_ids("answer", F.lit(6))).alias("segment"))


@query("q_perplexity_tasks", """
WITH s AS (SELECT lang AS task, -ln(1 + length(text)) AS ll, strlen(text) AS b FROM documents)
SELECT task, 'byte_perplexity' AS metric, round(exp(-sum(ll) / sum(b)), 9) AS value, count(*) AS size FROM s GROUP BY task
UNION ALL SELECT task, 'bits_per_byte', round(-sum(ll) / sum(b) / ln(2), 9), count(*) FROM s GROUP BY task""")
def perplexity_tasks(spark, d):
    """Rolling likelihoods of whole texts, aggregated as the task runner does."""
    r = documents(spark, d).select(F.col("lang").alias("task"), "doc_id", (-F.log(F.length("text") + F.lit(1))).alias("value"), T.utf8_bytes("text").cast("double").alias("weight"))
    rows = r.withColumn("metric", F.explode(F.array(F.lit("byte_perplexity"), F.lit("bits_per_byte"))))
    return E.aggregate(rows).select("task", "metric", F.round("value", 9).alias("value"), "size")
