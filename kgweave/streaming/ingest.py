"""Incremental ingest: new document files become chunk, passage, node and edge rows as they arrive.

The workflow it replaces appends output row by row and resumes from an offset; here the file source's
checkpoint is that offset. Three queries hand on to each other:

1. documents -> extraction records, through a file sink: the model runs once per document;
2. records -> edges, without state;
3. records -> nodes and passages, first mention wins. Names and passage hashes are keys of a state store, so a
   batch looks up only the keys it brings, and nothing that was written before is read again.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import models, schema as SC
from ..operators import extraction as X

RECORD = ("file_name string, line_no long, id string, original_text string, entity_relation_dict string, "
          "event_entity_relation_dict string, event_relation_dict string")
#: a key's candidate: node names and passage hashes share one store; ``place`` orders the mentions of a batch
KEYS = ("kind", "key")
CANDIDATE = "kind string, key string, place string, type string, text_id string, original_text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def document_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Documents (id, text, metadata) from JSON-lines files added to a folder."""
    return spark.readStream.schema(SC.DOCUMENT).option("maxFilesPerTrigger", max_files).json(folder)


def candidates(records: DataFrame) -> DataFrame:
    """One row per mention of a node and per passage, with its key and its place in the batch."""
    r = X.with_text_ids(records)
    m = X.mentions(X.all_triples(r))
    # sorts as text like the numbers it is made of: the hash of the document, then the place inside it
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    line = F.lpad(F.hex(F.col("ord.line_no").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    place = F.concat(line, F.col("ord.kind").cast("string"), digits(F.col("ord.item"), 10), digits(F.col("ord.member"), 10), F.col("ord.end").cast("string"))
    none = F.lit(None).cast("string")
    nodes = m.select(F.lit("node").alias("kind"), F.col("name").alias("key"), place.alias("place"), "type", "text_id", none.alias("original_text"))
    texts = r.select(F.lit("text").alias("kind"), F.col("text_id").alias("key"), F.lpad(F.hex(F.col("line_no").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0").alias("place"),
                     none.alias("type"), none.alias("text_id"), F.col("passage").alias("original_text"))
    return nodes.unionByName(texts)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First candidate per key of each Arrow batch: a sentence, named by several triples of its document, is sent once."""
    for rows in batches:
        yield rows.sort_values("place").drop_duplicates([*KEYS])


def first_seen(stream: DataFrame) -> DataFrame:
    """The first candidate of every key, over all batches of a stream of candidates; written in update mode.

    A streaming aggregate keeps, per key, the earliest candidate by batch time and place, and the latest batch time.
    An update returns every key that a batch brings; those met before differ in the two times and are left out.
    """
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)  # keyed state values need a store that is not one map per partition
    rest = [c for c in stream.columns if c not in KEYS]
    # the time of a batch is written to the checkpoint before the batch starts: a retried one has the same
    timed = stream.mapInPandas(_combine, CANDIDATE).withColumn("at", F.current_timestamp())
    seen = timed.groupBy(*KEYS).agg(F.min(F.struct("at", *rest)).alias("first"), F.max("at").alias("last"))
    return seen.where("first.at = last").select(*KEYS, *[F.col(f"first.{c}").alias(c) for c in rest])


def ingest(docs: DataFrame, folder: str, checkpoint: str,
           extract: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Write nodes, text_nodes, edges and text_edges below ``folder``, partitioned by batch.

    Within a batch the hash of the document's id, then the place in the document, decides which mention is
    first; across batches arrival does. A batch overwrites its own partition, so a retried one changes
    nothing. Returns the query of nodes and passages, whose progress reports the number of keys in the store
    (`state_rows`); with ``once`` the two queries before it have ended, else all three go on.
    """
    spark = docs.sparkSession
    run = extract or (lambda d: models.rule_extraction(d, "id", "text"))
    trigger = {"availableNow": True} if once else {"processingTime": "0 seconds"}
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]

    # documents are not numbered in a stream: the id hash orders them inside their batch
    records = run(docs.where("text IS NOT NULL")).withColumn("line_no", F.xxhash64("id")).select(*names)
    first = records.writeStream.format("parquet").option("path", f"{folder}/_records").option("checkpointLocation", f"{checkpoint}/records").trigger(**trigger).start()
    if once:
        first.awaitTermination()
    stored = spark.readStream.schema(RECORD).parquet(f"{folder}/_records")

    def write_edges(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/edges/batch={batch}")

    edges = X.all_triples(stored).select(F.col("head").alias("start_id"), F.col("tail").alias("end_id"), "relation", "text_id")
    second = edges.writeStream.foreachBatch(write_edges).option("checkpointLocation", f"{checkpoint}/edges").trigger(**trigger).start()
    if once:
        second.awaitTermination()

    def write_firsts(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        for name, part in (("nodes", rows.where("kind = 'node'").select(F.col("key").alias("name"), "type")),
                           ("text_edges", rows.where("kind = 'node'").select(F.col("key").alias("start_id"), F.col("text_id").alias("end_id"))),
                           ("text_nodes", rows.where("kind = 'text'").select(F.col("key").alias("text_id"), "original_text"))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        rows.unpersist()

    return first_seen(candidates(stored)).writeStream.outputMode("update").foreachBatch(write_firsts).option(
        "checkpointLocation", f"{checkpoint}/firsts").trigger(**trigger).start()


def state_rows(query: StreamingQuery) -> int:
    """Keys in the state store after a query's last batch."""
    for progress in reversed(query.recentProgress):
        for operator in progress["stateOperators"]:
            return operator["numRowsTotal"]
    return 0
