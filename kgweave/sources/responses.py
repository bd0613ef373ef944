"""A store of model answers and vectors that grows by parts.

A key is the hash of prompt and parameters. Every part is a table bucketed and sorted by key, written once under
the caller's name for the batch: a batch that is run again finds its part and writes nothing. A lookup shuffles
the batch's own keys to the buckets once and meets all parts where they lie.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import models

BUCKETS = 64


@dataclass(frozen=True)
class ResponseStore:
    """Answers (key, response) below ``folder``, which all executors can reach. ``buckets`` never changes."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    value: str = "string"

    def _children(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def _done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def parts(self) -> list[str]:
        """Names of the whole parts; what an interrupted write left behind is none."""
        return [n for n in self._children() if self._done(n)]

    def _title(self, name: str) -> str:
        return "responses_" + hashlib.sha256(f"{self.folder}/{name}".encode()).hexdigest()[:24]

    def part(self, name: str) -> DataFrame:
        title = self._title(name)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {title} (key STRING, response {self.value.upper()}) USING parquet "
                       f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(title)

    def append(self, rows: DataFrame, name: str) -> None:
        """Write (key, response) as the part ``name``, unless it is there already."""
        if self._done(name):
            return
        title = self._title(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {title}")
        (rows.select("key", F.col("response").cast(self.value).alias("response")).repartition(self.buckets, "key").write.mode("overwrite").format("parquet")
         .bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(title))

    def known(self, keys: DataFrame) -> DataFrame:
        """(key, response) of those ``keys`` (distinct) that some part holds; later parts add, none repeats a key."""
        found = None
        keys = keys.select("key").repartition(self.buckets, "key")
        for name in self.parts():
            hit = keys.join(self.part(name), "key")
            found = hit if found is None else found.unionByName(hit)
        return found if found is not None else keys.select("key", F.lit(None).cast(self.value).alias("response")).where(F.lit(False))

    def missing(self, keys: DataFrame) -> DataFrame:
        """Those ``keys`` that no part holds: one exchange of the keys, none of the store."""
        keys = keys.repartition(self.buckets, "key")
        for name in self.parts():
            keys = keys.join(self.part(name).select("key"), "key", "left_anti")
        return keys


def answer_stored(df: DataFrame, prompt: str, out: str, make_generator, store: ResponseStore, batch: str, params: str = "",
                  sampling: bool = False) -> DataFrame:
    """Append the model's answers; distinct prompts that the store lacks are asked once and stored as ``batch``.

    With ``sampling`` every row is asked anew and nothing is stored: answers differ by intention. A null prompt
    is asked like an empty one. Running a batch again asks nothing.
    """
    if sampling:
        return models.generate(df, prompt, out, make_generator)
    keyed = df.withColumn("key", F.sha2(F.concat(F.lit(params + "\x1f"), F.coalesce(prompt, F.lit(""))), 256))
    todo = store.missing(keyed.select("key", F.coalesce(prompt, F.lit("")).alias("_p")).dropDuplicates(["key"]))
    if batch not in store.parts():
        store.append(models.generate(todo, "_p", "response", make_generator), batch)
    answers = store.known(keyed.select("key").distinct())
    return keyed.join(answers.withColumnRenamed("response", out), "key", "left").drop("key")
