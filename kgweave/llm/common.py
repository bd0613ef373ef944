"""Helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def save(df: DataFrame, name: str) -> DataFrame:
    """Written once below the shared checkpoint folder and read back: lineage ends here, and the planner
    knows the table's true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def int_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """list<long> column from a flat array and row bounds; unsigned hashes keep their bits."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.uint64).view(np.int64)))


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed 64-bit values with the same bits."""
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a map-side combined minimum per node and
    one equi-join, so a hub only costs one partial row per task, and the number of rounds grows with the
    logarithm of the longest path. Loops until the edge set no longer changes; there is no round limit.
    Null ends and self-loops add nothing. No edges: an empty table.
    """
    now = save(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
               .where("lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("lo").alias("u"), "hi").join(low, "u").select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(down, "hi").select("m", F.col("lo").alias("x"))
        small = down.select(F.col("m").alias("lo"), "hi").unionByName(moved.select(F.col("m").alias("lo"), F.col("x").alias("hi")))
        now = save(small.where("lo <> hi").distinct(), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    pairs = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return pairs.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum: equal marks mean an unchanged edge set."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return tuple(r)


def per_worker(name: str, make):
    """An object made once per worker process and found again by later tasks in it."""
    import sys
    import types

    held = sys.modules.setdefault("_kgweave_worker", types.ModuleType("_kgweave_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)
