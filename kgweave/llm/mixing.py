"""Mixing sources to target weights with Pfair windows.

Each source's documents, in hash order, are cut into blocks of `BLOCK_CHARS` characters. In the fluid mixture
every source gives at a rate in proportion to its weight; where a source has given its last block, the weights
of the others are renormalised, so the mixture goes on to the last block of the last source. Block j of a
source (from 0) is released in the slot in which the fluid mixture begins it and due in the slot in which it
ends it. Earliest-deadline-first over the released blocks gives every slot to one block and meets every
window: after any number of slots each source is less than one block from its fluid share. Weights are used
as they are, not rounded to a period.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import save

BLOCK_CHARS = 65_536
PERIOD = 10_000
#: default weights: each source's share of all characters to this power
TEMPERATURE = 0.7
#: rows that one salt of a source orders
SALT_ROWS = 2_000
#: blocks of a source whose slots travel as one array
RUN = 4_096
#: room for rounding where a window ends on a whole slot
EPSILON = 1e-6
RUN_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole blocks per period for each source, one at least."""
    total = sum(weights.values())
    return {s: max(1, round(period * w / total)) for s, w in weights.items() if w > 0}


def windows(weights: dict, counts: dict) -> dict:
    """source -> (releases, deadlines) of its blocks in slots, by the fluid mixture of ``counts`` blocks."""
    ends = sorted((counts[s] / weights[s], weights[s]) for s in counts)
    at = np.array([0.0] + [v for v, _ in ends])
    rates = np.cumsum(np.array([w for _, w in ends][::-1], float))[::-1]
    times = np.concatenate([[0.0], np.cumsum(np.diff(at) * rates)])
    out = {}
    for s, n in counts.items():
        t = np.interp(np.arange(n + 1) / weights[s], at, times)
        out[s] = np.floor(t[:-1] + EPSILON).astype(np.int64), np.ceil(t[1:] - EPSILON).astype(np.int64)
    return out


def schedule(weights: dict, counts: dict) -> dict:
    """source -> slot of each of its blocks, earliest deadline first among released; every block has a slot."""
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    # plain lists: single items of arrays are slow
    bounds = [tuple(x.tolist() for x in w) for w in map(windows(weights, counts).get, names)]
    slots: list[list[int]] = [[] for _ in names]
    waiting = [(0, i) for i in range(len(names)) if counts[names[i]]]
    ready: list[tuple[int, int]] = []
    for t in range(sum(counts.values())):
        while waiting and (waiting[0][0] <= t or not ready):
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (bounds[i][1][len(slots[i])], i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        if len(slots[i]) < counts[names[i]]:
            heapq.heappush(waiting, (bounds[i][0][len(slots[i])], i))
    return dict(zip(names, slots))


def period_slots(quota: dict) -> dict:
    """source -> slot of each of its blocks within one period of whole ``quota`` blocks."""
    return schedule(quota, quota)


def mix(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, key: str = "doc_id", text: str = "text",
        source: str = "source", size: int | None = None) -> DataFrame:
    """(doc_id, source, block, slot, kept): the block of its source in which each document starts, the
    block's slot in the mixture, and whether the document is part of it.

    ``weights`` maps a source to its target weight; without it, weights are character shares to the power
    `TEMPERATURE` and every document is kept. Weights decide the order; only with a ``size`` in blocks does the
    mixture end there, and documents of later slots are not kept. Sources without weight have no slots and are not kept; weights
    of absent sources are ignored. Null sources are one source of their own. Null and empty texts have length
    0 and share their neighbour's block. Repeated rows are rows of their own. Other columns are ignored; an
    empty table gives an empty table. The sources' totals and one slot per block (8 bytes for `BLOCK_CHARS`
    characters) are on the driver and go to every task.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long").alias("size"))
    rows = save(rows.withColumn("place", F.xxhash64("doc_id")), "sizes")
    salts = 1 + rows.count() // SALT_ROWS
    # consecutive slices of the hash order, so that a source of any size is summed by many tasks
    rows = rows.withColumn("salt", F.floor((F.shiftrightunsigned("place", 33)) * F.lit(salts) / F.lit(1 << 31)).cast("int"))
    sums = rows.groupBy("source", "salt").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("source").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("salt").alias("k"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("source", "salt").orderBy(F.shiftrightunsigned("place", 1), "place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("k")))
              .select("doc_id", "source", F.floor((F.col("start") + F.col("own")) / F.lit(block_chars)).cast("long").alias("block")))

    totals = {r["source"]: max(1, r["n"] or 0) for r in sums.groupBy("source").agg(F.sum("sum").alias("n")).collect()}
    if weights is None:
        weights = {s: n ** TEMPERATURE for s, n in totals.items()}
    counts = {s: -(-n // block_chars) for s, n in totals.items() if weights.get(s, 0) > 0}
    runs = [(s, k // RUN, len(ts), ts[k: k + RUN]) for s, ts in schedule(weights, counts).items() for k in range(0, len(ts), RUN)]
    table = docs.sparkSession.createDataFrame(pa.table([pa.array(list(x), t) for x, t in zip(zip(*runs) if runs else [[]] * 4, RUN_TYPES)], names=["s", "run", "n", "slots"]))
    ends = table.where("run = 0").select("s", "n")
    # an empty text behind a full last block belongs to that block
    placed = placed.join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("block", F.least("block", F.col("n") - 1))
    return (placed.join(F.broadcast(table.drop("n")), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("block") / RUN) == F.col("run")), "left")
            .withColumn("slot", F.get("slots", (F.col("block") % RUN).cast("int")))
            .select("doc_id", "source", "block", "slot", (F.col("slot").isNotNull() if size is None else F.coalesce(F.col("slot") < size, F.lit(False))).alias("kept")))
