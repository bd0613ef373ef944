"""Near-duplicate documents by MinHash with tensored banding.

A table key is made of two halves taken from two small collections of sub-keys: `SIDE` left halves and
`SIDE` right halves of `HASHES` min-hashes each give SIDE x SIDE tables, so that 2 x SIDE x HASHES
min-hashes serve tables that would otherwise need SIDE x SIDE x 2 x HASHES. Two documents of similarity s
share no table with probability 1 - (1 - (1 - s^HASHES)^SIDE)^2, which is 0.0003 at s = 0.75 and falls fast
above it. Every link is confirmed on the full sets.

How the plan stays linear in hot groups:

* equal shingle sets are one class before anything is banded;
* a half that only one class has is dropped before halves are combined (a shared table needs both shared);
* each class is first compared with one leader of its buckets only, the class that meets most others. Only
  pairs that this leaves under different labels are compared after that, each in one bucket, and the join
  condition itself tests sizes, four bits of every min-hash and a bitmap bound on the intersection, so
  only likely links become rows. Pairs known to be connected are never formed, and no pair that could join
  two components is skipped.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, int_lists, longs, save, tasks
from .words import chunks, mix, shingle_sets

SIDE, HASHES = 16, 3
#: bits in which the 384-bit sketches (four bits of each min-hash) of two documents of similarity 0.75 may
#: differ: 48 are expected, standard deviation 9.8, and this is five of them more
DIFFER = 97
PERCENT = 75
#: bins of the bitmap bound
BITS = 1024
_U = np.uint64


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, set_a, set_b, halves, s0..s5): set size, 128-bit set identity, the 2 x SIDE half keys and
    six words of 4-bit min-hash sketches. Reads each whole text once."""
    total = 2 * SIDE * HASHES
    rng = np.random.default_rng(7)
    multipliers = rng.integers(1, 1 << 63, total, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    masks = rng.integers(1, 1 << 63, total, dtype=np.int64).astype(_U)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for chunk in chunks(texts):
                sets = shingle_sets(chunk)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                n, a, b = sizes, np.zeros(len(sets), _U), np.zeros(len(sets), _U)
                halves = np.zeros((len(sets), 2 * SIDE), _U)
                words = np.zeros((len(sets), 6), _U)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    a[full] = np.add.reduceat(mix(flat), at)
                    b[full] = np.add.reduceat(mix(flat ^ _U(0x5851F42D4C957F2D)), at)
                    least = np.empty((len(full), total), _U)
                    for k in range(total):
                        least[:, k] = np.minimum.reduceat((flat ^ masks[k]) * multipliers[k], at)
                    nibbles = mix(least) >> _U(60)
                    for w in range(6):
                        for j in range(16):
                            words[full, w] |= nibbles[:, 16 * w + j] << _U(4 * j)
                    part = least.reshape(len(full), 2 * SIDE, HASHES)
                    h = np.arange(1, 2 * SIDE + 1, dtype=_U) * _U(0xA24BAED4963EE407)
                    h = np.broadcast_to(h, part.shape[:2]).copy()
                    for j in range(HASHES):
                        h = mix(h * _U(0x9FB21C651E98DF25) + part[:, :, j])
                    halves[full] = h
                at = np.arange(0, 2 * SIDE * len(sets) + 1, 2 * SIDE)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(chunk.rows.start, len(sets)), pa.array(n), longs(a), longs(b), int_lists(halves.ravel(), at)]
                    + [longs(words[:, w]) for w in range(6)],
                    names=["doc_id", "n", "set_a", "set_b", "halves", *(f"s{w}" for w in range(6))])

    return tasks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run,
                 "doc_id long, n long, set_a long, set_b long, halves array<long>, " + ", ".join(f"s{w} long" for w in range(6)))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted distinct shingle hashes of the wanted documents' whole texts."""
    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sets = shingle_sets(chunk)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.rows.start, len(sets)), int_lists(np.concatenate(sets), bounds)], names=["doc_id", "shingles"])

    return tasks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi"), run,
                 "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("t"))
            .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("t") - F.col("i"))).select("a", "b"))


def bitmaps(sets: DataFrame) -> DataFrame:
    """(doc_id, touched, m0..m15): which of `BITS` hash bins each set touches, and how many."""
    names = [f"m{k}" for k in range(BITS // 64)]

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, BITS // 64), _U)
            for row, s in zip(out, batch.column(1)):
                bins = s.values.to_numpy().view(_U) >> _U(64 - BITS.bit_length() + 1)
                np.bitwise_or.at(row, (bins >> _U(6)).astype(np.int64), _U(1) << (bins & _U(63)))
            touched = np.bitwise_count(out).sum(1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(touched), *(longs(out[:, k].copy()) for k in range(out.shape[1]))],
                                             names=["doc_id", "touched", *names])

    return tasks(sets.select("doc_id", "shingles"), run, "doc_id long, touched long, " + ", ".join(f"{m} long" for m in names))


def alike(l: str, r: str) -> F.Column:
    """May two aliases be linked, and is this the first table that has both?

    Set sizes within the ratio; few differing bits in the min-hash sketches; with `shared` bins in common
    |A and B| <= |A| - (bins only A touches) = |A| - touched + shared, which never rejects a link; no half
    shared before. Plain arithmetic on columns, few terms: the join's generated code stays compilable."""
    differ, shared = F.lit(0), F.lit(0)
    for w in range(6):
        differ = differ + F.bit_count(F.col(f"{l}.s{w}").bitwiseXOR(F.col(f"{r}.s{w}")))
    for k in range(BITS // 64):
        shared = shared + F.bit_count(F.col(f"{l}.m{k}").bitwiseAND(F.col(f"{r}.m{k}")))
    nl, nr = F.col(f"{l}.n"), F.col(f"{r}.n")
    beside = F.least(nl - F.col(f"{l}.touched"), nr - F.col(f"{r}.touched"))
    return ((F.lit(100) * F.least(nl, nr) >= F.lit(PERCENT) * F.greatest(nl, nr)) & (differ <= F.lit(DIFFER))
            & (F.lit(100 + PERCENT) * (shared + beside) >= F.lit(PERCENT) * (nl + nr))
            & ~F.arrays_overlap(f"{l}.before", f"{r}.us"))


def leaders(placed: DataFrame) -> DataFrame:
    """One pair (a, b) for each class b that is not alone and first in all its buckets: a is the class with
    the highest score of b's buckets, ties to the smaller id."""
    first = placed.groupBy("bucket").agg(F.min(F.struct((-F.col("score")).alias("o"), "class_id")).alias("first"))
    return (placed.join(first, "bucket").where("first.class_id <> class_id").groupBy("class_id").agg(F.min("first").alias("first"))
            .select(F.col("first.class_id").alias("a"), F.col("class_id").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Documents are linked if their sets of five-word shingles (A-Z lower-cased) have Jaccard similarity 0.75
    or more; a component is named by its smallest doc_id, which is the one kept. Null, empty and blank
    texts have no set, are linked with nothing and kept. Rows repeated in full under one doc_id give
    repeated rows. Other columns are ignored; an empty table gives an empty table. A null doc_id gets a
    null component and is kept.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = save(sketches(docs), "sketches")
    identity = ["set_a", "set_b", "n"]
    classes = save(made.where("n > 0 AND doc_id IS NOT NULL").groupBy(identity).agg(F.min("doc_id").alias("class_id")), "sets")
    member = save(made.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *identity).join(classes, identity).select("doc_id", "n", "class_id"), "classes")
    head = member.where("doc_id = class_id").select("class_id").distinct()
    sign = save(made.join(head, made.doc_id == head.class_id).dropDuplicates(["class_id"])
                .select("class_id", "n", "halves", *(f"s{w}" for w in range(6))), "signatures")

    half = sign.select("class_id", F.posexplode("halves").alias("i", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    parts = (half.join(shared, "half", "left_semi").groupBy("class_id")
             .agg(F.collect_list(F.when(F.col("i") < SIDE, F.col("half"))).alias("us"),
                  F.collect_list(F.when(F.col("i") >= SIDE, F.col("half"))).alias("vs")))
    tables = save(parts.select("class_id", F.explode("us").alias("u"), "vs").select("class_id", "u", F.explode("vs").alias("v"))
                  .select("class_id", F.xxhash64("u", "v").alias("bucket")), "tables")
    buckets = tables.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", "c")
    shares = save(tables.join(buckets, "bucket"), "shares")
    central = save(shares.groupBy("class_id").agg(F.sum("c").alias("score")), "scores")
    placed = save(shares.select("bucket", "class_id").join(central, "class_id"), "buckets")

    sets = save(full_sets(docs, central.select(F.col("class_id").alias("doc_id"))).dropDuplicates(["doc_id"]), "sets")
    links = save(confirmed(leaders(placed), sets), "links")
    # a label shared by classes that are surely connected: the confirmed leader's leader, or the leader
    up = links.select(F.col("b").alias("node"), F.col("a").alias("leader"))
    label = up.join(up.select(F.col("node").alias("leader"), F.col("leader").alias("over")), "leader", "left").select("node", F.coalesce("over", "leader").alias("label"))

    # pairs of different labels that share a left and a right half, each formed in its first shared left half only
    maps = bitmaps(sets).withColumnRenamed("doc_id", "class_id")
    named = (sign.join(central.select("class_id"), "class_id").join(maps, "class_id").join(label, F.col("class_id") == F.col("node"), "left")
             .select("class_id", "n", F.coalesce("label", "class_id").alias("c"), F.slice("halves", 1, SIDE).alias("us"),
                     F.slice("halves", SIDE + 1, SIDE).alias("vs"), "touched", *(f"m{k}" for k in range(BITS // 64)), *(f"s{w}" for w in range(6))))
    named = save(named, "named")
    spread = named.select("*", F.posexplode("us").alias("i", "u"))
    open_ = save(spread.groupBy("u").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("u"), "open")
    rest = save(spread.join(open_, "u", "left_semi").withColumn("before", F.slice("us", F.lit(1), F.col("i"))), "rest")
    l, r = rest.alias("l"), rest.alias("r")
    cross = (l.join(r, (F.col("l.u") == F.col("r.u")) & (F.col("l.class_id") < F.col("r.class_id")) & (F.col("l.c") != F.col("r.c"))
                    & alike("l", "r") & F.arrays_overlap("l.vs", "r.vs"))
             .select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b")))
    linked = save(components(links.unionByName(confirmed(save(cross, "cross"), sets))), "components")

    out = member.join(linked, member.class_id == linked.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))
    none = made.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
