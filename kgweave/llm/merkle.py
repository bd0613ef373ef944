"""Merkle manifest of a dataset: a digest per row, a tree per part, one root, and a proof for every row.

A row's leaf is the digest of its columns. The leaves of a part (a language) ascend by key; while several
nodes remain, every `RUN` consecutive ones become the digest of their concatenated hex text. What remains is
the part's subroot; the subroots, ordered by part, give the root in the same way.

The tree is worked in superblocks of 8 ** `LEVELS` consecutive nodes of one tree. Going up, each
superblock is reduced to its root, and the roots are the nodes of the next, 512 times smaller, pass. Going
down, the nodes of a superblock and the one row of what lies outside it (the siblings on the way from its root
to the dataset's root) are cogrouped: `applyInPandas` finishes the local reduction, joins the local siblings
with the outer ones to each node's proof, and at the leaves folds the proof over the row as it is found now.
A task holds one superblock at a time, so neither a part with most of the rows nor the number of parts matters;
texts are read once, to make the leaves, and never shuffled.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import shuffle_width
from .common import save

# Children of a node, and the columns of a leaf in their order.
RUN = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 3

NODE = "tree string, at long, total long, digest string"
OUTER = "tree string, at long, subroot string, root string, proof array<struct<place: int, siblings: array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Digest of the columns, each as its UTF-8 byte count, ``:`` and its value, or ``-`` where null."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def tampered(docs: DataFrame) -> list[Column]:
    """Columns as a tampered copy has them: A-Z of the text in lower case where 3 divides crc32 of the decimal
    doc_id. Null texts, and rows without a doc_id, stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [F.when(hit, lower).otherwise(F.col(c)) if c == "text" else F.col(c) for c in LEAF_COLUMNS]


def _levels(nodes: list[str], total: int, depth: int) -> list[list[str]]:
    """The nodes of a superblock and of every level above them: up to the root of a tree that fits in one
    superblock, else exactly ``depth`` levels."""
    out = [nodes]
    while len(out[-1]) > 1 if total <= RUN ** depth else len(out) <= depth:
        out.append([digest(out[-1][i: i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def _siblings(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """Per level the node's place in its run and the run's other nodes, up to the superblock's root."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % RUN
        run = nodes[first: first + RUN]
        out.append((at - first, run[: at - first] + run[at - first + 1:]))
        at //= RUN
    return out


def fold(node: str, proof) -> str:
    """The root that a node and a proof (place, siblings per level) lead to."""
    for place, siblings in proof:
        siblings = list(siblings)
        node = digest(siblings[:place] + [node] + siblings[place:])
    return node


def _block(depth: int) -> Column:
    return F.floor(F.col("at") / RUN ** depth).alias("block")


def _up(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The node tables of all passes; the last holds one node, the root, per tree."""
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        total = int(rows["total"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "total": [-(-total // RUN ** depth)],
                             "digest": [_levels(rows["digest"].tolist(), total, depth)[-1][0]]})

    out = [nodes]
    while True:
        last = out[-1]
        most = last.agg(F.max("total")).first()[0] or 0
        if len(out) > 1 and most <= 1:
            return out
        out.append(save(last.groupBy("tree", _block(depth)).applyInPandas(reduce, NODE), "nodes"))


def _cogrouped(nodes: DataFrame, outer: DataFrame, fn: Callable, schema: str, depth: int) -> DataFrame:
    """Nodes and the rows of what lies outside their superblock, together per superblock."""
    left = nodes.groupBy("tree", _block(depth))
    return left.cogroup(outer.groupBy("tree", F.col("at").alias("block"))).applyInPandas(fn, schema)


def _proofs(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int):
    """Sorted nodes, the local root, the outer row, and each node's siblings up to the dataset's root."""
    nodes = nodes.sort_values("at").reset_index(drop=True)
    levels = _levels(nodes["digest"].tolist(), int(nodes["total"].iloc[0]), depth)
    around = outer.iloc[0]
    above = [(int(s["place"]), list(s["siblings"])) for s in around["proof"]]
    return nodes, levels[-1][0], around, (lambda i: _siblings(levels, i) + above)


def _down(passes: list[DataFrame], outer: DataFrame, subroots: bool, depth: int) -> DataFrame:
    """What lies outside each superblock of the lowest pass, from what lies outside the whole trees.

    With ``subroots`` the root of a tree, known in its only superblock of the highest pass, is handed down."""
    def step(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=["tree", "at", "subroot", "root", "proof"])
        nodes, top, around, proof = _proofs(nodes, outer, depth)
        known = around["subroot"] if around["subroot"] is not None else top if subroots else None
        return pd.DataFrame({"tree": nodes["tree"], "at": nodes["at"], "subroot": known, "root": around["root"],
                             "proof": [[{"place": p, "siblings": s} for p, s in proof(i)] for i in range(len(nodes))]})

    for nodes in reversed(passes):
        outer = _cogrouped(nodes, outer, step, OUTER, depth)
    return outer


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Append ``at``, a dense number from 0 in each tree by ``order``, and ``total``, the tree's rows.

    A parallel range sort numbers the rows of each partition; only one count per partition and tree is then
    summed. ``tree`` is not null and ``order`` names a total order, so that no key can fill a partition.
    """
    ranged = (rows.repartitionByRange(shuffle_width(rows.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
              .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    ranged = save(ranged, "sorted")
    before = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).select(
        tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy(tree)).alias("total"))
    return ranged.join(starts, [tree, "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def manifest(docs: DataFrame, changed: Callable[[DataFrame], list[Column]] | None = None, part: str = "lang", key: str = "doc_id",
             columns: tuple[str, ...] = LEAF_COLUMNS, depth: int = LEVELS) -> DataFrame:
    """(key, part, leaf, subroot, root, proof, folded_root, verified) of every row.

    ``proof`` lists, from the leaf's level up to the root, the place of the row's node in its run and the
    run's other nodes (none for a lone node of a run, no level at all above a lone leaf). A superblock has ``depth`` levels. ``changed(docs)``
    gives the leaf's columns as they are found at verification, by default unchanged; ``folded_root`` is
    recomputed from that leaf and the original siblings, ``verified`` tells whether it equals ``root``.

    Null columns are part of the leaf as ``-``. Parts ascend by UTF-8 bytes, null first. Rows of a part
    ascend by key, null first; rows that share a key by their leaf, and rows with equal leaves are
    interchangeable: each has its own place and its own proof. A table of one row has the leaf as its root
    and an empty proof; an empty table gives an empty table. Columns that are not named are ignored.
    """
    now = changed(docs) if changed else [F.col(c) for c in columns]
    tree = F.when(F.col(part).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(part).cast("string")))
    made = docs.select(F.col(key).alias("key"), tree.alias("tree"), leaf([F.col(c) for c in columns]).alias("leaf"), leaf(now).alias("found"))
    made = save(made.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    placed = positions(made, "tree", ["key", "leaf", "_tie"]).drop("_tie").withColumnRenamed("leaf", "digest")

    passes = _up(placed.select("tree", "at", "total", "digest"), depth)
    roots = passes[-1].select(F.col("tree").alias("name"), F.col("digest"), F.lit("").alias("tree"))
    roots = positions(roots, "tree", ["name"])
    top = _up(roots.select("tree", "at", "total", "digest"), depth)
    whole = top[-1].select("tree", "at", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                           F.array().cast("array<struct<place: int, siblings: array<string>>>").alias("proof"))
    outer = _down(top[:-1], whole, False, depth)
    outer = outer.join(roots.select("name", "at"), "at").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "subroot", "root", "proof")
    outer = _down(passes[1:-1], outer, True, depth)

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "tree", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
        if nodes.empty:
            return pd.DataFrame(columns=names)
        nodes, local, around, proof = _proofs(nodes, outer, depth)
        proofs = [proof(i) for i in range(len(nodes))]
        folded = [fold(f, p) for f, p in zip(nodes["found"], proofs)]
        return pd.DataFrame({"key": nodes["key"], "tree": nodes["tree"], "leaf": nodes["digest"], "subroot": around["subroot"] if around["subroot"] is not None else local,
                             "root": around["root"], "proof": [[{"place": p, "siblings": s} for p, s in x] for x in proofs],
                             "folded_root": folded, "verified": [f == around["root"] for f in folded]})[names]

    # keys travel as text: pandas would make floats of whole numbers beside a null
    done = _cogrouped(placed.withColumn("key", F.col("key").cast("string")), outer, finish, "key string, tree string, leaf string, subroot string, root string, "
                      "proof array<struct<place: int, siblings: array<string>>>, folded_root string, verified boolean", depth)
    name = F.when(F.col("tree") == "", F.lit(None)).otherwise(F.substring("tree", 2, 1 << 30)).cast(docs.schema[part].dataType)
    return done.select(F.col("key").cast(docs.schema[key].dataType).alias(key), name.alias(part), "leaf", "subroot", "root", "proof", "folded_root", "verified")
