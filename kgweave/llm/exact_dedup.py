"""Exact de-duplication of incoming documents against an immutable snapshot.

A snapshot holds one row per distinct text digest in hash buckets, and per bucket a static binary-fuse
filter of its digests. Incoming documents are first grouped among themselves by digest; the distinct
digests are screened by the filter of their bucket; only positives are joined with the exact buckets.
Every group that forms this way is then checked byte by byte: the texts of its rows are compared with the
text of the row that stays, and rows that differ are grouped anew by the text itself.

Groups are combined on the map side, so a group of copies costs a row per task; the joins that bring texts
together are plain equi-joins, whose hot keys adaptive execution splits.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fuse
from .common import save

#: distinct digests in one bucket and its filter
BUCKET_KEYS = 50_000


def sha256(text: str) -> F.Column:
    return F.unhex(F.sha2(F.col(text), 256))


@dataclass
class Snapshot:
    """Digests that are kept already (digest, keep_id, copies, bucket) and a filter per bucket."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def _keys(digests: pa.Array) -> np.ndarray:
    """64-bit keys from the first bytes of binary digests of any length."""
    return np.array([int.from_bytes(d[:8], "little") for d in digests.to_pylist()], np.uint64)


def _bucket(n: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, copies): equal digests of one batch; the largest doc_id stays."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies"))


def take_snapshot(groups: DataFrame, buckets: int) -> Snapshot:
    """Write the groups as exact buckets and build each bucket's filter once."""
    exact = save(groups.withColumn("bucket", _bucket(buckets)), "snapshot")

    def make(table: pa.Table) -> pa.Table:
        seed, segment, count, cells = fuse.build(np.unique(_keys(table.column("digest"))))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "seed": [seed], "segment": [segment], "count": [count],
                         "cells": pa.array([cells], pa.binary())})

    filters = save(exact.select("bucket", "digest").groupBy("bucket").applyInArrow(make, "bucket int, seed long, segment long, count long, cells binary"), "filters")
    return Snapshot(exact, filters, buckets)


def screened(snapshot: Snapshot, groups: DataFrame) -> DataFrame:
    """The incoming groups with ``maybe``: false is proof that the snapshot lacks the digest."""
    def look(filters: pa.Table, incoming: pa.Table) -> pa.Table:
        if not filters.num_rows:
            yes = np.zeros(incoming.num_rows, bool)
        else:
            f = filters.to_pylist()[0]
            yes = fuse.probe(_keys(incoming.column("digest")), f["seed"], f["segment"], f["count"], f["cells"])
        return incoming.select(["digest", "keep_id", "copies"]).append_column("maybe", pa.array(yes, pa.bool_()))

    incoming = groups.withColumn("bucket", _bucket(snapshot.buckets))
    return (snapshot.filters.groupBy("bucket").cogroup(incoming.groupBy("bucket"))
            .applyInArrow(look, "digest binary, keep_id long, copies long, maybe boolean"))


def deduplicate(docs: DataFrame, in_snapshot: F.Column, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every document.

    ``in_snapshot`` says which rows belong to the snapshot, the others arrive as a new batch; the result is
    the same for any split. Of equal texts the row with the largest doc_id stays. A null text counts as
    empty; empty texts are equal to each other. Rows repeated under one doc_id are rows of one group and
    share its verdict; a null doc_id stays only in a group without any id. ``digest`` may be any function of
    the text: groups are settled by bytes. Other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    made = save(rows.select("doc_id", digest("text").alias("digest"), F.sha2("text", 256).alias("text_sha256"), "old"), "digests")
    old, new = save(grouped(made.where("old")), "old"), save(grouped(made.where("NOT old")), "new")
    buckets = 1 + max(old.count(), new.count()) // BUCKET_KEYS
    snapshot = take_snapshot(old, buckets)
    looked = save(screened(snapshot, new), "screened")

    came = looked.where("maybe").select("digest", F.col("keep_id").alias("new_id"), F.col("copies").alias("more"))
    held = snapshot.exact.select("digest", F.col("keep_id").alias("old_id"), "copies")
    met = save(came.join(held, "digest").select("digest", F.greatest("old_id", "new_id").alias("keep_id"), (F.col("copies") + F.col("more")).alias("copies")), "met")
    alone = looked.where("NOT maybe").select("digest", "keep_id", "copies").unionByName(
        looked.where("maybe").select("digest", "keep_id", "copies").unionByName(snapshot.exact.select("digest", "keep_id", "copies")).join(met, "digest", "left_anti"))
    groups = save(alone.unionByName(met), "groups")

    many = groups.where("copies > 1").select("digest", "keep_id")
    texts = save(rows.select("doc_id", digest("text").alias("digest"), "text").join(many, "digest"), "texts")
    stay = texts.where("doc_id <=> keep_id").select("digest", F.col("text").alias("kept_text"))
    # written before it is made distinct: an aggregate in the join's stage would keep a hot digest in one task
    unlike = save(save(texts.join(stay, "digest").where("text <> kept_text").select("digest"), "differing").distinct(), "unlike")

    settled = (made.join(unlike, "digest", "left_anti").join(groups, "digest")
               .select("doc_id", "keep_id", F.col("copies").alias("group_size"), "text_sha256"))
    anew = texts.join(unlike, "digest", "left_semi").select("doc_id", "text")
    by_text = anew.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    anew = anew.join(by_text, "text").select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
    return settled.unionByName(anew).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def arrived_before(key: str = "doc_id") -> F.Column:
    """The split the registered query uses: half of the ids, by hash, are the snapshot."""
    return F.crc32(F.col(key).cast("string")) % 2 == 0
