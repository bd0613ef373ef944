"""Exact top-k inner products with an impact-ordered index, score at a time.

The index has blocks of at most about `BLOCK_ROWS` vectors. In a block every dimension's postings are cut
into segments of equal quantised impact. A query visits segments by descending gain over the worst value of
their dimension; a row's accumulator is a lower bound of its score, and what unvisited segments and
quantisation can still add is one number. Visiting stops when few rows can still belong to the k best:
every other row's upper bound is below the k-th lower bound. Rows that may belong are scored exactly.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import save

BLOCK_ROWS, QUERY_ROWS = 16_384, 1_024
LEVELS = 12
SCALE = 256


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): components floor(256 x), x as double; rows with a null id, a null vector or a null or
    non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))
            .select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v")))


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block and vector length: ids, values, and the segments' bounds and postings."""
    def make(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        m = table.column("v").combine_chunks().values.to_numpy().reshape(len(ids), dim).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        low, high = m.min(0), m.max(0)
        width = np.maximum(1, -(-(high - low + 1) // LEVELS))
        posts, segs = [], []
        at = 0
        for d in range(dim):
            level = (m[:, d] - low[d]) // width[d]
            by = np.argsort(level, kind="stable").astype(np.int32)
            lv, begin = np.unique(level[by], return_index=True)
            end = np.append(begin[1:], len(by))
            for lo, a, b in zip(lv, begin, end):
                vals = m[by[a:b], d]
                segs.append((d, int(vals.min()), int(vals.max()), at + a, at + b))
            posts.append(by)
            at += len(by)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1).cast(pa.int32()),
                         "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "values": pa.array([m.tobytes()], pa.binary()),
                         "segments": pa.array([np.array(segs, np.int64).tobytes()], pa.binary()), "postings": pa.array([np.concatenate(posts).tobytes()], pa.binary())})

    placed = rows.where(F.size("v") > 0).select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    return save(placed.groupBy("dim", "block").applyInArrow(make, "dim int, block int, ids binary, values binary, segments binary, postings binary"), "index")


def best_in_block(q: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, segs: np.ndarray, posts: np.ndarray, k: int):
    """(rows, scores) of the k best rows of a block for one query, best first, ties to the smaller id."""
    n = len(ids)
    d, lo, hi, a, b = segs.T
    w = q[d]
    at_least, at_most = np.where(w >= 0, w * lo, w * hi), np.where(w >= 0, w * hi, w * lo)
    worst = np.full(len(q), np.iinfo(np.int64).max)
    np.minimum.at(worst, d, at_least)
    gain, slack = at_least - worst[d], at_most - at_least
    blur = np.zeros(len(q), np.int64)
    np.maximum.at(blur, d, slack)
    visit = np.argsort(-gain, kind="stable")
    # what a row can still gain in a segment's dimension once it is visited: the next segment's gain
    by_dim = visit[np.argsort(d[visit], kind="stable")]
    after = np.zeros(len(visit), np.int64)
    after[by_dim[:-1]] = np.where(d[by_dim[1:]] == d[by_dim[:-1]], gain[by_dim[1:]], 0)
    first = np.flatnonzero(np.diff(d[by_dim], prepend=-1))
    rest = base_sum = int(gain[by_dim[first]].sum())
    acc = np.zeros(n, np.int64 if abs(base_sum) > 1 << 30 else np.int32)
    out = np.flatnonzero(ids == own)
    spread = int(blur.sum())
    few, every = max(4 * k, n // 3), max(1, len(visit) // 24)  # scoring a third exactly costs less than going on
    may = np.ones(n, bool)
    may[out] = False
    steps = zip(gain[visit].tolist(), after[visit].tolist(), a[visit].tolist(), b[visit].tolist())
    for i, (more, then, lo, hi) in enumerate(steps):
        if not more:
            break  # only the worst values of each dimension are left: nothing more to gain
        acc[posts[lo:hi]] += more
        rest += then - more
        if i % every == every - 1 and 2 * i > len(visit):
            acc_k = acc.copy()
            acc_k[out] = -1
            kth = np.partition(acc_k, n - k)[n - k] if n > k else -1
            may = acc + rest + spread >= kth
            may[out] = False
            if may.sum() <= few:
                break
    rows = np.flatnonzero(may)
    score = m[rows] @ q
    top = np.lexsort((ids[rows], -score))[:k]
    return rows[top], score[top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors by integer inner product.

    ``queries`` has the columns of ``vectors``; every vector but those with the query's own id is a candidate.
    Ties go to the smaller vec_id; fewer candidates give fewer rows. Only vectors of equal length are
    compared; empty, null and non-finite vectors take no part, on either side. A query repeated in full is
    one query; repeated vectors are candidates each. Other columns are ignored; empty tables give an empty
    table. Components are taken to be below 2^22 in size, so that scores fit 64 bits.
    """
    rows = save(usable(vectors, key, vector), "vectors")
    asked = usable(queries, key, vector).where(F.size("v") > 0).distinct()
    asked = save(asked, "queries")
    blocks, sets = 1 + rows.count() // BLOCK_ROWS, 1 + asked.count() // QUERY_ROWS
    index = build_index(rows, blocks)

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        got = ([], [], [])
        if left.num_rows and right.num_rows:
            one = left.to_pylist()[0]
            ids, segs = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["segments"], np.int64).reshape(-1, 5)
            m, posts = np.frombuffer(one["values"], np.int64).reshape(len(ids), -1), np.frombuffer(one["postings"], np.int32).astype(np.int64)
            for own, v in zip(right.column("vec_id").to_pylist(), right.column("v")):
                at, score = best_in_block(v.values.to_numpy().astype(np.int64), own, ids, m, segs, posts, k)
                got[0].extend([own] * len(at))
                got[1].extend(ids[at].tolist())
                got[2].extend(score.tolist())
        return pa.table({n: pa.array(g, pa.int64()) for n, g in zip(("query_id", "vec_id", "score"), got)})

    at = ["dim", "block", "set"]
    left = index.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int").alias("set"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(look, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
