"""N-gram overlap between training documents and evaluation texts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.arrays import let, ngrams, word_ngrams
from ..functions.text import PY_WS, ngram_normalize, squeeze, tokens
from ..session import cut_lineage, running_total

# N-gram length, removed window, dirty cut-off, minimum kept slice, common threshold.
N, WINDOW, CUTOFF, MIN_SLICE, COMMON = 13, 200, 10, 200, 10
# Counting: bytes of text per bucket, n-grams per row of hashes, rows of a batch that two bytes can number.
BUCKET, RUN, SHORT = 1 << 25, 512, 1 << 16


def document_ngrams(docs: DataFrame, key: list[str], text: str = "text", n: int = N) -> DataFrame:
    """Distinct normalised n-grams of each document (repeats inside one document are dropped first)."""
    return docs.select(*key, F.explode(F.array_distinct(word_ngrams(ngram_normalize(text), n))).alias("ngram"))


def hashed_ngrams(docs: DataFrame, key: list[str], text: str = "text", n: int = N) -> DataFrame:
    """`document_ngrams` as 128-bit hashes (h1, h2): what is shuffled and joined in place of the texts."""
    return document_ngrams(docs, key, text, n).select(*key, *_hashes(n))


def _hashes(n: int) -> list:
    return [F.xxhash64("ngram").alias("h1"), F.xxhash64(F.lit(n), "ngram").alias("h2")]


def common_ngrams(docs: DataFrame, key: str, text: str = "text", n: int = N, more_than: int = COMMON) -> DataFrame:
    """N-grams found in more than ``more_than`` documents, with the number of documents.

    Each document offers an n-gram once; ``key`` should be unique and not null. Only 96-bit hashes are shuffled, packed so
    that none takes the space of a row: a task combines the n-grams of a batch of documents and deals them to
    buckets, whose number follows the size of the texts. The count names one document of each common n-gram, and
    its text is looked up in those few documents alone.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET + 1)
    kind = docs.schema[key].dataType.simpleString()
    # long documents are cut into runs of n-grams, which bounds a batch of rows
    run = lambda h, i: F.struct(F.slice(h["h1"], i + 1, RUN).alias("h1"), F.slice(h["h2"], i + 1, RUN).alias("h2"))
    runs = let(_gram_hashes(F.array_distinct(word_ngrams(ngram_normalize(text), n)), n), lambda h: F.when(
        F.size(h["h1"]) > 0, F.transform(F.sequence(F.lit(0), F.size(h["h1"]) - 1, F.lit(RUN)), lambda i: run(h, i))))
    packed = docs.select(F.col(key).alias("key"), F.explode(runs).alias("h")).select("key", "h.h1", "h.h2").mapInArrow(
        _pack(buckets), f"bucket int, h1 binary, h2 binary, n binary, doc binary, keys array<{kind}>")
    counts = cut_lineage(packed.groupBy("bucket").applyInArrow(_count(more_than), f"h1 bigint, h2 int, n_docs bigint, _doc {kind}"))
    wanted = counts.groupBy("_doc").agg(F.collect_list(F.struct("h1", "h2", "n_docs")).alias("w")).select(
        "_doc", F.col("w.h1").alias("w1"), F.col("w.h2").alias("w2"), F.col("w.n_docs").alias("n_docs"))
    # where keys repeat or are null after all, several documents are looked into and their answers united
    keys = docs.groupBy(key).agg(F.count("*").alias("n")).agg(F.max((F.col("n") > 1) | F.col(key).isNull())).first()[0]
    same = F.col("_key").eqNullSafe(F.col("_doc")) if keys else F.col("_key") == F.col("_doc")
    few = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL").join(wanted, same)
    words = tokens(ngram_normalize("_text"))
    found = few.select(F.array_join(words, " ").alias("text"), _gram_hashes(word_ngrams(ngram_normalize("_text"), n), n).alias("h"), "w1", "w2", "n_docs").select(
        "text", "h.h1", "h.h2", "w1", "w2", "n_docs").mapInArrow(_look_up(n), "ngram string, n_docs bigint")
    return found.groupBy("ngram").agg(F.max("n_docs").alias("n_docs")) if keys else found


def _gram_hashes(grams, n: int):
    """Two arrays that hash an array of n-grams, 64 and 32 bits."""
    return let(grams, lambda g: F.struct(F.transform(g, lambda x: F.xxhash64(x)).alias("h1"), F.transform(g, lambda x: F.hash(F.lit(n), x)).alias("h2")))


def _equal_runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that brings equal hashes together, and where each of them begins in it."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    new = a[1:] != a[:-1]
    if np.any(~new & (b[1:] != b[:-1])):  # two n-grams share the first hash
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), new]))


def _planes(a: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: the high bytes of small numbers compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _pack(buckets: int):
    """Per batch of (key, h1, h2): a row per bucket with the batch's distinct hashes, their numbers of rows and one key of each."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(i, SHORT) for b in batches for i in range(0, b.num_rows, SHORT))
        for b in parts:
            h1 = b.column("h1").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            h2 = b.column("h2").flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("h1")).to_numpy(zero_copy_only=False))
            order, starts = _equal_runs(h1, h2)
            n = np.diff(np.append(starts, len(order))).astype(np.uint32)
            first = order[starts]
            h1, h2, doc = h1[first], h2[first], doc[first]
            edges = np.searchsorted((h1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for k in np.flatnonzero(np.diff(edges)):
                at = slice(edges[k], edges[k + 1])
                used, place = np.unique(doc[at], return_inverse=True)
                out.append((int(k), _planes(np.diff(h1[at], prepend=np.uint64(0))), h2[at].tobytes(), n[at].tobytes(), place.astype(np.uint16).tobytes(), b.column("key").take(pa.array(used))))
            if out:
                k, *cells, keys = zip(*out)
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *[pa.array(c, pa.binary()) for c in cells], pa.ListArray.from_arrays(ends, pa.concat_arrays(keys))],
                                                 ["bucket", "h1", "h2", "n", "doc", "keys"])
    return packed


def _count(more_than: int):
    """Hashes of a bucket that more than ``more_than`` rows hold, with their number and one key."""
    def counted(t: pa.Table) -> pa.Table:
        col = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in t.column(c)), kind)
        steps = (np.frombuffer(x.as_py(), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel() for x in t.column("h1"))
        h1, h2, n = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps]), col("h2", np.int32), col("n", np.uint32)
        lists = t.column("keys").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        sizes = np.array([len(x.as_buffer()) // 2 for x in t.column("doc")])
        base = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)[:-1]])
        doc = col("doc", np.uint16) + np.repeat(base, sizes)
        order, starts = _equal_runs(h1, h2)
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        kept = total > more_than
        rep = order[starts[kept]]
        return pa.table([pa.array(h1[rep].view(np.int64)), pa.array(h2[rep]), pa.array(total[kept]), lists.flatten().take(pa.array(doc[rep]))],
                        ["h1", "h2", "n_docs", "_doc"])
    return counted


def _look_up(n: int):
    """The texts of a document's wanted n-grams: (ngram, n_docs)."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, counts = [], []
            for text, *lists in zip(*(b.column(c) for c in ("text", "h1", "h2", "w1", "w2", "n_docs"))):
                h1, h2, w1, w2, c = (x.values.to_numpy(zero_copy_only=False).tolist() for x in lists)
                wanted, words = dict(zip(zip(w1, w2), c)), text.as_py().split(" ")
                for i, h in enumerate(zip(h1, h2)):
                    if (docs := wanted.pop(h, None)) is not None:
                        grams.append(" ".join(words[i:i + n]))
                        counts.append(docs)
                if len(grams) > SHORT:
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["ngram", "n_docs"])
                    grams, counts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["ngram", "n_docs"])
    return found


def overlaps(train: DataFrame, train_key: str, evals: DataFrame, eval_key: str, text: str = "text", n: int = N) -> DataFrame:
    """(train_key, eval_key) pairs sharing at least one n-gram.

    Training n-grams are cut down to the evaluation vocabulary by a semi join first, so the only
    rows that meet in the pair join are real matches. Hashes stand for the n-grams throughout.
    """
    e = hashed_ngrams(evals, [eval_key], text, n)
    t = hashed_ngrams(train, [train_key], text, n).join(e.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    return t.join(e, ["h1", "h2"]).select(train_key, eval_key).distinct()


def contaminated(train: DataFrame, train_key: str, evals: DataFrame, eval_keys: list[str], text: str = "text", n: int = N) -> DataFrame:
    """Evaluation items that share an n-gram with any training document."""
    t = hashed_ngrams(train, [train_key], text, n).select("h1", "h2")
    return hashed_ngrams(evals, eval_keys, text, n).join(t, ["h1", "h2"], "left_semi").select(*eval_keys).distinct()


def clean_chunks(docs: DataFrame, key: str, dirt: DataFrame, text: str = "text", n: int = N, window: int = WINDOW,
                 cutoff: int = CUTOFF, min_slice: int = MIN_SLICE) -> DataFrame:
    """Clean pieces of each document around registered n-grams: (key, chunk_id, chunk).

    ``dirt``: registered n-grams (normalised). A document with more than ``cutoff`` matches yields
    nothing, so the first ``cutoff`` + 1 of them decide and only those are gathered.
    """
    # punctuation and case go, spaces stay: normalised words keep the positions of the raw ones
    aligned = F.split(ngram_normalize(squeeze(text)), " ")
    grams = F.transform(ngrams(aligned, n), lambda g: F.array_join(g, " "))
    hit = docs.select(key, F.posexplode(grams).alias("i", "ngram")).join(dirt.select("ngram").distinct(), "ngram", "left_semi")
    w = W.partitionBy(key).orderBy("i")
    few = hit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cutoff + 1).groupBy(key).agg(
        F.array_sort(F.collect_list("i")).alias("_i"))
    joined = docs.select(key, text).join(few, key, "left").withColumn("_n", F.length(text)).withColumn(
        "parts", F.when(F.size("_i") <= cutoff, F.transform("_i", lambda i: _span(F.col(text), i, n))).otherwise(
            F.when(F.size("_i") > cutoff, F.array_repeat(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")), cutoff + 1))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    # state: position behind the last cut, last end, kept (from, to) spans with `to` exclusive
    spans = F.aggregate(
        F.coalesce("parts", none),
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last"), F.array().cast("array<struct<a:int,b:int>>").alias("out")),
        lambda s, p: F.struct(
            F.least(F.col("_n"), p["end"] + window).alias("at"), F.least(F.col("_n"), p["end"] + window).alias("last"),
            F.when(F.greatest(F.lit(0), p["start"] - window) - s["at"] > min_slice, F.concat(s["out"], F.array(F.struct(
                s["at"].alias("a"), F.greatest(F.lit(0), p["start"] - window).alias("b"))))).otherwise(s["out"]).alias("out")),
        lambda s: F.when(s["last"] < F.col("_n") - min_slice, F.concat(s["out"], F.array(F.struct(
            (s["last"] + 1).alias("a"), F.col("_n").alias("b"))))).otherwise(s["out"]))
    kept = joined.withColumn("_s", F.when(F.size(F.coalesce("parts", none)) > cutoff, F.array().cast("array<struct<a:int,b:int>>")).otherwise(spans))
    return kept.select(key, F.posexplode("_s").alias("chunk_id", "_x"), text).select(
        key, "chunk_id", F.substring(F.col(text), F.col("_x.a") + 1, F.col("_x.b") - F.col("_x.a")).alias("chunk"))


def _span(text, i, n: int):
    """(start, end) character offsets of words i .. i+n-1: one scan with a constant-size state."""
    state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(s, p):
        blank = p == ""
        return F.struct(
            F.when(blank, s["k"]).otherwise(s["k"] + 1).alias("k"), (s["at"] + F.length(p) + 1).alias("at"),
            F.when(~blank & (s["k"] == i), s["at"]).otherwise(s["start"]).alias("start"),
            F.when(~blank & (s["k"] == i + n - 1), s["at"] + F.length(p) - 1).otherwise(s["end"]).alias("end"))
    return F.aggregate(F.split(text, PY_WS, -1), state, step, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def bucketed_ngrams(docs: DataFrame, key: str, buckets: int, text: str = "text", n: int = N) -> DataFrame:
    """N-gram rows spread over buckets by hash and sorted inside each, ready to be written."""
    rows = document_ngrams(docs, [key], text, n).withColumn("bucket", F.pmod(F.xxhash64("ngram"), F.lit(buckets)))
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ngram", key)


def document_offsets(docs: DataFrame, order_by: list[str], text: str = "text") -> DataFrame:
    """Size of every document and the bytes before it in the total order."""
    sized = docs.select(*order_by, F.octet_length(text).cast("bigint").alias("n_bytes"))
    return running_total(sized, order_by, "n_bytes", "offset")
