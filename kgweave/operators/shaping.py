"""Document filters, chunking, sharding, batching and sample limits."""
from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from ..functions.text import PY_WS, _col, squeeze
from ..session import dense_index

# Languages with their own extraction prompts, and the default one.
LANGUAGES = ("en", "zh-CN", "zh-HK")
DEFAULT_LANGUAGE = "en"
# Token limit, tokens reserved for the instruction, characters per token.
MAX_TOKENS, INSTRUCTION_TOKENS, CHARS_PER_TOKEN = 1024, 200, 3.5
# Width and overlap of the sentence-aware chunker.
SENTENCE_CHUNK, SENTENCE_OVERLAP = 1024, 100
SAMPLE_CHUNKS = 20


def chunk_width(max_tokens: int = MAX_TOKENS, instruction_tokens: int = INSTRUCTION_TOKENS) -> int:
    return int((max_tokens - instruction_tokens) * CHARS_PER_TOKEN)


def filter_language(docs: DataFrame, lang: str = "lang", supported=LANGUAGES) -> DataFrame:
    """Keep documents of a supported language; a missing language counts as English."""
    return docs.filter(F.coalesce(F.col(lang), F.lit(DEFAULT_LANGUAGE)).isin(*supported))


def fixed_chunks(text, width: int | None = None) -> Column:
    """Consecutive pieces of at most ``width`` characters; no piece for an empty text."""
    w = width or chunk_width()

    def pieces(t):
        n = F.length(t)
        return F.when(
            n > 0,
            F.transform(F.sequence(F.lit(0), F.floor((n - 1) / w).cast("int")),
                        lambda i: F.substring(t, i * w + 1, F.lit(w))),
        ).otherwise(F.array().cast("array<string>"))
    return let(text, pieces)


def chunk_documents(docs: DataFrame, text: str = "text", width: int | None = None,
                    remove_spaces: bool = False) -> DataFrame:
    """One row per chunk with a zero-based ``chunk_id``; the other columns are carried along."""
    src = squeeze(text) if remove_spaces else F.col(text)
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(fixed_chunks(src, width)).alias("chunk_id", text))


def sentence_ends(text: str, size: int = SENTENCE_CHUNK, overlap: int = SENTENCE_OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows of a text longer than ``size``.

    A window ends behind its last full stop if that lies in its second half, else after ``size``
    characters; the next one starts ``overlap`` characters before that end. Full stops are found
    once, and each window looks its last one up by bisection.
    """
    stops = [m.end() for m in re.finditer(r"\.", text)]
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            last = bisect.bisect_right(stops, end)
            if last and stops[last - 1] > start + size // 2 + 1:
                end = stops[last - 1]
        yield start, end
        start = max(end - overlap, start + 1)


def sentence_spans(text: str, size: int = SENTENCE_CHUNK, overlap: int = SENTENCE_OVERLAP) -> list[str]:
    """Overlapping chunks that prefer to end at a full stop in their second half."""
    if len(text) <= size:
        return [text]
    return [piece for a, b in sentence_ends(text, size, overlap) if (piece := text[a:b].strip())]


def sentence_chunks(docs: DataFrame, text: str = "text", size: int = SENTENCE_CHUNK,
                    overlap: int = SENTENCE_OVERLAP) -> DataFrame:
    """Sentence-aware chunks with ``chunk_id``, ``total_chunks`` and ``original_length``.

    Each cut depends on the previous one, so one Arrow-batched function cuts a whole document;
    documents stay independent and need no shuffle.
    """
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: sentence_spans(t or "", size, overlap))

    keep = [c for c in docs.columns if c != text]
    return (
        docs.withColumn("_parts", cut(F.col(text)))
        .withColumn("original_length", F.length(text))
        .withColumn("total_chunks", F.size("_parts"))
        .select(*keep, "original_length", "total_chunks",
                F.posexplode("_parts").alias("chunk_id", text))
    )


def chunk_key(file_id, chunk_id) -> Column:
    return F.concat_ws("_", F.coalesce(_col(file_id).cast("string"), F.lit("unknown")),
                       _col(chunk_id).cast("string"))


def balanced_shards(docs: DataFrame, order_by: list[str], shards: int) -> DataFrame:
    """Contiguous shards in order; the first ``N mod shards`` hold one document more."""
    rows = dense_index(docs, order_by, "pos")
    base, extra = divmod(rows.count(), shards)
    head = extra * (base + 1)
    shard = F.when(F.col("pos") < head, F.floor(F.col("pos") / (base + 1))).otherwise(
        extra + F.floor((F.col("pos") - head) / max(base, 1)))
    return rows.withColumn("shard", shard.cast("int"))


def hashed_shards(rows: DataFrame, key: list[str], shards: int, seed: int = 42) -> DataFrame:
    """Equal slices of ``ceil(N / shards)`` rows in a seeded pseudo-random order.

    The shuffle is a pure function of key and seed, so separately started shards never overlap.
    """
    mixed = rows.withColumn("_mix", F.xxhash64(F.lit(seed), *key))
    pos = dense_index(mixed, ["_mix", *key], "pos")
    width = max(1, -(-pos.count() // shards))
    return pos.withColumn("shard", F.floor(F.col("pos") / width).cast("int")).drop("_mix")


def batches(rows: DataFrame, order_by: list[str], size: int, resume_from: int = 0) -> DataFrame:
    """Number fixed-size batches in order, skipping the first ``resume_from`` of them."""
    out = dense_index(rows, order_by, "pos").withColumn("batch", F.floor(F.col("pos") / size).cast("bigint"))
    return out.filter(F.col("pos") >= resume_from * size) if resume_from else out


def worklist_batches(worklist: DataFrame, size: int, type_col: str = "Type", name_col: str = "Name") -> DataFrame:
    """Batches of events, then entities, then relations; a batch never mixes kinds."""
    kind = F.lower(type_col)
    rank = F.when(kind == "event", 0).when(kind == "entity", 1).when(kind == "relation", 2)
    rows = worklist.withColumn("kind", kind).withColumn("_k", rank).filter(F.col("_k").isNotNull())
    pos = dense_index(rows, ["_k", name_col], "pos")
    starts = pos.groupBy("_k").agg(F.min("pos").alias("_s"))  # three rows
    return (pos.join(F.broadcast(starts), "_k")
            .withColumn("batch", F.floor((F.col("pos") - F.col("_s")) / size).cast("bigint"))
            .drop("_k", "_s"))


def debug_sample(docs: DataFrame, order_by: list[str], text: str = "text", width: int | None = None,
                 chunks: int = SAMPLE_CHUNKS) -> DataFrame:
    """Smallest prefix of documents holding at least ``chunks`` chunks (a debugging switch).

    Every counted document has one chunk or more, so only the first ``chunks`` of them matter:
    the running sum is over that many rows, never over the collection.
    """
    from pyspark.sql import Window as W
    w = width or chunk_width()
    n = F.ceil(F.length(text) / w)
    head = docs.withColumn("_n", n).filter("_n > 0").orderBy(*order_by).limit(chunks)
    before = F.coalesce(F.sum("_n").over(W.orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("_before", before).filter(F.col("_before") < chunks).drop("_n", "_before")


def strided(rows: DataFrame, pos: str, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Documents of one evaluation rank: every ``world``-th below ``limit``."""
    out = rows.filter(F.col(pos) % world == rank)
    return out if limit is None else out.filter(F.col(pos) < limit)


def sample_limit(n_docs: int, limit: float | None) -> int | None:
    """Number of documents to use: a share when below one, else a count."""
    import math
    if limit is None:
        return None
    return int(math.ceil(n_docs * limit)) if limit < 1 else int(limit)


def match_names(names: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Shell-style selection of task or tag names."""
    import fnmatch
    rx = "|".join(fnmatch.translate(p) for p in patterns)
    return names.filter(F.col(col).rlike(rx))


def nonblank_pairs(rels: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return rels.filter(~F.col(source).rlike(f"^{PY_WS}*$") & ~F.col(target).rlike(f"^{PY_WS}*$"))
