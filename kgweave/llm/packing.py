"""Best-fit packing of token sequences, planned over a histogram of lengths.

One pass tokenises each whole text and cuts it; what remains of a document is a row per piece. The plan is
made over at most `SEQUENCE` counts, one per length, never over documents: best-fit decreasing moves whole
runs of equal sequences at a time. Pieces take their planned places by a join on length and rank within
the length; ranks come from hash-salted sub-ranks and a prefix sum of the salts' counts, so that a length
shared by a third of all pieces is numbered by many tasks.
"""
from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import dense_index
from .common import per_worker, save, tasks

SEQUENCE = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
#: pieces that one salt numbers, and ranks per join block
SALT_ROWS, BLOCK = 5_000, 4_096


class Encoder:
    """The ids that the `tokenizers` library gives for a byte-level BPE file without special tokens added.

    The vocabulary is read from that file and run by tiktoken, which gives the same ids in a quarter of the
    time; texts with the special token's own string, and those that tiktoken refuses, go through `tokenizers` itself."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its regular expression gives up on very long runs of white space
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id; only documents longer
    than ``size`` are cut, the first piece taking what does not fill a sequence."""
    def run(batches):
        encode = per_worker(f"encoder:{tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            out = []
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                cut = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
                raw = memoryview(ids.tobytes())
                out += [(doc, i, a, b - a, zlib.crc32(raw[4 * a: 4 * b]), at) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return tasks(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")


def plan(counts: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple], int]:
    """Best-fit decreasing over a histogram: runs (length, rank0, ranks, each, sequence0, offset0) and the
    number of sequences. Ranks of a run fill sequence0, sequence0 + 1, ... with ``each`` pieces a sequence.

    All sequences that are equally full are runs of numbers in one shelf; a step fills a whole run, or what
    the length has left, so the work depends on the histogram and not on the number of pieces."""
    shelves: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    out, made = [], 0

    def put(room: int, first: int, n: int):
        if n and room:
            if room not in shelves:
                shelves[room] = []
                bisect.insort(order, room)
            shelves[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = shelves[room].pop()
                if not shelves[room]:
                    del shelves[room], order[at]
            else:
                room, first = size, made
                n = -(-left // (size // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, each, first, size - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than ``each`` remain
                out.append((length, rank, left, left, first + full, size - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return out, made


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Append ``rank``: a dense number from 0 within each value of ``by``."""
    salts = 1 + rows.count() // SALT_ROWS
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = W.partitionBy(by).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n")).select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(by, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_own", own).join(starts, [by, "_salt"]).withColumn("rank", F.col("_start") + F.col("_own")).drop("_salt", "_own", "_start")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, key: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    A null or empty text is the end id alone. Repeated rows are packed once each. Pieces of one length are
    interchangeable; ties follow doc_id, piece and start. With ``place``, a column of longs, pieces of one length take
    their places in its order, so that documents that come early share sequences as far as lengths allow. Other columns are ignored; an empty table gives an
    empty table.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       (F.lit(0) if place is None else F.coalesce(place, F.lit(0))).cast("long").alias("place"))
    cut = save(pieces(docs, tokenizer or default_tokenizer(), size), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    runs, _ = plan(counts, size)
    places = docs.sparkSession.createDataFrame(runs, "length long, rank0 long, ranks long, each long, sequence0 long, offset0 long")
    places = places.withColumn("block", F.explode(F.sequence(F.floor(F.col("rank0") / BLOCK), F.floor((F.col("rank0") + F.col("ranks") - 1) / BLOCK))))
    if place is None:
        numbered = ranked(cut, "length", ["doc_id", "piece", "start"])
    else:
        sorted_ = dense_index(cut, ["length", "place", "doc_id", "piece", "start"], "_pos")
        firsts = sorted_.groupBy("length").agg(F.min("_pos").alias("_first"))  # at most ``size`` rows
        numbered = sorted_.join(F.broadcast(firsts), "length").withColumn("rank", F.col("_pos") - F.col("_first"))
    numbered = numbered.withColumn("block", F.floor(F.col("rank") / BLOCK))
    step = F.col("rank") - F.col("rank0")
    return (numbered.join(places, ["length", "block"]).where((F.col("rank") >= F.col("rank0")) & (step < F.col("ranks")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("sequence0") + F.floor(step / F.col("each"))).alias("sequence_id"),
                    (F.col("offset0") + step % F.col("each") * F.col("length")).alias("offset")))
