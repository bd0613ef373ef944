"""Removal of passages that repeat across documents, with a count-min prefilter.

A window is `WINDOW` consecutive words. Pass one counts windows in a count-min sketch: every task makes a
sparse sketch of its own documents, the sketches are merged cell by cell, and only "two or more" is kept,
one bit per cell. A window is counted under the smallest hash of the `GRAM`-word runs inside it, once per
document: equal windows share that key, so the estimate of a key is never below the number of documents
with the window, and a document has about 2 keys per `WINDOW - GRAM` words instead of one per word. Pass
two forms the windows whose estimate is two or more, groups exactly these by a 128-bit hash of their words
and takes the smallest document of each; a false alarm of the sketch only costs a row.

The merged sketch is the one thing sent to every task: at most 2 x `MAX_CELLS` bits (64 MB). Its width
follows the corpus (`CELLS_PER_KEY` cells per key) up to that bound; beyond, more windows reach the exact
grouping and the result is the same.

Documents with the same words are settled before: the smallest keeps the group's place, every window of
the others also starts in it. So a large group of copies forms no windows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import longs, save, tasks
from .words import chunks, mix, runs, sliding_min

WINDOW, GRAM = 50, 25
DEPTH, CELLS_PER_KEY = 2, 8
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 28
SLICE = 1 << 20
#: characters of running text for each key of a document: 6.5 a word, 13 words a key
CHARS_PER_KEY = 80
_U = np.uint64


def _window_keys(words: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Row, first word and key of every window of a chunk."""
    n = len(words) - gram + 1
    if n < window - gram + 1:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, _U)
    at = np.arange(n)
    low = sliding_min(runs(words, at, at + gram, 0x2545F4914F6CDD1D), window - gram + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(low)]
    first = np.arange(len(low))
    ok = first + window <= bounds[row + 1]
    return row[ok], first[ok], low[ok]


def _cells(keys: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Cell of every key in the sketch row ``depth``."""
    return mix(keys + _U((depth + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(width - 1)


def count(docs: DataFrame, width: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Pass one. Sketch rows (part, cells, many): the touched cells of one slice of a task's sketch and which
    of them were touched twice or more; document rows (doc_id, n, seq_a, seq_b): identity of the words."""
    names = ["part", "cells", "many", "doc_id", "n", "seq_a", "seq_b"]
    per = max(1, width // SLICE)

    def sketch(touched: list):
        for d in range(DEPTH):
            cells, times = np.unique(np.concatenate([_cells(k, d, width) for k in touched]), return_counts=True)
            part = (cells // _U(SLICE)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            stops = np.append(edges[1:], len(part))
            for a, b in zip(edges, stops):
                yield d * per + int(part[a]), (cells[a:b] % _U(SLICE)).astype(np.uint32).tobytes(), np.packbits(times[a:b] > 1).tobytes()

    def flush(touched):
        made = list(sketch(touched))
        nothing = pa.nulls(len(made), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary()),
                                          pa.array([m[2] for m in made], pa.binary()), *[nothing] * 4], names=names)

    def run(batches):
        touched, held = [], 0
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                words = chunk.hashes(False)
                row, _, key = _window_keys(words, chunk.bounds, window, gram)
                if len(key):
                    order = np.lexsort((key, row))
                    key, row = key[order], row[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                    touched.append(key[new])
                    held += int(new.sum())
                if held > 4_000_000:
                    yield from flush(touched)
                    touched, held = [], 0
                a, b = chunk.bounds[:-1], chunk.bounds[1:]
                void = pa.nulls(len(chunk), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(chunk), pa.int32()), void, void, ids.slice(chunk.rows.start, len(chunk)), pa.array(b - a),
                     longs(runs(words, a, b, 11)), longs(runs(words, a, b, 12))], names=names)
        if touched:
            yield from flush(touched)

    return tasks(docs, run, "part int, cells binary, many binary, doc_id long, n long, seq_a long, seq_b long")


def merge(sketches: DataFrame) -> DataFrame:
    """(part, bits): per slice one bit for every cell that holds two or more over all tasks' sketches.

    A merging task reads the sketches of its slices one by one and holds one counter array per slice."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, many in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                counts = held.setdefault(part, np.zeros(SLICE, np.uint8))
                at = np.frombuffer(cells.as_buffer(), np.uint32)
                more = np.unpackbits(np.frombuffer(many.as_buffer(), np.uint8), count=len(at))
                counts[at] = np.minimum(counts[at] + 1 + more, 2)
        for part, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["part", "bits"])

    return tasks(sketches.where("part IS NOT NULL").select("part", "cells", "many").repartition("part"), run, "part int, bits binary")


def repeated_windows(docs: DataFrame, shared, width: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Pass two: (h1, h2, doc_id, pos) of the windows whose sketch estimate is two or more."""
    per = max(1, width // SLICE)

    def run(batches):
        bits = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                words = chunk.hashes(False)
                row, first, key = _window_keys(words, chunk.bounds, window, gram)
                for d in range(DEPTH):
                    cell = _cells(key, d, width).astype(np.int64)
                    yes = (bits[d * per * (SLICE >> 3) + (cell >> 3)] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                    yes = yes.astype(bool)
                    row, first, key = row[yes], first[yes], key[yes]
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [longs(runs(words, first, first + window, 21)), longs(runs(words, first, first + window, 22)),
                         pa.array(ids[chunk.rows][row].astype(np.int64)), pa.array((first - chunk.bounds[row]).astype(np.int32))], names=["h1", "h2", "doc_id", "pos"])

    return tasks(docs, run, "h1 long, h2 long, doc_id long, pos int")


def sketch_width(chars: int) -> int:
    wanted = CELLS_PER_KEY * (chars // CHARS_PER_KEY + 1)
    return min(MAX_CELLS, max(MIN_CELLS, 1 << (wanted - 1).bit_length()))


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256): each word is removed that lies in a window whose
    words also start somewhere in a document with a smaller doc_id, judged on the input.

    Words are runs of anything but ASCII white space, unchanged; kept words are joined by one space. Null,
    empty and blank texts have no words and keep the empty text. A window that repeats only inside one
    document stays. Rows that share a doc_id are one document for this rule and are returned row by row; rows with
    a null doc_id keep all their words. Where rows of one doc_id differ in text, what is removed from one of them (a
    position, or all words of a copy) is removed from all.
    Other columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    gram = max(1, window // 2)
    width = sketch_width(known.agg(F.sum(F.length("text"))).first()[0] or 0)
    counted = save(count(known, width, window, gram), "sketches")
    bits = np.zeros(DEPTH * max(1, width // SLICE) * (SLICE >> 3), np.uint8)
    for r in merge(counted).toLocalIterator():
        bits[r.part * (SLICE >> 3): (r.part + 1) * (SLICE >> 3)] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    seen = counted.where("part IS NULL")
    # written first, so that the join below has exchanges of its own whose hot keys can be split
    same = save(seen.groupBy("n", "seq_a", "seq_b").agg(F.min("doc_id").alias("lead"), F.count("*").alias("c")).where("c > 1"), "same")
    copies = save(seen.join(same, ["n", "seq_a", "seq_b"]).where("doc_id > lead").select("doc_id", F.lit(True).alias("copy")).distinct(), "copies")
    found = repeated_windows(known.join(copies, "doc_id", "left_anti"), shared, width, window, gram)
    multi = save(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "repeated")
    hits = save(found.join(multi, ["h1", "h2"]).where("doc_id > lo").select("doc_id", "pos"), "hits")
    hits = hits.groupBy("doc_id").agg(F.collect_list("pos").alias("hits"))

    def run(batches):
        for batch in batches:
            ids, texts, at, copy = (batch.column(i) for i in range(4))
            out = []
            for t, h, c in zip(texts, at, copy):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                n = len(words)
                if c.as_py() and n >= window:
                    words = []
                elif h.is_valid:
                    starts = np.sort(h.values.to_numpy())
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:n]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return tasks(docs.join(hits, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "hits", "copy"), run,
                 "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
