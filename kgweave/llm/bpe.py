"""Byte-level BPE encoding and decoding of whole texts, merged on contiguous rank arrays.

A text is cut at the strings of added tokens, then into words by the public pattern of byte-level BPE. A short
word is one row of parts (its boundaries are the columns) and one row of the ranks of adjacent parts, both
contiguous: the minimum is found by a scan, its boundary is deleted, which moves what follows one column to the
left, and only the two neighbouring ranks are looked up again. The rows of many new words lie under each other
in one numpy array, and every step scans, deletes and refreshes all of them at once.

The scan is quadratic in the word, so a word longer than `SHORT` bytes (a line of one letter, a run of spaces) is
merged by a heap over linked parts, in the same order and with the same result. Ids of words seen before come
from a bounded table in the worker, as words repeat far more often than they are new.

Everything happens inside map-only tasks; a batch is handed on as soon as it holds `BATCH_BYTES`.
"""
from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import per_worker, tasks

#: bytes up to which a word is merged on a rank array, and the widths of the arrays
SHORT, WIDTHS = 256, (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
#: words and characters after which a worker's table starts anew
TABLE_WORDS, TABLE_CHARS = 1 << 19, 1 << 24
#: characters of texts that are worked on together, and bytes of ids or text in one batch
STRETCH, BATCH_BYTES = 1 << 21, 8 << 20
NONE = (1 << 31) - 1
# The bytes that byte-level vocabularies write as themselves; the others follow from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=8)
def newer_characters(path: str) -> str:
    """Characters that this Python's tables call letters or numbers and the tokenizer's older ones do not.

    The tokenizer's own pre-tokenizer is asked once per process: a letter joins a letter before it, a number a
    number. Such characters are cut like other marks. The answer is a few dozen ranges, as a character class."""
    import regex
    from tokenizers import Tokenizer

    cutter = Tokenizer.from_file(path).pre_tokenizer
    other = []
    for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        chars = regex.findall(kind, "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)])))
        ends = {b for _, (_, b) in cutter.pre_tokenize_str("".join(before + c + "\n" for c in chars))}
        other += [ord(c) for i, c in enumerate(chars) if 3 * i + 1 in ends]
    ranges: list[list[int]] = []
    for c in sorted(other):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, newer: str):
        import re

        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}
        raw = lambda token: bytes(byte[c] for c in token)
        model = spec["model"]
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        self.first = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.made = np.array([vocab[raw(a) + raw(b)] for a, b in pairs], np.int32)
        self._hash(np.array([(vocab[raw(a)] << 32) | vocab[raw(b)] for a, b in pairs], np.int64))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.edge = regex.compile(r"\S(?=\s)")
        # most texts have no character as high as the first newer one
        self.high = re.compile(f"[{newer[:10]}-\\U0010ffff]") if newer else None
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.table: dict[str, bytes] = {}
        self.held = 0

    def _hash(self, keys: np.ndarray):
        """Open-addressing table of the pairs (left id, right id), at most a quarter full."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            taken, one = np.unique(slot[free], return_index=True)  # the first of those that meet in a slot
            placed = np.flatnonzero(free)[one]
            self.keys[taken], self.rank[taken] = keys[todo[placed]], todo[placed]
            left = np.ones(len(todo), bool)
            left[placed] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of part ids; `NONE` for pairs that never merge, as those beside padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64) & 0xFFFFFFFF
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.rank[slot], NONE)
        todo = np.flatnonzero((at != keys) & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out

    def short(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of words of 1 to ``width`` bytes: parts and ranks of adjacent parts, a row per word; in each
        step the leftmost least rank of every row is merged, until a row has none left."""
        size = np.array([len(w) for w in words])
        parts = np.full((len(words), width), -1, np.int32)
        parts[np.arange(width) < size[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width - 1)
        row, done = np.arange(len(words)), [b""] * len(words)
        while len(row):
            low = ranks.min(axis=1) if ranks.shape[1] else np.full(len(row), NONE)
            over = low == NONE
            if over.any():
                whole = parts[over]
                packed, ends = whole[whole >= 0].astype("<u4").tobytes(), np.cumsum((whole >= 0).sum(axis=1) * 4).tolist()
                for r, a, b in zip(row[over].tolist(), [0, *ends], ends):
                    done[r] = packed[a:b]
                row, parts, ranks, low = row[~over], parts[~over], ranks[~over], low[~over]
                if not len(row):
                    break
            at, each = ranks.argmin(axis=1), np.arange(len(row))
            parts[each, at] = self.made[low]
            col = np.arange(parts.shape[1] - 1)
            parts = np.where(col <= at[:, None], parts[:, :-1], parts[:, 1:])
            ranks = np.where(col[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for side in (at, at - 1):  # the pairs that begin and end with the new part
                ok = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[ok, side[ok]] = self.ranks(parts[ok, side[ok]], parts[ok, side[ok] + 1])
        return done

    def long(self, word: bytes) -> bytes:
        """The same merges in the same order, from a heap of (rank, place) over linked parts."""
        n = len(word)
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        ranks = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist() + [NONE]
        before, after = list(range(-1, n)), list(range(1, n + 2))
        known: dict[tuple[int, int], int] = {}

        def look(i: int) -> int:
            if after[i] >= n:
                return NONE
            pair = (parts[i], parts[after[i]])
            if pair not in known:
                known[pair] = int(self.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
            return known[pair]

        heap = [(r << 32) | i for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if ranks[i] != top >> 32:
                continue
            parts[i], gone = int(self.made[top >> 32]), after[i]
            after[i], ranks[gone] = after[gone], NONE
            before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0:
                    ranks[j] = look(j)
                    if ranks[j] != NONE:
                        heapq.heappush(heap, (ranks[j] << 32) | j)
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def learn(self, words: set[str]):
        """Ids of new words into the table."""
        raw = sorted((w.encode() for w in words), key=len)
        names = [r.decode() for r in raw]
        sizes, a = [len(r) for r in raw], 0
        for width in WIDTHS:
            b = bisect.bisect_right(sizes, width)
            if b > a:
                self.table.update(zip(names[a:b], self.short(raw[a:b], width)))
            a = b
        for name, word in zip(names[a:], raw[a:]):
            self.table[name] = self.long(word)

    def stretches(self, text: str) -> Iterator[tuple[int, int]]:
        """Cuts of about `STRETCH` characters between a word and the white space after it, where no word spans."""
        a = 0
        while len(text) - a > STRETCH:
            edge = self.edge.search(text, a + STRETCH - 1)
            if edge is None:
                break
            yield a, edge.end()
            a = edge.end()
        yield a, len(text)

    def pieces(self, text: str) -> Iterator[bytes | list[str]]:
        """Packed ids of added tokens, and the words between them, in order."""
        for i, section in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                yield self.added[section].to_bytes(4, "little")
                continue
            # characters that the tokenizer's tables do not know are cut as marks, in the same places
            shape = section if self.newer is None or section.isascii() or not self.high.search(section) else self.newer.sub("!", section)
            for a, b in self.stretches(shape):
                found = self.words.findall(shape, a, b)
                if shape is not section:
                    ends = [a, *itertools.accumulate(map(len, found), initial=a)][1:]
                    found = [section[x:y] for x, y in zip(ends, ends[1:])]
                yield found

    def ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.table.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers.

        The new words of up to `STRETCH` characters are learnt together; a longer text goes on its own, one
        stretch after the other."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes | list[str]]] = []
        chars = 0

        def flush():
            new = {w for _, piece in waiting if isinstance(piece, list) for w in piece if w not in self.table}
            self.held += sum(map(len, new))
            if len(self.table) + len(new) > TABLE_WORDS or self.held > TABLE_CHARS:
                self.table.clear()
                new = {w for _, piece in waiting if isinstance(piece, list) for w in piece}
                self.held = sum(map(len, new))
            self.learn(new)
            for i, piece in waiting:
                out[i].append(self.ids(piece) if isinstance(piece, list) else piece)
            waiting.clear()

        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                waiting.append((i, piece))
                chars += sum(map(len, piece)) if isinstance(piece, list) else 1
                if chars >= STRETCH:
                    flush()
                    chars = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, added tokens included; ids without a token add nothing and bytes that are no UTF-8
        become the replacement character."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _vocabulary(path: str, newer: str) -> Vocabulary:
    return per_worker(f"bpe:{path}:{newer}", lambda: Vocabulary(path, newer))


def _groups(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of about `STRETCH` characters; null texts count as empty."""
    held, first, group = 0, 0, []
    for i, text in enumerate(texts, 1):
        group.append(text.as_py() or "")
        held += len(group[-1])
        if held >= STRETCH or i == len(texts):
            yield keys.slice(first, i - first), group
            held, first, group = 0, i, []


def encode(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """(key, n_tokens, ids) of every whole text: the ids that the tokenizers library gives for this file, without
    special tokens added, truncation or padding; an added token's own string in a text is that token.

    ``ids`` is an array, or with ``packed`` the ids as little-endian unsigned 32-bit integers. A null or empty
    text has no ids. A null key stays null, repeated rows give equal rows, other columns are ignored, and an
    empty table gives an empty table. ``tokenizer`` is a path that every executor can read.
    """
    path = tokenizer or default_tokenizer()
    newer = newer_characters(path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        vocabulary = _vocabulary(path, newer)
        for batch in batches:
            for keys, texts in _groups(batch.column(0), batch.column(1)):
                packs = vocabulary.encode(texts)
                counts = np.array([len(p) // 4 for p in packs])
                ids = pa.array(packs, pa.binary()) if packed else pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.frombuffer(b"".join(packs), "<i4")))
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), ids], names=["key", "n_tokens", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return tasks(rows, run, f"key {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}").withColumnRenamed("key", key)


def decode(rows: DataFrame, tokenizer: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with ``into``: the text of the ids, an array or packed, as the tokenizers library decodes them with
    special tokens kept. Null or no ids give an empty text, an id without a token or a null in an array adds
    nothing. A column that is called like ``into`` is replaced."""
    path = tokenizer or default_tokenizer()
    rows = rows.drop(into)
    packed = rows.schema[ids].dataType.simpleString() == "binary"
    place = rows.columns.index(ids)

    def numbers(value) -> np.ndarray:
        if not value.is_valid:
            return np.empty(0, np.int64)
        return np.frombuffer(value.as_buffer(), "<u4") if packed else value.values.drop_null().to_numpy()

    def run(batches):
        text = _vocabulary(path, "").decode
        for batch in batches:
            made, held, first = [], 0, 0
            for i, value in enumerate(batch.column(place), 1):
                made.append(text(numbers(value)))
                held += len(made[-1])
                if held >= BATCH_BYTES or i == batch.num_rows:
                    part = batch.slice(first, i - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, into])
                    made, held, first = [], 0, i

    return tasks(rows, run, StructType([*rows.schema.fields, StructField(into, StringType())]))
