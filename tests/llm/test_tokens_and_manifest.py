"""BPE, fill-in-middle and the Merkle manifest against the library or brute force, with nulls, empty and very
long texts, repeated rows, empty tables and clashing extra columns."""
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import bpe, fill_in_middle, merkle
from kgweave.llm.queries import QUERIES

LONG = 2_000_000
ODD = [*map(chr, range(32, 127)), *"\t\n\r\x0b\x0c\x1c\x1f\x00\x85\xa0  　՘֋̀١‍\U0001f600\U0002b73a\U00011de0éß中"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def texts(seed=3, n=120):
    r = np.random.default_rng(seed)
    out = ["", None, " ", "\n \n", "word", " two words ", "<|endoftext|>", "a<|endoftext|> b<|endof", "<P>x", "a<S b", "x<M>"]
    out += ["".join(r.choice(ODD, int(r.integers(0, 80)))) for _ in range(n)]
    return out + ["it's  we'll I'D " * 20, "repeat", "repeat"]


def frame(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "x", 7, b"z", [1]) for i, t in rows],
                                 "doc_id long, text string, key string, n long, ids binary, parts array<int>").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_encode_and_decode_equal_the_library(spark, library):
    rows = [*enumerate(texts()), (None, "no id"), (5, " two words ")]
    encoded = bpe.encode(frame(spark, rows))
    got = bpe.decode(encoded.withColumn("decoded", F.lit("old"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    want = [(i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids, _ in want]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) for r in got)
    packed = {r.doc_id: bytes(r.ids) for r in bpe.encode(frame(spark, rows), packed=True).collect()}
    assert packed == {i: np.array(ids, "<u4").tobytes() for i, ids, _ in want}


def test_texts_of_many_stretches_and_tables_that_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 40)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 30)
    path = bpe.default_tokenizer()
    v = bpe.Vocabulary(path, bpe.newer_characters(path))
    some = [t or "" for t in texts(9)] + [" ".join(t or "" for t in texts(4))]
    assert v.encode(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


@pytest.mark.parametrize("name, text", [
    ("spaces", " " * LONG), ("lines", "\n" * (LONG // 4) + "x"), ("letters", "ab" * (LONG // 8)), ("marks", "!?" * (LONG // 16)), ("digits", "7" * LONG),
    ("mixed", "a1" * (LONG // 4)), ("words", "some words " * (LONG // 11)), ("accents", "é" * (LONG // 4))])
def test_long_runs(library, name, text):
    path = bpe.default_tokenizer()
    v = bpe.Vocabulary(path, bpe.newer_characters(path))
    ids = v.encode([text])[0]
    assert v.decode(np.frombuffer(ids, "<u4")) == text
    assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_rank_array_equals_the_heap():
    path = bpe.default_tokenizer()
    v = bpe.Vocabulary(path, "")
    r = np.random.default_rng(0)
    words = sorted((bytes(r.choice(list(b"abcehtrs "), int(r.integers(1, 60))).tolist()) for _ in range(400)), key=len)
    assert v.short(words, 64) == [v.long(w) for w in words]


def test_decode_of_any_ids(spark, library):
    rows = [(1, [0, 50256, 5]), (2, [222, 0]), (3, []), (4, None), (5, [10 ** 6, 64, None])]
    got = {r.k: r.text for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), into="text").collect()}
    assert got == {1: library.decode([0, 50256, 5], skip_special_tokens=False), 2: library.decode([222, 0], skip_special_tokens=False), 3: "", 4: "", 5: "a"}


def test_bpe_of_an_empty_table(spark):
    assert bpe.decode(bpe.encode(frame(spark, []))).count() == 0


UNIT = re.compile(fill_in_middle.UNIT)


def brute_middle(i, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"{seed}:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark):
    rows = [*enumerate(texts()), (None, "no id at all"), (4, "word"), *((1000 + i, "of $1 \\ words\n" * 3) for i in range(40))]
    got = fill_in_middle.restore(fill_in_middle.fill_in_middle(frame(spark, rows))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(
        ((i, *brute_middle(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("unit", [" ", "x", "a b ", "é\n", "<", "\U0001f600 "])
def test_fill_in_middle_of_long_texts(spark, unit):
    text = unit * (LONG // len(unit))
    rows = [(i, text) for i in range(6)]
    got = fill_in_middle.restore(fill_in_middle.fill_in_middle(frame(spark, rows))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("restored", 256)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *(x := brute_middle(i, t))[:4], sha(x[4]), sha(t)) for i, t in rows)


def test_fill_in_middle_marks(spark):
    other = ("[PRE]", "(suf)", "{$mid}")
    rows = [(i, f"some few words {i}") for i in range(30)]
    got = fill_in_middle.restore(fill_in_middle.fill_in_middle(frame(spark, rows), marks=other, fim_percent=100), marks=other).collect()
    assert all(r.restored == f"some few words {r.doc_id}" and all(m in r.output for m in other) for r in got)
    assert fill_in_middle.fill_in_middle(frame(spark, [])).count() == 0
    for bad in (("", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "x<P>x", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(frame(spark, rows), marks=bad)


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        out = []
        for nodes in levels[:-1]:
            a = i - i % 8
            out.append((i - a, nodes[a:i] + nodes[i + 1:a + 8]))
            i //= 8
        return out

    trees = {}
    for r in rows:
        leaf = sha("".join(map(part, r)))
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if hit else r[4]
        trees.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf), r[0], leaf, sha("".join(map(part, (*r[:4], low))))))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort()
    levels = {x: climb([r[2] for r in trees[x]]) for x in names}
    top = climb([levels[x][-1][0] for x in names])
    out = []
    for j, x in enumerate(names):
        for i, (_, doc, leaf, found) in enumerate(trees[x]):
            proof, node = way(levels[x], i) + way(top, j), found
            for place, others in proof:
                node = sha("".join(others[:place] + [node] + others[place:]))
            out.append((doc, leaf, levels[x][-1][0], top[-1][0], sha("".join(s for _, o in proof for s in o)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "extra", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, at int, total int").repartition(3)
    got = merkle.manifest(docs, merkle.tampered, **how)
    siblings = F.array_join(F.flatten(F.transform("proof", lambda level: level.siblings)), "")
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), "folded_root", "verified").collect()), key=str)


def documents(n, langs=("en", None, "de", "é", "Z", "")):
    r = np.random.default_rng(n)
    return [(2 ** 60 + i if i % 11 == 0 else i, None if i % 5 == 0 else f"s{i % 3}", langs[0] if i % 2 else langs[int(r.integers(0, len(langs)))], None if i % 7 == 0 else i,
             None if i % 13 == 0 else "" if i % 17 == 0 else f"Text {i} Ä") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_manifest_equals_brute_force(spark, n):
    rows = documents(n)
    assert manifest_rows(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_passes(spark, levels):
    """Superblocks of 8 and 64 nodes, so that trees and the tree over them need several passes."""
    rows = documents(600, ["en", *(f"l{i}" for i in range(70))])
    assert manifest_rows(spark, rows, depth=levels) == brute_manifest(rows)


def test_manifest_of_repeated_and_null_rows(spark):
    rows = documents(30) + [(None, None, None, None, None)] * 20 + [(3, "s0", "en", 3, "Text 3 Ä")] * 20 + [(None, "a", "en", 1, "B")] * 3 + [(5, "a", "en", 1, "x" * LONG)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)
    assert manifest_rows(spark, []) == []


def test_manifest_finds_changes_only(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(100)], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.manifest(docs).where("verified").count() == 100
    other = lambda d: [F.when(F.col("doc_id") == 7, "new").otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.LEAF_COLUMNS]
    got = merkle.manifest(docs, other)
    assert [r.doc_id for r in got.where("NOT verified").collect()] == [7]
    assert all(merkle.fold(r.leaf, [(p.place, p.siblings) for p in r.proof]) == r.root for r in got.collect())


def test_registered_columns(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, columns in (("op11_bpe_rank_array", "doc_id n_tokens ids_sha256 decoded_sha256"), ("op12_fill_in_middle", "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256"),
                          ("op13_merkle_manifest", "doc_id leaf subroot root proof_sha256 folded_root verified")):
        df = QUERIES[name](spark, folder)
        assert df.columns == columns.split() and df.count() == n
