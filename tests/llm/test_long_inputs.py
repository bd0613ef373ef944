"""Inputs that once broke an operator: long runs, open cells, repeated rows."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import html_lstm, packing, pii_surrogates, substring_dedup

LONG = 2_000_000


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "7", "\u00a0"])
def test_packing_encodes_long_runs(unit):
    encode = packing.Encoder(packing.default_tokenizer())
    from tokenizers import Tokenizer

    text = unit * LONG
    assert encode(text).tolist() == Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_repeated_rows_are_returned_once_each(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (5, text), (5, text), (7, "x y")]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 80, 0), (5, 80, 80), (5, 80, 80), (7, 2, 0)]


def test_surrogates_of_long_runs(spark):
    runs = ["x@" + "a." * 200_000 + "com", "x@" + "a-" * 200_000, "@" * 400_000, "1." * 200_000, "+1 " * 100_000, "Mr " * 100_000, "1234 " * 80_000, "a-" * 200_000 + "@b.org"]
    got = pii_surrogates.replace_entities(spark.createDataFrame([*enumerate(runs), (99, "a@b.org")], "doc_id long, text string"))
    assert got.count() == len(runs) + 1


def test_addresses_keep_their_bounds(spark):
    mails = ["a@b.org", "a@b.co.uk.", "a@b.org1", "a@b..org", "x.y@sub-1.b.de, z"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in mails], "t string").select(F.regexp_extract("t", pii_surrogates.EMAIL, 0)).collect()]
    assert got == ["a@b.org", "a@b.co.uk", "a@b.org", "", "x.y@sub-1.b.de"]


def test_open_cells_are_siblings():
    page = "<table>" + "<tr><td>x<td>y" * 10_000 + "</table><dl>" + "<dt>a<dd>b" * 100 + "</dl><p>end"
    began = time.time()
    got = html_lstm.blocks(page)
    assert html_lstm.vectors(got).shape[0] == len(got) == 20_201 and max(len(b.path) for b in got) <= 4
    assert time.time() - began < 20


def test_cells_of_an_inner_table_stay_inside():
    got = html_lstm.blocks("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>")
    depth = {b.text: len(b.path) for b in got}
    assert depth["a"] == depth["d"] == 3 and depth["b"] == depth["c"] == 6


def test_page_sample_is_the_same_for_repeated_rows(spark):
    page = "<html><body><article><p>Some words of the story are here.</p></article><nav>menu</nav></body></html>"
    rows = [(None, "u", page)] * 30 + [(i, "u", page.replace("story", f"story {i}")) for i in range(20)]
    got = html_lstm.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.count() == 50 and np.all([r.n_chars == len(r.text) for r in got.collect()])
