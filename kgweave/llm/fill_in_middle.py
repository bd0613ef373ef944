"""Fill-in-middle transformation with a counted regular expression per row.

A text is a run of units (a word with the white space before it, or white space at the end).
``regexp_count`` gives their number n, keyed draws give two cuts a <= b in 0..n, and one match of a pattern
made for the row, ``unit{a}`` then ``unit{b - a}`` then the rest, captures prefix, middle and suffix. Every
quantifier over a group is possessive: the regular-expression engine then counts in a loop, where a greedy
group would recurse once per unit and overflow its stack on a long text, and no unit is ever given back.

The work is one projection over each row by itself: no shuffle, nothing kept between rows, and a lost
executor's rows are simply computed again with the same draws.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The unit of the cuts and the marks of the three parts.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: the same units, written so that neither the class runs nor the alternatives keep positions to return to
_UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws: the first 8-digit groups of the hex sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _check(marks: tuple[str, str, str]):
    """Marks must be told apart wherever texts meet them: none may begin inside another or itself."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j))) or (i != j and a in b):
                raise ValueError(f"marks {a!r} and {b!r} are empty or overlap")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row; ``marks`` are prefix, suffix, middle.

    ``n`` counts units. ``form`` is plain (the text itself), psm (prefix, suffix, middle) or spm (suffix,
    prefix, middle); the character counts are code points and null where plain. A null text counts as empty,
    and an empty text, or one that holds a mark, is plain. A null key draws like an empty one. Repeated rows
    give equal rows. White space other than the six ASCII kinds belongs to words. Other columns are ignored;
    an empty table gives an empty table. Rows are independent, so one very long text costs one task its own
    length only.
    """
    _check(marks)
    p, s, m = (F.lit(x) for x in marks)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("key"), seed)
    marked = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = (F.when((F.col("text") == "") | marked | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    counted = rows.select("key", "text", F.regexp_count("text", F.lit(_UNIT)).cast("long").alias("n"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    a, b = F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))
    pattern = F.when(F.col("form") != "plain", F.concat(
        F.lit(rf"(?s)\A({_UNIT}{{"), a.cast("string"), F.lit(rf"}}+)({_UNIT}{{"), (b - a).cast("string"), F.lit(r"}+)(.*)\z")))
    # the match is written out with a mark, which the text does not hold, between its parts
    cut = counted.select("key", "text", "n", "form", pattern.alias("pattern")).withColumn(
        "parts", F.split(F.regexp_replace("text", F.col("pattern"), F.lit(f"$1{_quoted(marks[0])}$2{_quoted(marks[0])}$3")), re.escape(marks[0])))
    first, middle, last = (F.col("parts")[i] for i in range(3))
    output = (F.when(F.col("form") == "psm", F.concat(p, first, s, last, m, middle))
              .when(F.col("form") == "spm", F.concat(s, last, p, first, m, middle)).otherwise(F.col("text")))
    return cut.select(F.col("key").alias(key), "n", "form", F.length(first).cast("long").alias("prefix_chars"),
                      F.length(middle).cast("long").alias("middle_chars"), output.alias("output"))


def _quoted(mark: str) -> str:
    """The mark as a literal replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def restore(rows: DataFrame, output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``rows`` with ``restored``: the exact text, rebuilt from an output and its form alone.

    Each mark occurs once in a psm or spm output, so one match finds the three parts. A null output or form
    gives null; an output that does not have its form's marks comes back as it is.
    """
    p, s, m = (re.escape(x) for x in marks)
    whole = F.col(output)
    psm = F.regexp_replace(whole, rf"(?s)\A{p}(.*){s}(.*){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(whole, rf"(?s)\A{s}(.*){p}(.*){m}(.*)\z", "$2$3$1")
    return rows.withColumn("restored", F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).when(F.col(form) == "plain", whole))
