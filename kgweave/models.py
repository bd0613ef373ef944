"""Protocol for language models and encoders, with deterministic stand-ins that need no network.

A model is anything with ``complete(prompts) -> answers`` for a batch; an encoder anything with
``encode(texts) -> matrix``. Both run inside Arrow batches, one client per Python worker. The
stand-ins below are Column expressions, so plans that use them stay in the JVM.
"""
from __future__ import annotations

import random
import time
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .functions.arrays import l2_normalize, let
from .functions.text import _col, squeeze, tokens
from .session import cut_lineage

# Attempts and waits of the two retry policies, and the failure answer.
RETRY_ATTEMPTS, RETRY_WAIT_SECONDS = 6, 2
RETRY_SECONDS = 120
FAILED_ANSWER = "[]"
# Capitalised question words that never name an entity.
QUESTION_WORDS = ("What", "How", "When", "Where", "Why", "Who", "Which", "The", "A", "An", "Is", "Are",
                  "Was", "Were", "Do", "Does", "Did", "Can", "Could", "Should", "Would")
MAX_ENTITIES = 3
ENCODER_DIM = 16


class Generator(Protocol):
    def complete(self, prompts: Sequence[str]) -> Sequence[str]: ...


class Encoder(Protocol):
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


def _with_retry(call, attempts: int, wait: float):
    """Result of the first call that succeeds, None after ``attempts`` or `RETRY_SECONDS` of trying.

    The pause doubles from ``wait`` on and is cut by a random share, so that workers do not retry in step.
    """
    began = time.monotonic()
    for i in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001 - a provider may raise anything
            pause = wait * 2 ** i * random.uniform(0.5, 1.0)
            if i + 1 == attempts or time.monotonic() - began + pause > RETRY_SECONDS:
                return None
            time.sleep(pause)
    return None


def generate(df: DataFrame, prompt: str, out: str, make_generator, attempts: int = RETRY_ATTEMPTS,
             wait: float = RETRY_WAIT_SECONDS) -> DataFrame:
    """Append a model's answer for every prompt; a batch that keeps failing answers ``[]``."""
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_generator()
        for s in parts:
            got = _with_retry(lambda: list(model.complete(s.tolist())), attempts, wait)
            yield pd.Series(got if got is not None else [FAILED_ANSWER] * len(s))
    return df.withColumn(out, run(F.col(prompt)))


USAGE = "response string, prompt_tokens long, completion_tokens long, total_tokens long, time double"


def generate_with_usage(df: DataFrame, prompt: str, out: str, make_generator, attempts: int = RETRY_ATTEMPTS,
                        wait: float = RETRY_WAIT_SECONDS) -> DataFrame:
    """Append a struct ``out`` (`USAGE`): the answer, its token counts and the seconds of the call.

    A generator with ``complete_with_usage(prompts)`` answers (text, prompt tokens, completion tokens) per prompt;
    one without has its counts null. A call's seconds, retries and pauses included, are shared out evenly over
    the prompts of its batch, so that they add up over any rows. A call that keeps failing answers ``[]`` with no tokens.
    """
    @F.pandas_udf(USAGE)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_generator()
        for s in parts:
            began = time.perf_counter()
            if hasattr(model, "complete_with_usage"):
                got = _with_retry(lambda: list(model.complete_with_usage(s.tolist())), attempts, wait)
            else:
                got = _with_retry(lambda: [(a, None, None) for a in model.complete(s.tolist())], attempts, wait)
            rows = got if got is not None else [(FAILED_ANSWER, 0, 0)] * len(s)
            said = pd.DataFrame(rows, columns=["response", "prompt_tokens", "completion_tokens"]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            said["total_tokens"] = said["prompt_tokens"] + said["completion_tokens"]
            said["time"] = (time.perf_counter() - began) / max(1, len(s))
            yield said
    return df.withColumn(out, run(F.col(prompt)))


def usage_totals(df: DataFrame, usage: str, *keys: str) -> DataFrame:
    """(keys, calls, prompt_tokens, completion_tokens, total_tokens, time) of answered rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(f"{usage}.{c}").alias(c) for c in (
        "prompt_tokens", "completion_tokens", "total_tokens", "time")])


def generate_cached(df: DataFrame, prompt: str, out: str, make_generator, cache: DataFrame | None,
                    params: str = "") -> tuple[DataFrame, DataFrame]:
    """Answers through a response cache keyed by a hash of prompt and parameters.

    Only distinct prompts missing from the cache reach the model; equal prompts share one answer.
    Returns the answered rows and the rows to append to the cache.
    """
    key = F.sha2(F.concat(F.lit(params + "\x1f"), F.col(prompt)), 256)
    keyed = df.withColumn("_key", key)
    todo = keyed.select("_key", prompt).dropDuplicates(["_key"])
    if cache is not None:
        todo = todo.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    # stored before use: both results below read the same answers, and the model runs once per prompt
    fresh = cut_lineage(generate(todo, prompt, "response", make_generator).select(F.col("_key").alias("key"), "response"))
    known = fresh if cache is None else fresh.unionByName(cache.select("key", "response"))
    answered = keyed.join(known.select(F.col("key").alias("_key"), F.col("response").alias(out)), "_key", "left")
    return answered.drop("_key"), fresh


def encode(df: DataFrame, text: str, out: str, make_encoder, instruction: str = "") -> DataFrame:
    """Append an embedding; ``instruction`` is the task prompt put before queries."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_encoder()
        for s in parts:
            yield pd.Series(list(np.asarray(model.encode(s.tolist()), dtype=np.float32)))
    src = F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), F.col(text)) if instruction else F.col(text)
    return df.withColumn(out, run(src))


def encode_distinct(df: DataFrame, text: str, out: str, make_encoder) -> DataFrame:
    """Encode each distinct text once and join the vectors back."""
    vectors = encode(df.select(text).distinct(), text, out, make_encoder)
    return df.join(vectors, text)


def hash_embedding(text, dim: int = ENCODER_DIM) -> Column:
    """Deterministic stand-in encoder: normalised token counts in ``dim`` hashed buckets."""
    words = tokens(F.lower(_col(text)))
    bucket = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % dim)
    counts = let(bucket, lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("float")))
    return l2_normalize(counts)


def capital_entities(text) -> Column:
    """Stand-in entity recogniser: runs of capitalised words minus question words, first three."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"\b[A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+"), 0)
    return F.slice(F.filter(runs, lambda r: ~r.isin(*QUESTION_WORDS)), 1, MAX_ENTITIES)


def sentences(text) -> Column:
    """Sentences of at least three words, cut at full stops."""
    parts = F.transform(F.split(squeeze(_col(text)), r"\."), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.substring_index(s, " ", 2) != s)


def rule_extraction(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stand-in triple extractor producing the three JSON arrays of an extraction record.

    Per sentence: (first word, second word, last word) as an entity triple and the sentence with
    its outer words as participants; per pair of neighbouring sentences a ``before`` event triple.
    """
    def arrays(s):
        word = lambda x, i: F.substring_index(x, " ", i)  # noqa: E731 - first or last; words are parted by one space
        entity = F.transform(s, lambda x: F.struct(
            word(x, 1).alias("Head"), word(word(x, 2), -1).alias("Relation"), word(x, -1).alias("Tail")))
        rest = F.greatest(F.size(s) - 1, F.lit(0))
        event = F.zip_with(F.slice(s, 1, rest), F.slice(s, 2, rest), lambda a, b: F.struct(
            a.alias("Head"), F.lit("before").alias("Relation"), b.alias("Tail")))
        part = F.transform(s, lambda x: F.struct(
            x.alias("Event"), F.array(word(x, 1), word(x, -1)).alias("Entity")))
        return F.struct(F.to_json(entity).alias("entity_relation_dict"),
                        F.to_json(part).alias("event_entity_relation_dict"),
                        F.to_json(event).alias("event_relation_dict"))
    # one generator row per document: its output is computed once and never inlined further up
    return docs.select(
        F.lit("documents").alias("file_name"), F.col(doc_id).alias("line_no"),
        F.col(doc_id).cast("string").alias("id"), F.col(text).alias("original_text"),
        F.explode(F.transform(F.array(sentences(text)), arrays)).alias("_r"),
    ).select("file_name", "line_no", "id", "original_text", "_r.*")


def rule_concepts(worklist: DataFrame) -> DataFrame:
    """Stand-in conceptualiser: initial letter and size class, as a comma separated answer."""
    n = F.col("Name")
    size = F.size(F.split(n, " "))
    answer = F.concat(F.lit("initial "), F.lower(F.substring(n, 1, 1)), F.lit(", "),
                      F.when(F.col("Type") == "Event", F.concat(F.lit("event of "), (size - size % 5).cast("string"), F.lit(" words")))
                      .otherwise(F.concat(F.lit("length "), F.length(n).cast("string"))))
    return worklist.select(n.alias("node"), answer.alias("conceptualized_node"), F.lower("Type").alias("node_type"))
