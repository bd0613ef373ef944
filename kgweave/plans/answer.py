"""Answering: retrieve, prompt, read; the search-and-reason loop; benchmark scoring."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import models
from ..functions import text as T
from ..operators import quality as Q
from ..session import cut_lineage
from . import prompts

# Rounds of the search loop, first and later retrieval depth, and its two phrases.
MAX_ROUNDS, FIRST_K, LATER_K = 5, 5, 3
NEED_MORE, USING_CONTEXT = "need more information", "Using current context"
NO_CONTEXT = "No retrieved context, Please answer the question with your own knowledge."


def joined_context(hits: DataFrame, text: str = "text", order: str = "rank", separator: str = "\n", reverse: bool = False) -> DataFrame:
    """One context text per question from its (few) retrieved rows."""
    key = -F.col(order) if reverse else F.col(order)
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("o"), F.col(text).alias("t")))).alias("c"))
    return g.select("query_id", F.array_join(F.transform("c", lambda x: x["t"]), separator).alias("context"))


def answer(questions: DataFrame, context: DataFrame | None, make_generator, kind: str = "context", out: str = "answer") -> DataFrame:
    """Read an answer for every question; one without context is asked plainly."""
    if context is None:
        prompted = questions.withColumn("_p", prompts.reader_prompt("text", kind="plain"))
    else:
        prompted = questions.join(context, "query_id", "left").withColumn("_p", F.when(
            F.col("context").isNotNull(), prompts.reader_prompt("text", "context", kind)).otherwise(prompts.reader_prompt("text", kind="plain"))).drop("context")
    done = models.generate(prompted, "_p", out, make_generator)
    return done.withColumn(out, T.strip_think(out)).drop("_p")


def chat_questions(messages: DataFrame, exempt: list[str], choices: list[str], prompt: str = "prompt") -> DataFrame:
    """Retrieval text of chat prompts: all of a choice question, none of an exempt one, else the last question.

    A prompt without a question mark phrase is retrieved with its whole text.
    """
    has = lambda words: F.lit(False) if not words else F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(prompt), w))
    return messages.withColumn("is_exempt", has(exempt)).withColumn("is_choice", has(choices)).withColumn(
        "text", F.when(F.col("is_exempt"), F.lit(None)).when(F.col("is_choice"), F.col(prompt)).otherwise(F.coalesce(T.last_question(prompt), F.col(prompt))))


def chat_answers(messages: DataFrame, hits: DataFrame, make_generator, prompt: str = "prompt") -> DataFrame:
    """Batch form of the chat service: numbered passages, best one last, then the reader's answer."""
    numbered = hits.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rank"))))
    lines = numbered.withColumn("text", F.concat(F.lit("Passage "), F.col("_n").cast("string"), F.lit(": "), F.col("text")))
    ctx = joined_context(lines, order="_n")
    asked = messages.join(ctx, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))
    content = F.when(F.col("is_exempt"), F.col(prompt)).when(F.col("is_choice"), F.concat(
        F.lit("Here is the context: "), "context", F.lit("\n\nIf it does not help, use your own knowledge.\n"), F.col(prompt),
        F.lit("\nThink step by step and end with 'The answer is (X)', X being one of A, B, C and D."))).otherwise(
        F.concat(F.col(prompt), F.lit(" Reference doc: "), "context"))
    return models.generate(asked.withColumn("_p", content), "_p", "answer", make_generator).drop("_p").withColumn("answer", T.squeeze_ends("answer"))


def reason_and_search(questions: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], make_generator,
                      max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Search loop over all open questions at once: (query_id, answer, rounds).

    ``retrieve(queries, k)`` maps (query_id, text) to (query_id, rank, text). Each round asks the
    model; questions that answer leave, the others search again and add only new passages.
    """
    first = retrieve(questions, FIRST_K).select("query_id", "text", F.col("rank").alias("place"))
    context, live, done = cut_lineage(first), questions.select("query_id", "text"), None
    for i in range(1, max_rounds + 1):
        ctx = joined_context(context, order="place")
        asked = live.join(ctx, "query_id", "left").withColumn("_p", F.concat(
            F.lit(prompts.REACT), F.lit("Context: "), F.coalesce("context", F.lit("")), F.lit("\nQuestion: "), "text")).drop("context")
        said = cut_lineage(models.generate(asked, "_p", "_r", make_generator).select(
            "query_id", "text", T.react_answer("_r").alias("answer"), T.react_action("_r").alias("action"), F.col("_r").alias("raw")))
        more = (F.lower(F.coalesce("answer", F.lit(""))) == NEED_MORE) & F.contains(F.lower(F.coalesce("action", F.lit(""))), F.lit("search"))
        more = more if i < max_rounds else F.lit(False)
        final = said.filter(~more).select("query_id", F.coalesce("answer", "raw").alias("answer"), F.lit(i).alias("rounds"))
        done = final if done is None else done.unionByName(final)
        open_ = said.filter(more)
        if i == max_rounds or open_.isEmpty():
            break
        live = cut_lineage(open_.select("query_id", "text"))
        found = retrieve(open_.select("query_id", T.react_search_query("action").alias("text")), LATER_K)
        new = found.select("query_id", "text", (F.col("rank") + F.lit(1000 * i)).alias("place")).join(
            context.select("query_id", "text"), ["query_id", "text"], "left_anti")
        context = cut_lineage(context.join(live.select("query_id"), "query_id", "left_semi").unionByName(new))
    return done


def benchmark(samples: DataFrame, retrievers: dict[str, Callable[[DataFrame], DataFrame]], make_generator, kind: str = "context") -> tuple[DataFrame, DataFrame]:
    """Score retrievers on questions: per-sample long rows and the averages per retriever.

    ``samples``: query_id, text, answer, gold (list). A retriever maps the samples to
    (query_id, rank, text).
    """
    rows = None
    for name, fn in retrievers.items():
        hits = cut_lineage(fn(samples.select("query_id", "text")))
        said = answer(samples.select("query_id", "text"), joined_context(hits), make_generator, kind, "prediction")
        judged = Q.judge(said.join(samples.select("query_id", "answer"), "query_id"), "prediction", "answer")
        rec = Q.recall_long(samples.select("query_id", F.explode("gold").alias("gold")), hits.select("query_id", "rank", "text"), "query_id")
        j = judged.join(rec, "query_id", "left")
        cols = {"em": F.col("em").cast("double"), "f1": F.col("f1"), **{f"recall_at_{k}": F.coalesce(f"recall_at_{k}", F.lit(0.0)) for k in Q.RECALL_AT}}
        long = j.select("query_id", F.lit(name).alias("retriever"), F.explode(F.array(*[
            F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in cols.items()])).alias("m")).select(
            F.col("query_id").alias("sample_id"), "retriever", "m.*")
        rows = long if rows is None else rows.unionByName(long)
    rows = cut_lineage(rows)
    return rows, Q.retriever_summary(rows)
