"""Documents, chunks, shards, cleaning and answer parsing."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..functions import arrays as A, text as T
from ..operators import extraction as X, shaping as S
from ..session import dense_index
from .base import PY_WS, clean, documents, query, sq, table, words

CORPUS_LANGUAGES = ("en", "de", "fr")  # parameter of the filter: languages present in the corpus
WIDTH = S.chunk_width()


@query("q_lang_filter", """
SELECT doc_id, lang FROM documents WHERE coalesce(lang, 'en') IN ('en', 'de', 'fr')""")
def lang_filter(spark, d):
    return S.filter_language(table(spark, d, "documents"), supported=CORPUS_LANGUAGES).select("doc_id", "lang")


@query("q_chunks", f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, substring(t, i * {WIDTH} + 1, {WIDTH}) AS text
FROM (SELECT doc_id, {sq('text')} AS t, unnest(range(0, CAST(ceil(length({sq('text')}) / {WIDTH}.0) AS BIGINT))) AS i FROM documents)""")
def chunks(spark, d):
    return S.chunk_documents(documents(spark, d).select("doc_id", "text"), remove_spaces=True)


@query("q_chunk_stats", f"""
SELECT lang, sum(n) AS n_chunks, count(*) AS n_docs, max(n) AS max_chunks FROM (
  SELECT lang, CAST(ceil(length(text) / {WIDTH}.0) AS BIGINT) AS n FROM documents WHERE length(text) > 0) GROUP BY lang""")
def chunk_stats(spark, d):
    c = S.chunk_documents(table(spark, d, "documents").select("doc_id", "lang", "text"))
    per = c.groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_docs"), F.max("n").alias("max_chunks"))


@query("q_sentence_chunks")
def sentence_chunk_stats(spark, d):
    c = S.sentence_chunks(documents(spark, d).select("doc_id", "text"))
    return c.withColumn("chunk_key", S.chunk_key("doc_id", "chunk_id"))


@query("q_shard_sizes", """
SELECT CAST(shard AS INTEGER) AS shard, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
  SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents) GROUP BY shard""")
def shard_sizes(spark, d):
    s = S.balanced_shards(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)
    return s.groupBy("shard").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("q_hashed_shards")
def hashed_shards(spark, d):
    s = S.hashed_shards(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)
    return s.groupBy("shard").agg(F.count("*").alias("n_docs"))


@query("q_batches", """
SELECT batch, count(*) AS n_docs, min(doc_id) AS first_doc FROM (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) WHERE batch >= 3 GROUP BY batch""")
def batches(spark, d):
    b = S.batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 16, resume_from=3)
    return b.groupBy("batch").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("q_debug_sample", f"""
SELECT doc_id FROM (
  SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT doc_id, ceil(length(text) / {WIDTH}.0) AS n FROM documents WHERE length(text) > 0)) WHERE before < 20""")
def debug_sample(spark, d):
    return S.debug_sample(table(spark, d, "documents"), ["doc_id"]).select("doc_id")


@query("q_rank_stride", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos % 4 = 1""")
def rank_stride(spark, d):
    pos = dense_index(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return S.strided(pos, "pos", 1, 4).select("doc_id")


@query("q_clean_text", f"""SELECT page_id, {clean('html')} AS cleaned FROM pages""")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_text("html").alias("cleaned"))


@query("q_text_hash_nodes", f"""
SELECT sha256(t) AS text_id, min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, {sq('text')} AS t FROM documents) GROUP BY t""")
def text_hash_nodes(spark, d):
    t = documents(spark, d).select("doc_id", T.sha_id(T.squeeze("text")).alias("text_id"))
    return t.groupBy("text_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("q_first_seen_dedup", f"""
SELECT lang, count(*) AS n_texts, sum(length(t)) AS n_chars FROM (
  SELECT doc_id, lang, {sq('text')} AS t FROM documents
  QUALIFY row_number() OVER (PARTITION BY {sq('text')} ORDER BY doc_id) = 1) GROUP BY lang""")
def first_seen_dedup(spark, d):
    t = documents(spark, d).select("doc_id", "lang", T.squeeze("text").alias("t"))
    # shuffle the hash and two small values, not the text
    first = t.select(T.sha_id("t").alias("h"), "doc_id", "lang", F.length("t").alias("n")).groupBy("h").agg(
        F.min_by(F.struct("lang", "n"), "doc_id").alias("f"))
    return first.groupBy("f.lang").agg(F.count("*").alias("n_texts"), F.sum("f.n").alias("n_chars"))


@query("q_node_ids", """
SELECT DISTINCT 'n' || substring(md5(p_name), 1, 16) AS md5_id, sha256(p_name) AS name_id,
       sha256(p_name || '_concept') AS concept_id, substring(sha256(lower(p_name)), 1, 16) AS short_id FROM part""")
def node_ids(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select(
        T.md5_id("p_name").alias("md5_id"), T.sha_id("p_name").alias("name_id"),
        T.concept_id("p_name").alias("concept_id"), T.concept_node_id("p_name").alias("short_id"))


@query("q_passage_trim", """
SELECT conv_id, turn, string_split(string_split('intro Here is the passage.' || text || '<|eot_id|>tail', 'Here is the passage.')[-1], '<|eot_id|>')[1] AS passage
FROM conversations""")
def passage_trim(spark, d):
    wrapped = F.concat(F.lit("intro " + T.PASSAGE_MARK), "text", F.lit(T.TURN_END + "tail"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.trim_passage(wrapped).alias("passage"))


@query("q_answer_split", """
SELECT conv_id, turn, CASE WHEN a = '' THEN 'none' ELSE a END AS answer FROM (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN string_split('Thought: x Answer:' || text, 'Answer:')[-1]
                             ELSE string_split('so the answer:' || text, 'answer:')[-1] END AS a FROM conversations)""")
def answer_split(spark, d):
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("Thought: x Answer:"), "text")).otherwise(
        F.concat(F.lit("so the answer:"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.split_answer(said).alias("answer"))


@query("q_react_parse", """
SELECT conv_id, turn, ' ' || string_split(t, chr(10))[1] AS thought, ' search for ' || conv_id AS action, CAST(conv_id AS VARCHAR) AS query
FROM (SELECT conv_id, turn, text AS t FROM conversations)""")
def react_parse(spark, d):
    said = F.concat(F.lit("Thought: "), "text", F.lit("\nAction: search for "), F.col("conv_id").cast("string"), F.lit("\nAnswer: more"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.react_thought(said).alias("thought"),
                                                   T.react_action(said).alias("action"),
                                                   T.react_search_query(T.react_action(said)).alias("query"))


@query("q_last_question", f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN regexp_replace(regexp_replace(text, '^{PY_WS}+', ''), '{PY_WS}+$', '') END AS question FROM conversations""")
def last_question(spark, d):
    prompt = F.when(F.col("role") == "user", F.concat(F.lit("Context Question: a Question: "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.last_question(prompt).alias("question"))


@query("q_props_type_gate", """
SELECT event_type, count(*) AS n_numeric FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') GROUP BY event_type""")
def props_type_gate(spark, d):
    e = X.type_gate(table(spark, d, "events").select("event_type", "props"), "props", "$.k", "BIGINT")
    return e.groupBy("event_type").agg(F.count("*").alias("n_numeric"))


@query("q_exact_match_form", """
SELECT item_id, regexp_replace(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[0-9]', '', 'g') AS form FROM benchmark""")
def exact_match_form(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.exact_match_form(
        "text", ignore_case=True, ignore_punctuation=True, ignore_numbers=True).alias("form"))


@query("q_normalize_answer", f"""
SELECT conv_id, turn, {sq("regexp_replace(replace(lower(text), '-', ' '), '[^\\p{L}\\p{N}_\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')")} AS answer FROM conversations""")
def normalize_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_answer("text").alias("answer"))


@query("q_detokenize", """
SELECT item_id, regexp_replace(replace(replace(replace(replace(replace(t, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\\1', 'g') AS text
FROM (SELECT item_id, replace(replace(text, '.', ' .'), ',', ' ,') AS t FROM benchmark)""")
def detokenize(spark, d):
    t = F.replace(F.replace("text", F.lit("."), F.lit(" .")), F.lit(","), F.lit(" ,"))
    return table(spark, d, "benchmark").select("item_id", T.detokenize(t).alias("text"))


@query("q_first_choice", """
SELECT conv_id, turn, upper(regexp_extract(text, '[a-dA-D]', 0)) AS letter, regexp_extract(text, '(?s)[a-zA-Z].*', 0) AS from_letter,
       coalesce(nullif(regexp_extract(text, '[A-Z][a-z]+', 0), ''), '[invalid]') AS picked FROM conversations""")
def first_choice(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.first_choice_letter("text").alias("letter"), T.from_first_letter("text").alias("from_letter"),
        T.regex_pick("text", "[A-Z][a-z]+").alias("picked"))


@query("q_rolling_windows", f"""
WITH tok AS (SELECT doc_id, list_transform({words('text')}, lambda w: length(w)) AS t FROM documents),
win AS (SELECT doc_id, t, len(t) AS n, unnest(range(0, CAST(greatest(ceil((len(t) - 32) / 25.0), 0) AS BIGINT) + 1)) AS k FROM tok WHERE len(t) > 0),
pos AS (SELECT doc_id, t, k, CASE WHEN k = 0 THEN 0 ELSE 32 + (k - 1) * 25 END AS done, least(n, 32 + k * 25) AS e FROM win)
SELECT doc_id, CAST(k AS INTEGER) AS k,
       CAST(list_sum(t[done + 1 : e]) AS BIGINT) AS predicted_sum, CAST(e - done AS INTEGER) AS n_predicted,
       CAST(list_sum(list_concat([-1], t)[greatest(e - 32, 0) + 1 : e]) AS BIGINT) AS context_sum,
       CAST(e - greatest(e - 32, 0) AS INTEGER) AS n_context
FROM pos""")
def rolling_windows(spark, d):
    # word lengths stand in for token ids
    tok = documents(spark, d).select("doc_id", F.transform(T.tokens("text"), lambda w: F.length(w).cast("bigint")).alias("t"))
    w = tok.select("doc_id", F.posexplode(A.rolling_windows("t", F.lit(-1).cast("bigint"), 32, 8)).alias("k", "w"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("doc_id", "k", total("w.predicted").alias("predicted_sum"), F.size("w.predicted").alias("n_predicted"),
                    total("w.context").alias("context_sum"), F.size("w.context").alias("n_context"))


@query("q_stand_in_entities")
def stand_in_entities(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(models.capital_entities("text"), ", ").alias("entities"))
