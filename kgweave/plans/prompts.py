"""Prompt texts and builders. The wording is this project's own; any of it may be replaced."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PASSAGE_START = {"en": "Here is the passage.", "zh-CN": "以下是文章。", "zh-HK": "以下是文章。"}
_ANSWER = {"en": "Answer with a JSON array only.", "zh-CN": "只输出 JSON 数组。", "zh-HK": "只輸出 JSON 陣列。"}
SYSTEM = {"en": "You turn passages into structured knowledge.", "zh-CN": "你负责把文章整理成结构化知识。", "zh-HK": "你負責把文章整理成結構化知識。"}
STAGES = {
    "entity_relation": {
        "en": 'List the relations between named things as {"Head", "Relation", "Tail"}.',
        "zh-CN": '列出实体之间的关系，格式为 {"Head", "Relation", "Tail"}。',
        "zh-HK": '列出實體之間的關係，格式為 {"Head", "Relation", "Tail"}。'},
    "event_entity": {
        "en": 'List every event with its participants as {"Event", "Entity": [...]}.',
        "zh-CN": '列出每个事件及其参与者，格式为 {"Event", "Entity": [...]}。',
        "zh-HK": '列出每個事件及其參與者，格式為 {"Event", "Entity": [...]}。'},
    "event_relation": {
        "en": 'List temporal and causal relations between events as {"Head", "Relation", "Tail"}.',
        "zh-CN": '列出事件之间的时间与因果关系，格式为 {"Head", "Relation", "Tail"}。',
        "zh-HK": '列出事件之間的時間與因果關係，格式為 {"Head", "Relation", "Tail"}。'},
}
CONCEPT = {
    "event": "Give abstract phrases of one or two words for the EVENT, comma separated. EVENT: [EVENT]. Answer:",
    "entity": "Give abstract phrases of one or two words for the ENTITY, comma separated. ENTITY: [ENTITY]. CONTEXT: [CONTEXT]. Answer:",
    "relation": "Give abstract phrases of one or two words for the RELATION, comma separated. RELATION: [RELATION]. Answer:",
}
READER = {
    "plain": "Answer the question. End with 'Answer: ' and a short answer.\nQuestion: ",
    "context": "Answer the question from the context. End with 'Answer: ' and a short answer.\n",
    "graph": "Answer the question from the knowledge graph triples. End with 'Answer: ' and a short answer.\n",
}
REACT = ("Decide whether the context answers the question. Reply with three lines: 'Thought:', 'Action:' "
         "(search for ... or no action) and 'Answer:' (the answer, or 'Need more information').\n")
RATE_PATH = "Rate from 0 to 5 how relevant the path is to the question. Reply with one number.\n"
ENOUGH = "Do the triples suffice to answer the question? Reply Yes or No.\n"
CONCEPTS_DIRECT = 'Extract concepts and relationships as {"concepts": [...], "relationships": [...]}.\n'


def _by_language(table: dict[str, str], lang) -> Column:
    out = F.lit(table["en"])
    for k, v in table.items():
        if k != "en":
            out = F.when(lang == k, v).otherwise(out)
    return out


def extraction_prompts(chunks: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Append a system prompt and one prompt per stage; an unknown language uses English."""
    l = F.coalesce(F.col(lang), F.lit("en"))
    out = chunks.withColumn("system", _by_language(SYSTEM, l))
    for stage, table in STAGES.items():
        out = out.withColumn(f"prompt_{stage}", F.concat(
            _by_language(table, l), F.lit(" "), _by_language(_ANSWER, l), _by_language(PASSAGE_START, l), F.lit("\n"), F.col(text)))
    return out


def concept_prompts(worklist: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Prompt per worklist row; entities may carry a neighbourhood context (name, context)."""
    w = worklist if context is None else worklist.join(context.withColumnRenamed("name", "Name"), "Name", "left")
    ctx = F.coalesce("context", F.lit("")) if context is not None else F.lit("")
    kind = F.lower("Type")
    fill = lambda k, slot: F.replace(F.replace(F.lit(CONCEPT[k]), F.lit(slot), F.col("Name")), F.lit("[CONTEXT]"), ctx)
    return w.withColumn("prompt", F.when(kind == "event", fill("event", "[EVENT]")).when(kind == "entity", fill("entity", "[ENTITY]"))
                        .otherwise(fill("relation", "[RELATION]")))


def reader_prompt(question, context=None, kind: str = "context") -> Column:
    q = F.col(question) if isinstance(question, str) else question
    if kind == "plain" or context is None:
        return F.concat(F.lit(READER["plain"]), q)
    c = F.col(context) if isinstance(context, str) else context
    return F.concat(F.lit(READER[kind]), F.lit("Context: "), c, F.lit("\nQuestion: "), q)


def rating_prompt(question, path) -> Column:
    return F.concat(F.lit(RATE_PATH), F.lit("Question: "), F.col(question), F.lit("\nPath: "), F.col(path))


def enough_prompt(question, triples) -> Column:
    return F.concat(F.lit(ENOUGH), F.lit("Question: "), F.col(question), F.lit("\nTriples: "), F.col(triples))
