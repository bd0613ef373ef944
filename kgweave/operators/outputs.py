"""Model outputs: repair, key correction, validation and flattening of generated JSON."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Keys every object of an extraction stage must have, and the longest keyword kept.
STAGE_KEYS = {
    "entity_relation": ("Head", "Relation", "Tail"),
    "event_entity": ("Event", "Entity"),
    "event_relation": ("Head", "Relation", "Tail"),
}
MAX_KEYWORD = 200


def loads_lenient(text: str):
    """Parse JSON that a model may have damaged: fences, trailing commas, quotes, missing ends."""
    t = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", text.strip())
    starts = [i for i in (t.find("["), t.find("{")) if i >= 0]
    if not starts:
        return None
    t = t[min(starts):]
    for candidate in _attempts(t):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def _attempts(t: str):
    yield t
    end = max(t.rfind("]"), t.rfind("}"))
    body = t[:end + 1] if end >= 0 else t
    yield body
    plain = re.sub(r",\s*([\]}])", r"\1", body)
    yield plain
    yield re.sub(r"(?<![\w])'|'(?![\w])", '"', plain)
    # cut back to the last complete object and close what is open
    for cut in [m.end() for m in re.finditer(r"[}\]]", plain)][::-1]:
        part, stack, quoted, skip = plain[:cut], [], False, False
        for ch in part:
            if skip:
                skip = False
            elif ch == "\\" and quoted:
                skip = True
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "[{":
                stack.append("]" if ch == "[" else "}")
            elif not quoted and ch in "]}" and stack:
                stack.pop()
        yield part + "".join(reversed(stack))


def parsed(text) -> Column:
    """A response as VARIANT: read as it is, or after mending damaged JSON; NULL when nothing is usable."""
    @F.pandas_udf("string")
    def mended(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(loads_lenient(t or ""), ensure_ascii=False))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(mended(text)))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _named(item: Column, wanted: str, others: tuple[str, ...]) -> Column:
    """The value whose key, by its letters, names ``wanted`` and none of the other keys; the last such."""
    entries = F.map_entries(F.try_variant_get(item, "$", "map<string,variant>"))

    def names(e: Column) -> Column:
        key, hit = _letters(e["key"]), F.lit(True)
        for w in (wanted, *others):
            hit = hit & (F.contains(key, F.lit(w.lower())) if w == wanted else ~F.contains(key, F.lit(w.lower())))
        return hit
    return F.try_element_at(F.filter(entries, names), F.lit(-1))["value"]


def stage_items(v: Column, stage: str) -> Column:
    """Distinct objects of a stage with its keys alone; those that lack one or hold another type are left out."""
    keys = STAGE_KEYS[stage]
    value = {k: (lambda x, k=k: _named(x, k, tuple(o for o in keys if o != k))) for k in keys}
    text = lambda x, k: F.try_variant_get(value[k](x), "$", "string")
    fine = lambda x, k: _is_text(value[k](x)) & F.coalesce(F.trim(text(x, k)) != "", F.lit(False))
    if stage == "event_entity":
        members = lambda x: F.try_variant_get(value["Entity"](x), "$", "array<variant>")
        names = lambda x: F.transform(F.filter(members(x), _is_text), lambda m: F.trim(F.try_variant_get(m, "$", "string")))
        ok = lambda x: fine(x, "Event") & F.coalesce(F.size(members(x)) > 0, F.lit(False))
        made = lambda x: F.struct(text(x, "Event").alias("Event"), names(x).alias("Entity"))
    else:
        ok = lambda x: fine(x, keys[0]) & fine(x, keys[1]) & fine(x, keys[2])
        made = lambda x: F.struct(*[text(x, k).alias(k) for k in keys])
    return F.array_distinct(F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), ok), made))


def repaired(df: DataFrame, response: str, out: str, stage: str) -> DataFrame:
    """Validated JSON array text of a stage's response; ``[]`` when nothing is usable."""
    text = F.coalesce(F.col(response), F.lit(""))
    text = F.when(F.contains(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), F.trim(text), F.lit("]")))
    return df.withColumn("_text", text).withColumn("_v", parsed("_text")).withColumn(
        out, F.coalesce(F.to_json(stage_items(F.col("_v"), stage)), F.lit("[]"))).drop("_text", "_v")


# a JSON text, and a list of exactly three of them: such a list holds no other list, so the first one in the
# item's own text is also the first in depth-first order
# (possessive throughout, so that the engine counts in a loop: a plain group would recurse once per character)
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TRIPLE = rf"\[\s*{_TEXT}\s*,\s*{_TEXT}\s*,\s*{_TEXT}\s*\]"


def first_triplets(df: DataFrame, response: str, out: str) -> DataFrame:
    """Facts of a filter answer: in each item the first list of exactly three texts, however nested."""
    items = F.try_variant_get("_v", "$.fact", "array<variant>")
    found = F.transform(items, lambda x: F.regexp_extract(F.to_json(x), _TRIPLE, 0))
    lists = F.transform(F.filter(found, lambda t: t != ""), lambda t: F.from_json(t, "array<string>"))
    return df.withColumn("_v", parsed(response)).withColumn(out, F.coalesce(lists, F.array().cast("array<array<string>>"))).drop("_v")


def keywords(df: DataFrame, response: str, out: str) -> DataFrame:
    """Flat list of the texts under ``keywords``, overlong ones left out."""
    listed = F.regexp_replace(F.to_json(F.try_variant_get("_v", "$.keywords", "variant")), r"\{[^{}]*\}", "null")
    texts = F.from_json(F.concat(F.lit("["), F.array_join(F.regexp_extract_all(listed, F.lit(_TEXT), F.lit(0)), ","), F.lit("]")), "array<string>")
    short = F.filter(texts, lambda t: F.length(t) <= MAX_KEYWORD)
    return df.withColumn("_v", parsed(response)).withColumn(out, F.coalesce(short, F.array().cast("array<string>"))).drop("_v")


def valid_stage(json_text, stage: str) -> Column:
    """Whether a JSON array satisfies a stage's shape: JVM-side check over VARIANT."""
    v = F.try_variant_get(F.try_parse_json(json_text), "$", "array<variant>")
    text = lambda x, k: F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING"
    if stage == "event_entity":
        member = lambda x: F.try_variant_get(x, "$.Entity", "array<variant>")
        ok = lambda x: F.coalesce(text(x, "Event") & (F.size(member(x)) >= 1) & F.forall(
            member(x), lambda m: F.schema_of_variant(m) == "STRING"), F.lit(False))
    else:
        ok = lambda x: F.coalesce(text(x, "Head") & text(x, "Relation") & text(x, "Tail"), F.lit(False))
    return F.coalesce(F.forall(v, ok), F.lit(False))


def gated_questions(df: DataFrame, columns: list[str], keys: dict[str, list[str]]) -> DataFrame:
    """Rows whose JSON columns are all arrays; array items lacking a key are dropped."""
    out = df
    for c in columns:
        v = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
        out = out.withColumn(f"_{c}", v).filter(F.col(f"_{c}").isNotNull())
        names = keys.get(c, [])
        out = out.withColumn(c, F.filter(F.col(f"_{c}"), lambda x: _all_present(x, names))).drop(f"_{c}")
    return out


def _all_present(x: Column, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.try_variant_get(x, f"$.{n}", "variant").isNotNull()
    return cond


def concept_records(df: DataFrame, response: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, relationships) of a direct concept answer, rows lacking required keys dropped."""
    v = df.select(key, F.try_parse_json(response).alias("v"))
    take = lambda path: v.select(key, F.posexplode(F.try_variant_get("v", path, "array<variant>")).alias("item", "x"))
    get = lambda k: F.try_variant_get("x", f"$.{k}", "string").alias(k)
    c = take("$.concepts").select(key, "item", get("name"), get("type"), get("abstraction_level"), get("description"))
    r = take("$.relationships").select(key, "item", get("source"), get("target"), get("relation"), get("description"))
    return (c.filter("name IS NOT NULL AND type IS NOT NULL"), r.filter("source IS NOT NULL AND target IS NOT NULL AND relation IS NOT NULL"))
