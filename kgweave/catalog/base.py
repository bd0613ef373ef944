"""Registration, table access and the SQL fragments shared by the checks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import PY_WS
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def bind(fn):
        if name in QUERIES:
            raise ValueError(f"{name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return bind


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, spread over the cores when the file is small enough for a single task."""
    return spread(table(spark, folder, "documents"), "doc_id")


def sq(x: str) -> str:
    """SQL: collapse Unicode white space and trim."""
    return f"trim(regexp_replace({x}, '{PY_WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    """SQL: name cleaning of the table path."""
    t = f"translate({x}, chr(7) || chr(8) || ';', '  ,')"
    return sq(f"replace(replace({t}, '\\e', ' '), chr(0), '')")


def words(x: str) -> str:
    """SQL: white-space tokens of a text."""
    return f"list_filter(string_split({sq(x)}, ' '), lambda w: w <> '')"


# The stand-in extraction over all documents, as SQL: sentences, then the three triple kinds.
SENTENCES = f"""
sents AS (SELECT doc_id, list_filter(list_transform(string_split({sq('text')}, '.'), lambda s: {sq('s')}),
                                     lambda s: len(string_split(s, ' ')) >= 3) AS ss FROM documents),
sent AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM sents),
"""
TRIPLES = SENTENCES + f"""
raw_triples AS (
  SELECT doc_id, 0 AS kind, i AS item, 0 AS member, w[1] AS head, w[2] AS relation, w[-1] AS tail
  FROM (SELECT doc_id, i, string_split(s, ' ') AS w FROM sent)
  UNION ALL
  SELECT a.doc_id, 1, a.i, 0, a.s, 'before', b.s FROM sent a JOIN sent b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  UNION ALL
  SELECT doc_id, 2, i, m, s, 'is participated by', CASE WHEN m = 0 THEN w[1] ELSE w[-1] END
  FROM (SELECT doc_id, i, s, string_split(s, ' ') AS w, unnest([0, 1]) AS m FROM sent)
),
texts AS (SELECT doc_id, p, sha256(p) AS text_id FROM (
  SELECT doc_id, string_split(string_split(text, 'Here is the passage.')[-1], '<|eot_id|>')[1] AS p FROM documents)),
triples AS (
  SELECT t.*, x.text_id FROM (
    SELECT doc_id, kind, item, member, {clean('head')} AS head, {clean('relation')} AS relation, {clean('tail')} AS tail
    FROM raw_triples) t JOIN texts x USING (doc_id)
  WHERE head <> '' AND relation <> '' AND tail <> ''
),
mentions AS (
  SELECT head AS name, CASE WHEN kind = 0 THEN 'entity' ELSE 'event' END AS type, text_id, doc_id, kind, item, member, 0 AS e FROM triples
  UNION ALL
  SELECT tail, CASE WHEN kind = 1 THEN 'event' ELSE 'entity' END, text_id, doc_id, kind, item, member, 1 FROM triples
),
nodes AS (SELECT name, type, text_id FROM mentions
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, kind, item, member, e) = 1)
"""
WITH_KG = "WITH " + TRIPLES
