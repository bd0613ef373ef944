"""Writers: graph tables, concept tables, GraphML, embeddings, results and run logs."""
from __future__ import annotations

import json
from datetime import datetime, timezone
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as SC
from ..operators.extraction import Flattened

_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "encoding": "UTF-8"}


def _text(df: DataFrame) -> DataFrame:
    """CSV holds text only: arrays are written as JSON."""
    return df.select(*[(F.to_json(c) if f.dataType.typeName() == "array" else F.col(c)).alias(c) for c, f in zip(df.columns, df.schema)])


def write_csv(df: DataFrame, path: str, header: dict[str, str], quote_all: bool = False, mode: str = "overwrite") -> None:
    """One CSV table (a folder of part files) under the exchanged column names."""
    cols = [c for c in header if c in df.columns]
    named = _text(df.select(*cols)).toDF(*[header[c] for c in cols])
    named.write.mode(mode).options(**_CSV, quoteAll=quote_all).csv(path)


def write_graph_tables(flat: Flattened, folder: str, mode: str = "overwrite") -> None:
    write_csv(flat.nodes, f"{folder}/triple_nodes", SC.NODE_HEADER, mode=mode)
    write_csv(flat.edges, f"{folder}/triple_edges", SC.EDGE_HEADER, mode=mode)
    write_csv(flat.text_nodes, f"{folder}/text_nodes", SC.TEXT_NODE_HEADER, mode=mode)
    write_csv(flat.text_edges, f"{folder}/text_edges", SC.TEXT_EDGE_HEADER, mode=mode)
    write_csv(flat.missing_concepts, f"{folder}/missing_concepts", SC.WORKLIST_HEADER, mode=mode)


def write_concept_tables(nodes: DataFrame, edges: DataFrame, triple_edges: DataFrame, folder: str, mode: str = "overwrite") -> None:
    write_csv(nodes, f"{folder}/concept_nodes", SC.CONCEPT_NODE_HEADER, quote_all=True, mode=mode)
    write_csv(edges, f"{folder}/concept_edges", SC.CONCEPT_EDGE_HEADER, quote_all=True, mode=mode)
    write_csv(triple_edges, f"{folder}/triple_edges_with_concepts", SC.EDGE_HEADER, quote_all=True, mode=mode)


def write_numeric_ids(df: DataFrame, path: str, header: dict[str, str], mode: str = "overwrite") -> None:
    """Table with a ``numeric_id`` column placed before its label or type column."""
    h = {c: n for c, n in header.items()}
    last = list(h)[-1]
    ordered = {**{c: n for c, n in h.items() if c != last}, "numeric_id": "numeric_id", last: h[last]}
    write_csv(df, path, ordered, mode=mode)


def write_records(df: DataFrame, path: str, shard: str | None = None, mode: str = "append") -> None:
    """Extraction records as JSON lines, one folder per shard; non-ASCII text stays readable."""
    w = df.write.mode(mode)
    (w.partitionBy(shard) if shard else w).json(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector table; an existing one is kept (skip when already computed)."""
    df.write.mode("ignore").parquet(path)


def write_embeddings_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Embedding table with list-literal vectors and an empty ``file_id`` column."""
    df.select("*", F.lit(None).cast("string").alias("file_id")).withColumn("embedding:STRING", F.to_json("vec")).drop("vec").write.mode(mode).options(**_CSV).csv(path)


def write_buckets(df: DataFrame, path: str, mode: str = "overwrite", codec: str = "zstd") -> None:
    """N-gram buckets, one folder per bucket, compressed."""
    df.write.mode(mode).partitionBy("bucket").option("compression", codec).parquet(path)


def _xml(c: Column) -> Column:
    t = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")  # not allowed in XML 1.0
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, line) rows of a GraphML document: header 0, nodes 1, edges 2, footer 3.

    ``vertices`` needs ``id``; ``edges`` needs ``src`` and ``dst``; other columns become attributes
    (arrays as JSON text, NULLs left out).
    """
    spark = vertices.sparkSession
    va = [c for c in vertices.columns if c != "id"]
    ea = [c for c in edges.columns if c not in ("src", "dst")]
    v, e = _text(vertices), _text(edges)
    keys = [(f"n{i}", "node", c) for i, c in enumerate(va)] + [(f"e{i}", "edge", c) for i, c in enumerate(ea)]
    head = ["<?xml version='1.0' encoding='utf-8'?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    # node names are kept apart from the vertex id, which GraphML itself calls "id"
    head += [f'<key id="{k}" for="{d}" attr.name="{escape("id" if c == "name" else c)}" attr.type="string"/>' for k, d, c in keys]
    head += ['<graph edgedefault="directed">']

    def data(prefix, cols):
        return F.concat(F.lit(""), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{prefix}{i}">'), _xml(F.col(c)), F.lit("</data>"))).otherwise("")
                                     for i, c in enumerate(cols)])
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "section int, place bigint, line string")
    nodes = v.select(F.lit(1).alias("section"), F.lit(None).cast("bigint").alias("place"),
                     F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("n", va), F.lit("</node>")).alias("line"))
    links = e.select(F.lit(2).alias("section"), F.lit(None).cast("bigint").alias("place"),
                     F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), data("e", ea), F.lit("</edge>")).alias("line"))
    return frame.unionByName(nodes).unionByName(links)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str, single_file: bool = False) -> None:
    """GraphML as ordered part files: concatenated by name they are one valid document.

    Rows are range-partitioned by section, so the write is parallel and never passes the driver.
    ``single_file`` asks for one part file, for graphs a desktop tool opens.
    """
    # a hash inside the section lets the ranges split the (large) node and edge sections
    rows = graphml_lines(vertices, edges).withColumn("_h", F.xxhash64("line"))
    order = ["section", F.coalesce("place", "_h"), "line"]
    out = rows.repartitionByRange(1, *order) if single_file else rows.repartitionByRange(*order)
    out.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_run_log(spark: SparkSession, path: str, steps: list[dict], started: datetime) -> None:
    """Run log (steps with time stamps and settings) as one small JSON line file."""
    now = datetime.now(timezone.utc)
    log = {"started": started.isoformat(), "finished": now.isoformat(), "seconds": (now - started).total_seconds(), "steps": steps}
    spark.createDataFrame([(json.dumps(log, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
