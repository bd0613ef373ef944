"""Readers for every input of the workflow, as DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as SC
from ..functions.text import PY_WS
from ..session import dense_index

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def list_files(spark: SparkSession, folder: str, prefix: str = "", contains: str = "", suffixes: tuple[str, ...] = ()) -> list[str]:
    """Paths of a folder, sorted by name; works on any file system Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(path) if s.isFile()]
    return [p for n, p in sorted(found) if n.startswith(prefix) and contains in n and (not suffixes or n.lower().endswith(suffixes))]


def _documents(df: DataFrame) -> DataFrame:
    """Shape to (id, text, metadata): ids become text whatever their JSON type."""
    meta = F.col("metadata") if "metadata" in df.columns else F.lit(None)
    return df.select(F.col("id").cast("string").alias("id"), "text", meta.cast("map<string,string>").alias("metadata"))


def read_documents(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """JSON arrays and JSON lines (optionally gzipped) whose name starts with ``prefix``.

    ``.jsonl`` files split and stream by line; a whole-file array is parsed by one task per file.
    """
    schema = T.StructType([T.StructField("id", SC.S), T.StructField("text", SC.S), T.StructField("metadata", T.MapType(SC.S, SC.S))])
    lines = list_files(spark, folder, prefix, suffixes=(".jsonl", ".jsonl.gz"))
    whole = list_files(spark, folder, prefix, suffixes=(".json", ".json.gz"))
    parts = ([spark.read.schema(schema).json(lines)] if lines else []) + ([spark.read.schema(schema).json(whole, multiLine=True)] if whole else [])
    if not parts:
        raise FileNotFoundError(f"no .json or .jsonl file starting with {prefix!r} in {folder}")
    return _documents(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def read_records(spark: SparkSession, folder: str, contains: str = "", first_files: int | None = None) -> DataFrame:
    """Extraction records with (file_name, line_no): the order of every first-wins rule.

    The three array columns stay JSON text; their values are type-checked when flattened.
    ``first_files`` keeps the first files by name (the debugging switch).
    """
    files = list_files(spark, folder, contains=contains)
    files = files if first_files is None else files[:first_files]
    lines = spark.read.text(files).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"),
        # byte position of the split, then row order inside it: increasing within a file
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("_o"),
        F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    arr = lambda k: F.to_json(F.try_variant_get("v", f"$.{k}", "variant")).alias(k)
    rows = lines.select("file_name", "_o", get("id"), get("original_text"), arr("entity_relation_dict"), arr("event_entity_relation_dict"), arr("event_relation_dict"))
    return dense_index(rows, ["file_name", "_o"], "line_no").drop("_o")


def read_table(spark: SparkSession, path, header: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with multi-line quoted fields and doubled quotes; ``header`` renames file to table columns."""
    df = spark.read.options(**_CSV).csv(path)
    if header:
        df = df.select(*[F.col(f"`{f}`").alias(c) for c, f in header.items() if f in df.columns])
    return df.select(*columns) if columns else df


def parse_list(c: str):
    """Array of texts from a list written as text: JSON first, Python quoting as it is accepted."""
    a = F.from_json(F.col(c), "array<string>", {"allowSingleQuotes": "true"})
    clean = F.filter(F.transform(a, lambda x: F.regexp_replace(F.regexp_replace(x, f"^{PY_WS}+", ""), f"{PY_WS}+\\z", "")), lambda x: x != "")
    return F.coalesce(clean, F.array().cast("array<string>"))


def read_graph_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables written by ``sinks.writers.write_graph_tables``."""
    n = read_table(spark, f"{folder}/triple_nodes", SC.NODE_HEADER).withColumn("concepts", parse_list("concepts")).withColumn("synsets", parse_list("synsets"))
    e = read_table(spark, f"{folder}/triple_edges", SC.EDGE_HEADER).withColumn("concepts", parse_list("concepts")).withColumn("synsets", parse_list("synsets"))
    return {"nodes": n, "edges": e, "text_nodes": read_table(spark, f"{folder}/text_nodes", SC.TEXT_NODE_HEADER),
            "text_edges": read_table(spark, f"{folder}/text_edges", SC.TEXT_EDGE_HEADER),
            "missing_concepts": read_table(spark, f"{folder}/missing_concepts", SC.WORKLIST_HEADER)}


def read_triples_tsv(spark: SparkSession, path, underscores_to_spaces: bool = False) -> DataFrame:
    df = spark.read.schema(SC.TRIPLE_TSV).csv(path, sep="\t", quote="")
    return df.select(*[F.translate(c, "_", " ").alias(c) for c in df.columns]) if underscores_to_spaces else df


def read_types_tsv(spark: SparkSession, path, underscores_to_spaces: bool = False) -> DataFrame:
    df = spark.read.schema(SC.TYPE_TSV).csv(path, sep="\t", quote="")
    return df.withColumn("entity", F.translate("entity", "_", " ")) if underscores_to_spaces else df


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One English document per markdown file; the fixed id is part of the format."""
    files = list_files(spark, folder, suffixes=(".md", ".markdown"))
    return spark.read.text(files, wholetext=True).select(
        F.lit("1").alias("id"), F.col("value").alias("text"), F.create_map(F.lit("lang"), F.lit("en")).alias("metadata"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"))


def read_graphml(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a GraphML file; attributes come back under their declared names."""
    def rows(tag):
        return spark.read.format("xml").options(rowTag=tag, attributePrefix="_", valueTag="_v", inferSchema="false")
    data = "data ARRAY<STRUCT<_key STRING, _v STRING>>"
    keys = {r["_id"]: r["name"] for r in rows("key").schema("_id STRING, `_attr.name` STRING, `_for` STRING").load(path).select(
        "_id", F.col("`_attr.name`").alias("name")).collect()}  # one row per declared attribute
    m = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_v"])))

    def named(df, ids):
        return df.withColumn("_m", m).select(*ids, *[F.try_element_at("_m", F.lit(k)).alias(n) for k, n in _first_by_name(keys).items()])
    v = named(rows("node").schema(f"_id STRING, {data}").load(path), [F.col("_id").alias("node")])
    e = named(rows("edge").schema(f"_source STRING, _target STRING, {data}").load(path), [F.col("_source").alias("src"), F.col("_target").alias("dst")])
    return v, e


def _first_by_name(keys: dict[str, str]) -> dict[str, str]:
    """Attribute keys with unique output names: nodes and edges may declare the same name."""
    seen: dict[str, int] = {}
    out = {}
    for k, n in sorted(keys.items()):
        out[k] = n if n not in seen else f"{n}_{seen[n]}"
        seen[n] = seen.get(n, 0) + 1
    return out


def read_embeddings_csv(spark: SparkSession, path, id_column: str, vector_column: str = "embedding:STRING") -> DataFrame:
    """(id, vec) of an embedding table whose vectors are list literals."""
    df = spark.read.options(**_CSV).csv(path)
    return df.select(F.col(f"`{id_column}`").alias("id"), F.from_json(F.col(f"`{vector_column}`"), "array<float>").alias("vec"))


def read_questions(spark: SparkSession, path, kind: str = "hotpot", samples: int | None = None) -> DataFrame:
    """Questions of a JSON array: (pos, question, answer, gold). Gold is titles or paragraph texts."""
    if kind == "musique":
        df = spark.read.schema(SC.QA_MUSIQUE).json(path, multiLine=True)
        gold = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["paragraph_text"])
    else:
        df = spark.read.schema(SC.QA_HOTPOT).json(path, multiLine=True)
        gold = F.array_distinct(F.transform("supporting_facts", lambda f: F.get(f, F.lit(0))))
    rows = df.select("question", "answer", gold.alias("gold")).withColumn("_o", F.monotonically_increasing_id())
    out = dense_index(rows, ["_o"], "pos").drop("_o")
    return out.filter(F.col("pos") < samples) if samples else out


def read_question_contexts(spark: SparkSession, path, samples: int | None = None) -> DataFrame:
    """Context paragraphs as documents: (doc_no, title, text, question); of the first ``samples`` only, if given."""
    ctx = F.from_json("context", "array<array<string>>")
    df = spark.read.schema(SC.QA_HOTPOT).json(path, multiLine=True).withColumn("_o", F.monotonically_increasing_id())
    head = dense_index(df, ["_o"], "sample")
    if samples is not None:
        head = head.filter(F.col("sample") < samples)
    rows = head.select("sample", "question", F.posexplode(ctx).alias("place", "c")).select(
        "sample", "place", "question", F.get("c", F.lit(0)).alias("title"),
        F.array_join(F.from_json(F.get("c", F.lit(1)), "array<string>"), " ").alias("text"))
    return dense_index(rows, ["sample", "place"], "doc_no")


def read_factuality(spark: SparkSession, path) -> DataFrame:
    """Segment rows of factuality samples: (index, domain, segment_no, segment, label)."""
    df = spark.read.schema(SC.FACTUALITY).json(path)
    return df.select("index", "domain", "prompt", F.posexplode(F.arrays_zip("segmented_response", "labels")).alias("segment_no", "z")).select(
        "index", "domain", "prompt", "segment_no", F.col("z.segmented_response").alias("segment"), F.col("z.labels").cast("int").alias("label"))


def read_folder(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Every JSON-lines file below a folder, at any depth."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(folder)


def read_archives(spark: SparkSession, folder: str, suffix: str = ".jsonl.zst") -> DataFrame:
    """Documents of compressed line archives with a dense offset over all sorted files.

    The codec comes from the cluster's Hadoop build (zstd there, gzip everywhere).
    """
    files = list_files(spark, folder, suffixes=(suffix,))
    rows = spark.read.text(files).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("_o"),
        F.get_json_object("value", "$.text").alias("text"))
    return dense_index(rows, ["file_name", "_o"], "offset").drop("_o")


def union_shards(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
