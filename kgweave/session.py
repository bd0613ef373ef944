"""Session set-up, lineage cutting and order-preserving numbering shared by every operator."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

# monotonically_increasing_id keeps the row's offset inside its partition in the low 33 bits
_OFFSET_MASK = (1 << 33) - 1


def build_session(app: str = "kgweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on; any of them may be overridden by ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's ``spark.checkpoint.dir`` when it is set.

    Only a local master, whose "executors" share this machine's disk, may fall back to a
    temporary folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="kgweave-checkpoints-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A stored copy below the shared checkpoint folder: survives executor loss and ends the plan.

    Written as compressed columns, of which later steps read those they use; a checkpoint holds plain rows. Types
    that the format lacks are checkpointed.
    """
    if not df.columns or len({c.lower() for c in df.columns}) < len(df.columns) or not all(_storable(f.dataType) for f in df.schema):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_path(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _storable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_storable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    return isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType, T.DecimalType, T.DateType, T.IntegralType, T.FloatType, T.DoubleType))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order_by: list) -> DataFrame:
    """Globally sorted, lineage-cut copy of ``df`` carrying (_pid, _off): partition and offset.

    The sort reads its input twice, for the ranges and for the rows: it is kept until both are done.
    """
    n = shuffle_width(df.sparkSession)
    kept = df.persist()
    rows = (
        kept.repartitionByRange(n, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_off", F.monotonically_increasing_id().bitwiseAND(F.lit(_OFFSET_MASK)))
    )
    done = cut_lineage(rows)
    kept.unpersist()
    return done


def dense_index(df: DataFrame, order_by: list, name: str = "pos") -> DataFrame:
    """Append a dense 0-based position in the total order ``order_by`` without a one-task window.

    Range partitioning sorts the data in parallel; the only global step works on one count per
    partition, so both the window and the broadcast below hold at most `shuffle.partitions` rows.
    """
    fixed = _ranged(df, order_by)
    starts = (
        fixed.groupBy("_pid").agg(F.count("*").alias("_n"))
        .select("_pid", F.coalesce(
            F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"))
    )
    return (
        fixed.join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + F.col("_off"))
        .drop("_pid", "_off", "_start")
    )


def running_total(df: DataFrame, order_by: list, value: str, name: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` in the total order ``order_by``, computed in parallel."""
    fixed = _ranged(df, order_by)
    starts = (
        fixed.groupBy("_pid").agg(F.sum(value).alias("_n"))
        .select("_pid", F.coalesce(
            F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"))
    )
    inside = F.coalesce(
        F.sum(value).over(W.partitionBy("_pid").orderBy("_off").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0))
    return (
        fixed.withColumn("_local", inside)
        .join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_pid", "_off", "_start", "_local")
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location below the shared checkpoint folder for a written intermediate table."""
    import uuid

    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an input that is read by fewer tasks than there are cores.

    Large inputs already arrive in many splits and pass through untouched; only a small file that
    one task would read (and whose rows are costly to process) pays for a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A table written once, bucketed and sorted by ``keys`` below the shared checkpoint folder: later joins and
    aggregates on these keys read each bucket where it lies, without an exchange."""
    import uuid

    spark = df.sparkSession
    n, title = shuffle_width(spark), f"{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
     .option("path", scratch_path(spark, name)).saveAsTable(title))
    return spark.table(title)
