"""URL allow and block rules by a sort-merge range join over canonical keys.

A key is the host's labels in reverse, a separator and the path, so that everything below a rule's host at
one depth with a path below the rule's is one interval of keys, and intervals are disjoint or nested. A URL
has one key per host suffix; suffixes without any rule are dropped by an equi-join. Interval ends and keys
are sorted together by range partitioning; the sweep keeps the stack of open rules as its top: a start
pushes its rule, an end pops to the rule around it. What is open at the start of a partition follows from
one row per partition. Native DataFrame operations only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import save

DEFAULT_VERDICT = "allow"
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_GAP, _LAST = "\u0001", "\U0010FFFF"


def lowered(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def innermost(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, prefix): the longest of ``prefixes`` (column prefix, distinct) that starts each distinct key."""
    inner = prefixes.select("prefix", F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("n")).where(F.col("n") < F.length("prefix"))
    around = (inner.select("prefix", F.expr("substring(prefix, 1, n)").alias("outer"))
              .join(prefixes.select(F.col("prefix").alias("outer")), "outer")
              .groupBy("prefix").agg(F.max_by("outer", F.length("outer")).alias("outer")))
    starts = prefixes.select(F.col("prefix").alias("at"), F.lit(0).alias("kind"), F.col("prefix").alias("top"))
    ends = prefixes.join(around, "prefix", "left").select(F.concat("prefix", F.lit(_LAST)).alias("at"), F.lit(2).alias("kind"), F.coalesce("outer", F.lit("")).alias("top"))
    points = keys.select(F.col("key").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("top"))
    events = save(starts.unionByName(ends).unionByName(points).repartitionByRange("at", "kind").withColumn("slice", F.spark_partition_id()), "events")
    order = F.struct("at", "kind")
    left_open = events.where("kind <> 1").groupBy("slice").agg(F.max_by("top", order).alias("last"))
    # one row per slice of the sort: at most as many as there are partitions
    slices = events.select("slice").distinct().join(left_open, "slice", "left")
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select("slice", F.last("last", True).over(before).alias("carried"))
    run = W.partitionBy("slice").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = events.withColumn("own", F.last("top", True).over(run)).where("kind = 1")
    return (swept.join(carried, "slice").select(F.col("at").alias("key"), F.coalesce("own", "carried", F.lit("")).alias("prefix")).where("prefix <> ''"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's
    path. Of fitting rules the one with the longest host + path wins, then the longer host, and "block"
    among rules stated twice. Without a fitting rule ``rule`` is null and the verdict is ``default``. A null
    url and one without "://" have an empty host and path. Rules without host or verdict are ignored, a null
    path is empty. Repeated rows are judged alike; a null page_id stays. Other columns are ignored.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = (rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
             .select(F.concat(reversed_host(F.col("host")), F.lit(_GAP), "path").alias("prefix"), reversed_host(F.col("host")).alias("stem"),
                     F.concat("host", "path").alias("rule"), F.length("host").alias("depth"), "verdict"))
    known = save(known, "rules")

    urls = save(rows.where("host <> ''").select("host", "path").distinct(), "urls")
    labels = F.reverse(F.split("host", r"\."))
    stems = (urls.select("host", "path", labels.alias("labels"))
             .select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.slice("labels", F.lit(1), n), "."))).alias("stem"))
             .join(known.select("stem").distinct(), "stem", "left_semi"))
    asked = save(stems.select("host", "path", F.concat("stem", F.lit(_GAP), "path").alias("key")), "keys")
    fits = innermost(asked.select("key").distinct(), known.select("prefix"))
    best = (asked.join(fits, "key").join(known, "prefix").groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "depth", "rule", "verdict")).alias("best"))
            .select("host", "path", "best.rule", "best.verdict"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
