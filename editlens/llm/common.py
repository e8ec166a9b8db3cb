"""Helpers shared by the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editlens.session import scratch

#: Whether Spark removes a plan's shuffle files when the plan has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage.

    Nothing reads the shuffle files of the writing plan again, so Spark is asked to remove them when it ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ranges of the keys, with their range (``_part``) and place in it (``_pos``), as a stored table.

    Keys should tell rows apart; rows of equal keys stay in one range.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(placed.withColumns({"_part": F.spark_partition_id(), "_pos": inside}))


def before_part(parts: DataFrame, amount: str, name: str) -> DataFrame:
    """Per ``_part``, the amount in all earlier parts. One row a partition goes in, so the window is small."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast("long").alias(name))


def numbered(df: DataFrame, *keys: str, name: str = "_n") -> DataFrame:
    """Number all rows by the keys from 0. The broadcast has one row a partition."""
    placed = ranged(df, *keys)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    shift = F.broadcast(before_part(sizes, "_size", "_shift"))
    return placed.join(shift, "_part").withColumn(name, F.col("_shift") + F.col("_pos")).drop("_part", "_pos", "_shift")


def utf8(text: str) -> Column:
    return F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)``, root being the smallest node reachable.

    Alternates large-star and small-star steps on stored edges until nothing changes. A step groups by node with a
    minimum that is computed before the shuffle, so a node with very many links needs no list of them.
    """
    pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(lowest, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        pairs = stored(small.select("a", F.col("m").alias("b")).union(small.filter("b > m").select("b", "m")).filter("a <> b").distinct())
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
        before = state
