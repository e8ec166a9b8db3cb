"""A cache of answers by model identity and key, in folders by key bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens.session import scratch, stored_or_empty

#: Buckets a cache has. Part of the layout: a stored cache is read with the number it was written with.
BUCKETS = 1024
PLACE = ("identity", "bucket")


def identity_digest(identity: str) -> Column:
    """What stands for a model's identity (name, version, settings) in the cache, of one length and fit for a folder."""
    return F.sha2(F.lit(identity).cast("binary"), 256)


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def read_cache(spark: SparkSession, path: str, schema: T.StructType, identity: str, buckets: list[int] | None = None) -> DataFrame:
    """Answers of one model, with their bucket; only the folders of this model and of ``buckets`` are read.

    A cache that does not exist yet is empty.
    """
    columns = [f for f in schema.fields if f.name not in PLACE]
    rows = stored_or_empty(spark, path, T.StructType([*columns, T.StructField("identity", T.StringType()), T.StructField("bucket", T.IntegerType())]))
    own = rows.filter(F.col("identity") == identity_digest(identity))
    return (own if buckets is None else own.filter(F.col("bucket").isin(buckets))).drop("identity")


def pending(batch: DataFrame, key: str, path: str, schema: T.StructType, identity: str) -> DataFrame:
    """Rows of a batch whose key the cache lacks, one a key; rows without a key are left out.

    The driver gets the numbers of the batch's buckets, BUCKETS at most, and no key.
    """
    placed = batch.filter(F.col(key).isNotNull()).withColumn("_bucket", bucket_of(key))
    touched = sorted(r["_bucket"] for r in placed.select("_bucket").distinct().collect())
    known = read_cache(batch.sparkSession, path, schema, identity, touched).select(F.col("bucket").alias("_bucket"), key)
    return placed.dropDuplicates(["_bucket", key]).join(known, ["_bucket", key], "left_anti").drop("_bucket")


def append(answers: DataFrame, key: str, path: str, identity: str) -> None:
    """Add answers, at most one file for each bucket."""
    placed = answers.drop(*PLACE).withColumn("identity", identity_digest(identity)).withColumn("bucket", bucket_of(key))
    placed.repartition("bucket").write.mode("append").partitionBy(*PLACE).parquet(path)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, identity: str, files: int = 8) -> int:
    """Rewrite each bucket of a model that has more than ``files`` files as one file; gives the number of such buckets.

    Answers that stand in several files (a batch that was run twice at once) are kept once. The new files are staged in
    the shared scratch folder and take the place of the bucket's folder by a dynamic overwrite; other buckets stay as
    they are. No fill of the same cache may run meanwhile.
    """
    rows = read_cache(spark, path, schema, identity)
    many = rows.groupBy("bucket").agg(F.count_distinct("_metadata.file_path").alias("n")).filter(F.col("n") > files)
    chosen = sorted(r["bucket"] for r in many.collect())
    if chosen:
        staged = scratch(spark)
        read_cache(spark, path, schema, identity, chosen).dropDuplicates([key]).write.parquet(staged)
        again = spark.read.parquet(staged).withColumn("identity", identity_digest(identity))
        again.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)
    return len(chosen)
