"""The answer cache: models apart, only a batch's buckets read, buckets put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from editlens import schemas
from editlens.sources import cache
from editlens.streaming import logs

SCHEMA = schemas.struct(key=schemas.LONG, answer=schemas.STRING)


def fill(spark, folder, path, point, identity, scored):
    def score(df):
        assert {r["bucket"] for r in df.select("bucket").distinct().collect()} <= {"mine"}  # the requests' own column
        scored.append(df.count())
        return df.selectExpr("key", f"'{identity}' as answer")

    logs.stream_fill_cache(spark.readStream.schema("key long, bucket string").json(folder), "key", path, SCHEMA, score, point, identity)


def test_versions_do_not_share_answers(spark, tmp_path):
    folder, path, scored = f"{tmp_path}/log", f"{tmp_path}/cache", []
    spark.range(40).selectExpr("if(id = 0, null, id % 20) as key", "'mine' as bucket").write.json(folder)
    for n, identity in enumerate(("m@1", "m@2", "m@1")):
        fill(spark, folder, path, f"{tmp_path}/point{n}", identity, scored)
    assert scored == [20, 20, 0]
    for identity in ("m@1", "m@2"):
        rows = cache.read_cache(spark, path, SCHEMA, identity)
        assert rows.count() == 20 and {r.answer for r in rows.collect()} == {identity}
    assert cache.read_cache(spark, path, SCHEMA, "m@3").count() == 0
    assert cache.read_cache(spark, f"{tmp_path}/none", SCHEMA, "m@1").count() == 0


def test_only_touched_buckets_are_read(spark, tmp_path, capsys):
    path = f"{tmp_path}/cache"
    cache.append(spark.range(500).selectExpr("id as key", "'a' as answer"), "key", path, "m")
    batch = spark.range(3).withColumnRenamed("id", "key")
    wanted = sorted({r.b for r in batch.select(cache.bucket_of("key").alias("b")).collect()})
    rows = cache.read_cache(spark, path, SCHEMA, "m", wanted)
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.bucket for r in rows.collect()} == set(wanted)
    left = cache.pending(spark.range(498, 503).withColumnRenamed("id", "key"), "key", path, SCHEMA, "m")
    assert sorted(r.key for r in left.collect()) == [500, 501, 502]


def test_compaction(spark, tmp_path):
    path = f"{tmp_path}/cache"
    for _ in range(3):
        cache.append(spark.range(30).selectExpr("id as key", "'a' as answer"), "key", path, "m")
    cache.append(spark.range(30).selectExpr("id as key", "'b' as answer"), "key", path, "other")
    buckets = cache.read_cache(spark, path, SCHEMA, "m").select("bucket").distinct().count()
    assert cache.compact(spark, path, SCHEMA, "key", "m", files=2) == buckets
    rows = cache.read_cache(spark, path, SCHEMA, "m")
    assert rows.count() == 30 and rows.select(F.col("_metadata.file_path")).distinct().count() == buckets
    assert cache.compact(spark, path, SCHEMA, "key", "m", files=2) == 0
    assert cache.read_cache(spark, path, SCHEMA, "other").count() == 30
