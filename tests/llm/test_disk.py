"""What written steps leave on the disks of the executors."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from editlens.llm import common


def test_stored_leaves_no_shuffle_files(spark):
    """Shuffles of a written step were kept as long as the session wished; its setting stays as it was."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    tops = [str(x) for x in env.blockManager().diskBlockManager().localDirs()]

    def files() -> set[str]:
        return {n for top in tops for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(common.CLEANUP)
    rows = common.stored(spark.range(10_000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common.CLEANUP) == setting
    assert {r["count"] for r in rows.collect()} == {1428, 1429}
