"""Session defaults and small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BATCH = 1000


def local_session(cores: str = "*", name: str = "editlens") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.editlens.inputPartitions", "8" if cores == "*" else cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Where the setting is unset, a local session gets a folder of its own; a cluster must name one, because
    executors do not share a machine's temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def stored_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def short_batches(spark: SparkSession) -> None:
    """Let Python columns take ``ROWS_PER_BATCH`` rows at a time, unless the session asks for fewer.

    Spark holds the whole rows of the batches under way at each Python column until their results are back, and puts
    them into files of the executor when its memory is short. Case rows have several kilobytes. The setting stays with
    the session.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS_PER_BATCH:
        spark.conf.set(setting, str(ROWS_PER_BATCH))


def exploded(df: DataFrame, array: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """One row per element (none of them null) of an array, as column ``name`` beside ``keep``.

    Before an inner explode Spark puts a filter on the array's size and pushes it down to where the array is made, so
    that all of it is made twice. An outer explode has no such filter.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out again if the session asks for it by ``spark.editlens.inputPartitions``.

    A table of one file with one row group is one task. Local tests and benches set the number; a cluster leaves it
    unset, and tables are read as they are split.
    """
    asked = df.sparkSession.conf.get("spark.editlens.inputPartitions", None)
    return df.repartition(int(asked)) if asked else df
