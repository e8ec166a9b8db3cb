"""Models as plug-ins: scorers, generators and planners over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens.session import checkpoint_dir

Batch = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Scorer:
    """``load`` runs once per task and returns the function that scores a batch."""

    load: Callable[[], Batch]
    schema: T.StructType
    identity: str


_SCORERS: dict[str, Scorer] = {}
_PLANNERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_scorer(name: str, load: Callable[[], Batch], schema: T.StructType, identity: str) -> None:
    _SCORERS[name] = Scorer(load, schema, identity)


def score(df: DataFrame, name: str) -> DataFrame:
    """Score a table; the identity of the scorer is kept beside each result."""
    scorer = _SCORERS[name]
    load = scorer.load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, scorer.schema).withColumn("identity", F.lit(scorer.identity))


def register_planner(name: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    _PLANNERS[name] = plan


def plan(cases: DataFrame, name: str) -> DataFrame:
    return _PLANNERS[name](cases)


GENERATED = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("input_sha256", T.StringType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def apply_generator(steps: DataFrame, sources: DataFrame, generate: Batch) -> DataFrame:
    """Run chained steps: step n works on the output of step n - 1.

    ``steps``: case_id, step, xml; ``sources``: case_id, input_sha256;
    ``generate`` adds output_sha256 (null with an ``error``) to a batch. There are as many waves as the longest
    plan has steps; an empty plan gives no rows. A finished wave is checkpointed, so a lost executor does not
    repeat it; a failed step ends its chain with a row, any other error stops the
    job.
    """
    checkpoint_dir(steps.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = generate(batch)
            done["status"] = done["output_sha256"].notna().map({True: "ok", False: "error"})
            yield done[GENERATED.names]

    last = steps.agg(F.max("step")).first()[0]
    current, finished = sources.select("case_id", "input_sha256"), [steps.sparkSession.createDataFrame([], GENERATED)]
    for wave in range(0 if last is None else last + 1):
        todo = steps.filter(F.col("step") == wave).select("case_id", "step", "xml").join(current, "case_id")
        result = todo.mapInPandas(run, GENERATED).checkpoint()
        finished.append(result)
        current = result.filter("status = 'ok'").select("case_id", F.col("output_sha256").alias("input_sha256"))
    trace = finished[0]
    for more in finished[1:]:
        trace = trace.unionByName(more)
    return trace


def identity(cases: DataFrame) -> DataFrame:
    """The generator that returns its source; a smoke run of the whole pipeline."""
    return cases.select("case_id", F.col("sha256").alias("output_sha256"), F.lit("ok").alias("status"))
