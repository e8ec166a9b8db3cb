"""Order checks on long sequences that spread one hot sequence over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def with_previous(df: DataFrame, key: str, order: str, *columns: str, block: int = BLOCK) -> DataFrame:
    """Add ``prev_<column>`` of the row before in ``order``, whatever gaps the ordinals have.

    A window runs over blocks of the ordinal. The first row of a block takes the last row of the block before it that
    has rows, from a table with one row a block, so no task has to hold a whole sequence.
    """
    placed = df.withColumn("_block", F.floor(F.col(order) / block))
    tails = placed.groupBy(key, "_block").agg(F.max_by(F.struct(*columns), order).alias("_tail"))
    earlier = F.lag("_tail").over(Window.partitionBy(key).orderBy("_block"))
    tails = tails.select(key, "_block", earlier.alias("_tail"))
    window = Window.partitionBy(key, "_block").orderBy(order)
    before = F.coalesce(F.lag(F.struct(*columns)).over(window), F.col("_tail"))
    joined = placed.join(tails, [key, "_block"]).withColumn("_before", before)
    return joined.select(*df.columns, *[F.col("_before")[c].alias(f"prev_{c}") for c in columns])


def monotone_violations(segments: DataFrame, key: str) -> DataFrame:
    """Rows whose start or end lies before that of the row before, or before zero."""
    pairs = with_previous(segments, key, "ord", "start", "end")
    back = (F.col("start") < F.coalesce("prev_start", F.lit(0.0))) | (F.col("end") < F.coalesce("prev_end", F.lit(0.0)))
    return pairs.filter(back).select(key, "ord", "start", "end")


def mismatches(cases: DataFrame, expected: str, units: str) -> DataFrame:
    """Places where aligned words differ from the transcript, a missing side included."""
    both = F.expr(
        f"zip_with({expected}, transform({units}, u -> u.word), (e, h) -> named_struct('expected', e, 'found', h))"
    )
    rows = cases.select("case_id", F.posexplode(both).alias("ord", "w")).select("case_id", "ord", "w.*")
    return rows.filter("not expected <=> found")
