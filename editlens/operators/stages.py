"""Build order of assets that are generated from other assets: depth, dangling references and cycles as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens.operators.quality import RECIPE_PROVIDERS
from editlens.operators.skew import salted_join
from editlens.session import checkpoint_dir

#: Providers build one after the other, in this order.
PROVIDER_ORDER = RECIPE_PROVIDERS


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back; a round starts from the rows of the one before."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _jump(open_: DataFrame, pointers: DataFrame) -> DataFrame:
    """Replace each pointer by its target's pointer; a pointer covers twice as many references as before.

    ``end`` is where a chain ends: ``root``, ``dangling``, or null while it is not known. Very many assets may point to
    one (a popular voice), so the join is salted.
    """
    target = pointers.select(F.col("asset_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("end").alias("found"))
    moved = salted_join(open_.select("asset_id", "up", "steps"), target, "up", "left")
    return moved.select("asset_id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("found").alias("end"))


def chain_ends(assets: DataFrame) -> DataFrame:
    """``asset_id, depth, end`` for unique assets ``(asset_id, reference_asset_id)``.

    Depth is the number of references up to the end of the chain, and end is ``root``, ``dangling`` (a reference to
    nothing), ``cycle`` or ``behind_cycle``; the last two have no depth. Pointers are doubled, so a chain of length n
    takes log2(n) rounds: a round that settles no chain leaves only cycles and what points into them. From there on the
    assets that are pointed at become fewer until just the cycles are left.
    """
    known = assets.select(F.col("asset_id").alias("reference_asset_id"), F.lit(True).alias("known"))
    joined = salted_join(assets.filter("reference_asset_id is not null").select("asset_id", "reference_asset_id"), known, "reference_asset_id", "left")
    one = F.lit(1).cast("long")
    linked = joined.select(
        "asset_id",
        F.when(F.col("known"), F.col("reference_asset_id")).alias("up"),
        one.alias("steps"),
        F.when(F.col("known").isNull(), F.lit("dangling")).alias("end"),
    )
    free = assets.filter("reference_asset_id is null").select("asset_id", F.lit(None).cast("string").alias("up"), (one - 1).alias("steps"), F.lit("root").alias("end"))
    pointers = _stored(linked.unionByName(free))
    waiting, targets = pointers.filter("end is null").count(), None
    while waiting:
        settled, open_ = pointers.filter("end is not null"), pointers.filter("end is null")
        pointers = _stored(settled.unionByName(_jump(open_, pointers)))
        before, waiting = waiting, pointers.filter("end is null").count()
        if waiting == before:
            # Only cycles and what leads into them are left.
            last, targets = targets, pointers.filter("end is null").select("up").distinct().count()
            if last == targets:
                break
    on_cycle = pointers.filter("end is null").select(F.col("up").alias("asset_id")).distinct().withColumn("member", F.lit(True))
    rest = pointers.filter("end is null").select("asset_id").join(on_cycle, "asset_id", "left")
    loops = rest.select("asset_id", F.lit(None).cast("long").alias("depth"), F.when(F.col("member"), "cycle").otherwise("behind_cycle").alias("end"))
    return pointers.filter("end is not null").select("asset_id", F.col("steps").alias("depth"), "end").unionByName(loops)


def asset_stages(assets: DataFrame) -> DataFrame:
    """``asset_id, reference_asset_id, provider, turn, stage, status``: a row for each distinct asset.

    ``turn`` is the place of the provider in PROVIDER_ORDER from 1 (0: no provider is needed), ``stage`` the number of
    references that have to be built first. ``status`` is ``independent`` or ``generate_after``, or why an asset can't be built:
    ``dangling`` (its reference does not exist), ``behind_dangling``, ``cycle``, ``behind_cycle``, or ``late_reference``
    (its reference belongs to a provider whose turn comes later). Stage is null for dangling chains and cycles. Assets
    without id are left out; copies of an asset count once.
    """
    unique = assets.filter("asset_id is not null").select("asset_id", "reference_asset_id", "provider").dropDuplicates(["asset_id"])
    order = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PROVIDER_ORDER]), F.col("provider")), F.lit(0)).cast("int")
    rows = _stored(unique.withColumn("turn", order))
    ends = chain_ends(rows)
    turns = rows.select(F.col("asset_id").alias("reference_asset_id"), F.col("turn").alias("reference_turn"))
    referring = salted_join(rows.filter("reference_asset_id is not null"), turns, "reference_asset_id", "left")
    both = referring.unionByName(rows.filter("reference_asset_id is null").withColumn("reference_turn", F.lit(None).cast("int")))
    late = F.coalesce(F.col("reference_turn") > F.col("turn"), F.lit(False))
    status = (
        F.when((F.col("end") == "dangling") & (F.col("depth") > 1), "behind_dangling")
        .when(F.col("end") != "root", F.col("end"))
        .when(late, "late_reference")
        .when(F.col("depth") == 0, "independent")
        .otherwise("generate_after")
    )
    stage = F.when(F.col("end") == "root", F.col("depth"))
    return both.join(ends, "asset_id").select("asset_id", "reference_asset_id", "provider", "turn", stage.alias("stage"), status.alias("status"))
