"""F0 frames in unit spans: in the row of a recording, or by a range join where frames are rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.functions.tracks import SLACK, span_statistics
from editlens.functions.unit_measures import every_statistics, pitched_statistics
from editlens.functions.units import let, marked

BUCKET_SECONDS = 1.0
SIDES = {"source": ("s", "src"), "target": ("t", "tgt")}


def side_intervals(side: str) -> str:
    """Spans (ord, start, end, closed, pitched) of a side's units with a positive length.

    ``closed``: the span reaches the end of its recording and includes its last
    frame. ``pitched``: a pitch operation covers the unit.
    """
    array, name = SIDES[side]
    covered = (
        f"flatten(transform(filter(parsed.ops, o -> o.kind = 'pitch'),"
        f" o -> {marked(array, f'o.{name}_start', f'o.{name}_end')}))"
    )
    spans = f"""transform({array}, (u, i) -> named_struct('ord', i,
            'start', least(greatest(u.t0, 0D), {side}_duration), 'end', least(u.t1, {side}_duration),
            'closed', u.t1 >= {side}_duration - 1e-10D, 'pitched', array_contains(covered, i)))"""
    return f"filter({let('covered', covered, spans)}, u -> u.end > u.start)"


def unit_intervals(timed: DataFrame) -> DataFrame:
    """Rows (case_id, side, ord, start, end, closed, pitched) of the units with a positive length."""
    sides = [
        f"""transform({side_intervals(side)}, u -> named_struct('side', '{side}', 'ord', u.ord,
            'start', u.start, 'end', u.end, 'closed', u.closed, 'pitched', u.pitched))"""
        for side in SIDES
    ]
    return timed.select("case_id", F.expr(f"explode(concat({', '.join(sides)}))").alias("u")).select("case_id", "u.*")


def with_unit_statistics(timed: DataFrame, every_median: bool = False) -> DataFrame:
    """Add ``source_stats`` and ``target_stats``: statistics (with ord) of each span that holds a frame.

    Needs ``source_track`` and ``target_track``, arrays of frames (t, hz). A recording's units and frames are in one
    row, so nothing is shuffled. Medians are made for units of pitch operations, or for all.
    """
    stats = {}
    for side, (array, _) in SIDES.items():
        duration, track = f"{side}_duration", f"{side}_track"
        if every_median:
            stats[f"{side}_stats"] = every_statistics(array, duration, track)
        else:
            stats[f"{side}_stats"] = pitched_statistics[side](array, duration, "parsed.ops", track)
    return timed.withColumns(stats).drop(*[f"{side}_track" for side in SIDES])


def track_statistics() -> dict[str, Column]:
    """``source_found`` and ``target_found``: statistics of each unit of a case, for the pass that reads its instruction.

    Rows wait in full at a Python column, and the less it is sent of a row the more rows wait. Tracks are most of a
    row, so they are used up in the first pass. A case with a pitch tag gets all its units ranked.
    """
    ranked = F.expr("if(contains(instruction_xml, '<pitch'), cast(null as array<int>), cast(array() as array<int>))")
    return {f"{side}_found": span_statistics(f"{side}_units", f"{side}_duration", ranked, f"{side}_track") for side in SIDES}


def with_f0_maps(timed: DataFrame) -> DataFrame:
    """Add maps from ordinal to statistics, per side: spreads of voiced units, medians of pitched ones."""
    return _maps(with_unit_statistics(timed))


def _maps(df: DataFrame) -> DataFrame:
    entries = lambda side, known, value: F.expr(
        f"map_from_entries(transform(filter({side}_stats, y -> y.x.{known} is not null), y -> struct(y.ord, {value})))"
    )
    spread = "named_struct('lo', y.x.lo, 'hi', y.x.hi, 'mean', y.x.mean)"
    maps = {f"{side}_f0": entries(side, "mean", spread) for side in SIDES}
    medians = {f"{side}_median": entries(side, "median", "y.x.median") for side in SIDES}
    return df.withColumns({**maps, **medians}).drop(*[f"{side}_stats" for side in SIDES])


def unit_rows(timed: DataFrame, every_median: bool = False) -> DataFrame:
    """Rows (case_id, side, ord, statistics) of the spans that hold a frame."""
    sides = F.create_map(*[c for side in SIDES for c in (F.lit(side), F.col(f"{side}_stats"))])
    rows = with_unit_statistics(timed, every_median).select("case_id", F.explode(sides).alias("side", "stats"))
    return rows.select("case_id", "side", F.explode("stats").alias("u")).select("case_id", "side", "u.ord", "u.x.*")


def recorded_stats(timed: DataFrame) -> DataFrame:
    """``span_stats`` of recordings whose tracks are in their rows."""
    return unit_rows(timed, every_median=True).select(
        "case_id",
        "side",
        "ord",
        F.col("lo").alias("min_f0_hz"),
        F.col("hi").alias("max_f0_hz"),
        F.col("median").alias("median_f0_hz"),
        F.col("mean").alias("mean_f0_hz"),
        (F.col("num_voiced") / F.col("num_frames")).alias("voiced_fraction"),
        "num_frames",
        F.col("num_voiced").alias("num_voiced_frames"),
    )


def frames_in_spans(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Pair frames with the spans that hold their centre.

    The equi key carries a time bucket, so one long recording is spread over
    tasks, and a span is copied only to the buckets it touches.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET_SECONDS).cast("int")
    low = F.floor((F.col("start") - SLACK) / BUCKET_SECONDS).cast("int")
    high = F.floor((F.col("end") + SLACK) / BUCKET_SECONDS).cast("int")
    cut = spans.withColumn("bucket", F.explode(F.sequence(low, high)))
    placed = frames.withColumn("bucket", bucket("t"))
    t = F.col("t")
    inside = (t >= F.col("start") - SLACK) & F.when(F.col("closed"), t <= F.col("end") + SLACK).otherwise(
        t < F.col("end") - SLACK
    )
    # Both sides come out of explodes, whose size Spark guesses too low, so nothing
    # is broadcast. The spans are the build side: a partition holds several frames
    # for each of its spans, and the bucket in the key keeps partitions even.
    return placed.join(cut.hint("shuffle_hash"), ["case_id", "side", "bucket"]).filter(inside)


def _voiced() -> Column:
    return F.when(F.col("hz") > 0, F.col("hz"))


def span_stats(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Voiced statistics per span; null where no frame is voiced."""
    voiced = _voiced()
    return (
        frames_in_spans(frames, spans)
        .groupBy("case_id", "side", "ord")
        .agg(
            F.min(voiced).alias("min_f0_hz"),
            F.max(voiced).alias("max_f0_hz"),
            F.median(voiced).alias("median_f0_hz"),
            F.avg(voiced).alias("mean_f0_hz"),
            (F.count(voiced) / F.count(F.lit(1))).alias("voiced_fraction"),
            F.count(F.lit(1)).cast("int").alias("num_frames"),
            F.count(voiced).cast("int").alias("num_voiced_frames"),
        )
    )
