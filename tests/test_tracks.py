import pytest
from pyspark.sql import functions as F

from editlens import fixtures
from editlens.operators import frames
from editlens.plans import evaluation_queries as plans

SF = "/root/testdata/sf0.001"


def timed(spark, units, track, duration):
    unit = "named_struct('word', 'w', 'a', {i}, 'b', {i} + 1, 'pre', false, 'post', false, 't0', {a}D, 't1', {b}D)"
    array = "array(" + ", ".join(unit.format(i=i, a=a, b=b) for i, (a, b) in enumerate(units)) + ")"
    frame = "array(" + ", ".join(f"named_struct('t', {t}D, 'hz', {hz}D)" for t, hz in track) + ")"
    ops = "array(named_struct('kind', 'pitch', 'src_start', 0, 'src_end', 1, 'tgt_start', 0, 'tgt_end', 1))"
    return spark.range(1).select(
        F.lit("c").alias("case_id"), F.expr(f"named_struct('ops', {ops})").alias("parsed"), F.expr(array).alias("s"), F.expr(array).alias("t"),
        F.lit(duration).alias("source_duration"), F.lit(0.0).alias("target_duration"), F.expr(frame).alias("source_track"), F.expr(frame).alias("target_track"),
    )


def test_ends_of_spans_and_tracks_in_any_order(spark):
    track = [(0.5, 90.0), (0.0, 100.0), (0.25, 0.0), (0.1, 140.0), (1.0, 120.0), (1.5, 60.0)]
    df = timed(spark, [(0.0, 0.5), (0.5, 1.0), (0.3, 0.3), (0.6, 0.9)], track, 1.0)
    got = {r.ord: r for r in frames.recorded_stats(df).collect()}
    assert set(got) == {0, 1}
    first, last = got[0], got[1]
    assert (first.num_frames, first.num_voiced_frames, first.median_f0_hz, first.mean_f0_hz) == (3, 2, 120.0, 120.0)
    assert (last.num_frames, last.min_f0_hz, last.max_f0_hz) == (2, 90.0, 120.0)
    maps = frames.with_f0_maps(df).first()
    assert maps.source_median == {0: 120.0} and set(maps.source_f0) == {0, 1} and maps.target_f0 == {}


def test_equal_to_the_range_join(spark):
    cases = plans.recorded(spark, SF)
    loose = frames.span_stats(fixtures.frames(spark, SF), frames.unit_intervals(plans.timed(spark, SF)))
    a, b = ({(r.case_id, r.side, r.ord): r for r in df.collect()} for df in (frames.recorded_stats(cases), loose))
    assert a.keys() == b.keys() and len(a) > 1000
    for key, row in a.items():
        assert list(row) == pytest.approx(list(b[key]), nan_ok=True)


@pytest.mark.parametrize("query", ["a10_span_stats", "k05_f0_preservation", "a18_compare_systems"])
def test_frames_are_not_shuffled(spark, query):
    """One exchange deals the documents out, aggregates add theirs; none carries frames."""
    plan = getattr(plans, query)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
