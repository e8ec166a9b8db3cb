"""Measurements of whole batches give what the expressions over one row give."""

import pytest
from pyspark.sql import functions as F

from editlens import fixtures
from editlens.operators import cases as case_ops
from editlens.operators import errors, frames, measure, score
from editlens.plans import evaluation_queries as plans

SF = "/root/testdata/sf0.001"
XMLS = [
    "it<pause act=\"ins\"/>'s a b", "ab<emo type=\"sad\">cd</emo> ef", "don<del>'</del>t go", 'a <pitch semitones="2">b c</pitch> d', "-x <sub targ=\"y z\">w</sub>-v",
    '<rate factor="2">a-b</rate>', "<ins>new</ins>", '漢<pitch semitones="-1">字ab</pitch>c', 'a<rate factor="0.5"> b</rate> c <del>d</del>',
]


def odd_cases(spark, moved):
    """Texts with connectors and split units; one unit more or less than the text has where ``moved``."""
    rows = []
    for i, xml in enumerate(XMLS):
        units = [("w" + str(k), k * 0.25, k * 0.25 + 0.05 * ((i + k) % 4)) for k in range(5 + moved)]
        rows.append((f"c{i}", xml, units, [(w, s + 0.01, e if k % 3 else s) for k, (w, s, e) in enumerate(units)], 1.2, 1.0))
    unit = "array<struct<word: string, start: double, end: double>>"
    df = spark.createDataFrame(rows, f"case_id string, instruction_xml string, source_units {unit}, target_units {unit}, source_duration double, target_duration double")
    track = "transform(sequence(0, 40), k -> named_struct('t', k * 0.03D, 'hz', if(k % {m} = 0, 0D, 100D + k * {m})))"
    return df.withColumns({"source_track": F.expr(track.format(m=4)), "target_track": F.expr(track.format(m=7))})


def by_row(cases):
    """The expressions over the arrays of a row."""
    read = case_ops.with_timed_units(case_ops.accepted(case_ops.read_instructions(cases))).withColumn("whole", case_ops.is_whole_utterance())
    timed = score.with_operation_times(measure.with_preserved(frames.with_f0_maps(read)))
    return measure.with_duration_preservation(timed).withColumn("wdtw_f0", measure.f0_preservation()).withColumn(
        "pitches", F.expr(f"transform(timed_ops, x -> if(x.kind = 'pitch', {measure.pitch('x.pairs', '1D')}, null))")
    )


def by_batch(cases):
    read = case_ops.accepted(case_ops.read_instructions(cases, **frames.track_statistics())).withColumn("whole", case_ops.is_whole_utterance())
    return measure.with_measures(read).withColumn(
        "pitches", F.expr(f"transform(timed_ops, x -> if(x.kind = 'pitch', {measure.pitch_value('x.m', '1D')}, null))")
    )


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


@pytest.mark.parametrize("moved", [0, 1, -2, None])
def test_same_as_by_row(spark, moved):
    cases = fixtures.with_tracks(score.penalise(fixtures.cases(spark, SF))) if moved is None else odd_cases(spark, moved)
    names = ("source", "target", "valid")
    old = by_row(cases).select("case_id", "wdtw_dur", "wdtw_f0", "pitches", *[F.expr(f"transform(timed_ops, x -> x.{n})").alias(n) for n in names])
    new = by_batch(cases).select("case_id", "wdtw_dur", "wdtw_f0", "pitches", *[F.expr(f"transform(timed_ops, x -> x.m.{n})").alias(n) for n in names])
    a, b = ({r.case_id: r for r in df.collect()} for df in (old, new))
    assert a.keys() == b.keys() and len(a) > 5
    for key, row in a.items():
        assert close(tuple(row), tuple(b[key])), (row, b[key])


def test_local_counts_are_those_of_the_regions(spark):
    cases = plans.heard(spark, SF)
    made = errors.with_local_errors(cases, "heard", composed="heard_composed").select("case_id", "heard", "parsed", "local_errors")
    rows = errors.with_error_counts(made, "parsed.target_text", "heard", F.lit("mixed"))
    path = "transform(wer_counts.path, (x, i) -> named_struct('p', i, 'op', x.op, 'ins', x.ins))"
    near = "{p} >= o.lo - 3 and {p} < o.hi + 3"
    covered = f"exists(local_errors.bounds, o -> o.text and {near})"
    again = rows.select(
        "case_id", "local_errors", F.expr(errors.region_counts(path, covered)).alias("edit"), F.expr(errors.region_counts(path, f"not {covered}")).alias("other"),
        F.expr(f"transform(local_errors.bounds, o -> if(o.text, {errors.region_counts(path, near)}, null))").alias("ops"),
    )
    found = again.collect()
    assert len(found) > 1000
    for r in found:
        assert (r.edit, r.other, r.ops) == (r.local_errors.edit, r.local_errors.other, r.local_errors.ops)


def test_units_are_measured_by_batch(spark):
    plan = plans.k13_success(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "array_except" not in plan


def test_tracks_are_slices_of_fixed_lists(spark):
    """Every frame as in ``frames``, also of ids that are negative or missing."""
    base = spark.range(-700, 700).selectExpr("if(id % 50 = 3, null, id * 37) as uid", "cast(1 + abs(id) % 14 as int) as n")
    track = "transform(sequence(0, ({n}) * 5 - 1), k -> named_struct('t', k * 5 / 100D, 'hz', cast(if((uid + k div 25) % {m} = 0, 0, 100 + (uid * {f} + k * {s}) % 120) as double)))"
    both = fixtures.with_tracks(base).withColumns({"a": F.expr(track.format(n="n", m=6, f=7, s=3)), "b": F.expr(track.format(n="n + 3", m=7, f=11, s=5))})
    assert both.filter("not (source_track <=> a) or not (target_track <=> b)").count() == 0
    assert "slice(" in fixtures.with_tracks(base)._jdf.queryExecution().optimizedPlan().toString()
