"""Measurements of one case: durations, pitch, rate, pause, emotion, preservation.

All are expressions over the arrays of the case row; only the warping distance
is a Python kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.functions.sequences import warp_distance
from editlens.functions.unit_measures import MISSING_F0_SEMITONES, duration_warp, f0_errors as f0_error_sums, operation_measures
from editlens.functions.units import anchors_valid, interval, operation_pairs, preserved_pairs, resolve

# Fixed values of the scoring protocol.
PAUSE_CHANGE, PAUSE_TOLERANCE = 0.16, 1e-6
CROP_PADDING = 0.25


def with_preserved(df: DataFrame) -> DataFrame:
    """Add kept unit pairs for durations (``kept_dur``) and for F0 (``kept_f0``)."""
    pairs = lambda scope: F.expr(
        resolve(preserved_pairs("parsed.regions", "parsed.ops", "s", "t", scope), "s", "t")
    )
    both = df.withColumns({"kept_dur": pairs("pitch"), "kept_f0": pairs("rate")})
    long = lambda c: F.filter(c, lambda p: p["s1"] > p["s0"])
    return both.withColumns({"kept_dur": long("kept_dur"), "kept_f0": long("kept_f0")})


def length(start: str, end: str) -> str:
    return f"greatest(0D, {end} - {start})"


def duration_value(distance: str, norm: str) -> str:
    return f"""named_struct('value', if({norm} > 0, {distance} / {norm}, null),
        'distance', if({norm} > 0, {distance}, 0D), 'normalizer', {norm},
        'status', if({norm} > 0, 'ok', 'no_segments'))"""


def with_duration_preservation(df: DataFrame, pairs: str = "kept_dur") -> DataFrame:
    """Add ``wdtw_dur``: warping distance over the summed lengths."""
    arrays = df.withColumns(
        {
            "_sw": F.expr(f"transform({pairs}, p -> p.sw)"),
            "_sd": F.expr(f"transform({pairs}, p -> {length('p.s0', 'p.s1')})"),
            "_tw": F.expr(f"transform({pairs}, p -> p.tw)"),
            "_td": F.expr(f"transform({pairs}, p -> {length('p.t0', 'p.t1')})"),
        }
    ).withColumn("_distance", warp_distance("_sw", "_sd", "_tw", "_td"))
    total = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x)"
    summed = arrays.withColumn("_norm", F.expr(f"{total('_sd')} + {total('_td')}"))
    return summed.withColumn("wdtw_dur", F.expr(duration_value("_distance", "_norm"))).drop("_sw", "_sd", "_tw", "_td", "_distance", "_norm")


def f0_errors(pairs: str, source_f0: str = "source_f0", target_f0: str = "target_f0") -> str:
    """Semitone error per source-voiced pair; a missing target costs the fixed penalty."""
    ratio = lambda f: f"abs(12D * log2(x.t.{f} / x.s.{f}))"
    return f"""transform(filter(transform({pairs}, p -> named_struct('s', {source_f0}[p.i],
            't', if(p.t1 > p.t0, {target_f0}[p.j], null))), x -> x.s is not null),
        x -> named_struct('missing', x.t is null, 'error', if(x.t is null, {MISSING_F0_SEMITONES}D,
            ({ratio('lo')} + {ratio('hi')} + {ratio('mean')}) / 3)))"""


def f0_preservation(pairs: str = "kept_f0") -> Column:
    """``wdtw_f0`` from the kept pairs and the two statistics maps."""
    return F.expr(
        f"""transform(array({f0_errors(pairs)}), e -> transform(array(named_struct(
            'd', aggregate(e, 0D, (a, x) -> a + x.error), 'n', double(size(e)), 'missing', exists(e, x -> x.missing),
            'none', size({pairs}) = 0)), v -> {f0_value('v')})[0])[0]"""
    )


def f0_value(v: str) -> str:
    return f"""named_struct(
            'value', if({v}.n > 0, {v}.d / {v}.n, null), 'distance', {v}.d, 'normalizer', {v}.n,
            'status', case when {v}.none then 'no_preserved_words' when {v}.missing then 'penalized_missing_target_f0'
              when {v}.n > 0 then 'ok' else 'no_valid_f0' end)"""


def with_measures(df: DataFrame) -> DataFrame:
    """Add ``wdtw_dur``, ``wdtw_f0`` and ``timed_ops`` from the units of both sides and the statistics of their tracks.

    Gives what ``with_preserved``, ``with_duration_preservation``, ``f0_preservation`` and the intervals, anchors and
    pairs of ``operation_times`` give, in one pass over the arrays of a batch. ``timed_ops`` has the sums over an
    operation's unit pairs that ``pitch_value`` and ``rate`` need. Needs ``parsed``, the units, the statistics of
    ``frames.track_statistics`` and ``whole``.
    """
    units = ("parsed.source_spans", "parsed.target_spans", "source_units", "target_units")
    found = ("source_found", "target_found")
    both = ("parsed.ops", "parsed.regions", *units)
    made = df.withColumns(
        {
            "_warp": duration_warp(*both),
            "_f0": f0_error_sums(*both, *found),
            "_times": operation_measures("parsed.ops", *units, *found, "source_duration", "target_duration", "whole"),
        }
    )
    ops = "transform(parsed.ops, (o, i) -> named_struct('i', i, 'kind', o.kind, 'param', o.param, 'm', get(_times, i)))"
    return made.withColumns(
        {"wdtw_dur": F.expr(duration_value("_warp.distance", "_warp.normalizer")), "wdtw_f0": F.expr(f0_value("_f0")), "timed_ops": F.expr(ops)}
    ).drop("_warp", "_f0", "_times")


def pitch(pairs: str, requested: str, source_f0: str = "source_median", target_f0: str = "target_median") -> str:
    """Mean shift over source-voiced units; an unvoiced target counts as no shift."""
    return f"""transform(array(transform(filter(transform({pairs}, p -> named_struct(
              's', if(p.s1 > p.s0, {source_f0}[p.i], null), 't', if(p.t1 > p.t0, {target_f0}[p.j], null))),
            x -> x.s is not null), x -> named_struct('shift', coalesce(12D * log2(x.t / x.s), 0D), 'ok', x.t is not null))),
        e -> transform(array(aggregate(e, 0D, (a, x) -> a + x.shift, a -> try_divide(a, size(e)))), m -> named_struct(
            'status', case when size(e) = 0 then 'no_source_f0' when forall(e, x -> x.ok) then 'ok' else 'missing_target' end,
            'shift', m, 'l1', abs(m - {requested})))[0])[0]"""


def pitch_value(m: str, requested: str) -> str:
    """``pitch`` from the sums over an operation's units."""
    return f"""named_struct(
            'status', case when {m}.voiced = 0 then 'no_source_f0' when {m}.heard then 'ok' else 'missing_target' end,
            'shift', {m}.shift, 'l1', abs({m}.shift - {requested}))"""


def rate(m: str, factor: str) -> str:
    """Length ratio and distance to the requested length, in seconds."""
    ds, dt = length(f"{m}.source.start", f"{m}.source.end"), length(f"{m}.target.start", f"{m}.target.end")
    return f"""named_struct(
        'status', case when {ds} <= 0 or not {m}.long then 'empty_source'
          when {dt} > 0 and {m}.kept then 'ok' else 'missing_target' end,
        'ratio', try_divide({dt}, {ds}), 'l1', abs({dt} - {ds} / {factor}))"""


def pause_correct(act: str, source_gap: str, target_gap: str) -> str:
    """A pause grew or shrank by the threshold; null gaps are not correct."""
    return f"""coalesce(case {act} when 'ins' then {target_gap} >= {source_gap} + {PAUSE_CHANGE}D - {PAUSE_TOLERANCE}D
        when 'red' then {target_gap} <= {source_gap} - {PAUSE_CHANGE}D + {PAUSE_TOLERANCE}D else false end, false)"""


def pause(act: str, source: str, target: str, valid: str) -> str:
    gap = lambda x: length(f"{x}.start", f"{x}.end")
    return f"""transform(array(named_struct('s', {gap(source)}, 't', if({valid}, {gap(target)}, null))), g -> named_struct(
        'status', if({valid}, 'ok', 'missing_target'), 'source_gap', g.s, 'target_gap', g.t,
        'delta', coalesce(g.t - g.s, 0D), 'correct', {pause_correct(act, 'g.s', 'g.t')}))[0]"""


def crop_window(start: str, end: str, duration: str, whole: str) -> str:
    """Interval a label is judged on: the whole recording, or the span and its padding."""
    return f"""if({whole}, named_struct('start', 0D, 'end', {duration}), named_struct(
        'start', greatest(0D, {start} - {CROP_PADDING}D), 'end', least({duration}, {end} + {CROP_PADDING}D)))"""


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors; null where one has no length."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> double(p) * double(q)), 0D, (s, v) -> s + v)"
    return F.expr(f"try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))")


def operation_times(op: str = "o") -> dict[str, str]:
    """Source and target interval of an operation over the arrays of its case."""
    return {
        "source": interval("s", f"{op}.src_start", f"{op}.src_end", "source_duration"),
        "target": interval("t", f"{op}.tgt_start", f"{op}.tgt_end", "target_duration"),
        "valid": anchors_valid("t", f"{op}.tgt_start"),
        "pairs": resolve(operation_pairs("s", "t", op), "s", "t"),
    }
