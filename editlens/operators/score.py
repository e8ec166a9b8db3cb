"""From measurements to execution and success, and the evaluation row of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens.functions.text import er_metric, nfkc
from editlens.operators import cases as case_ops
from editlens.operators import errors, frames, measure
from editlens.session import short_batches

# Fixed values of the scoring protocol.
MIN_PITCH = 1.0
MIN_DURATION_CHANGE = 0.1
MIN_FRACTION, MAX_FRACTION = 0.6, 1.6
EPSILON = 1e-9
STATUSES = ("ok", "penalized_generation_failed")


def change_fraction(kind: str, param: str, status: str, shift: str, ratio: str) -> str:
    """Achieved over requested change; null when missing, impossible or nothing was asked."""
    number = f"try_cast({param} as double)"
    return f"""case when {status} <=> 'missing_target' then null
        when {kind} = 'pitch' then try_divide({shift}, {number})
        when {kind} = 'rate' and {ratio} > 0 then try_divide(try_divide(1D, {ratio}) - 1D, {number} - 1D) end"""


def executed(kind: str, param: str, m: str, fraction: str, local_rate: str) -> str:
    """The requested change is perceptible in the requested direction."""
    number = f"try_cast({param} as double)"
    return f"""coalesce(case when {m}.status <=> 'missing_target' then false
        when {kind} in ('ins', 'del', 'sub') then {local_rate} = 0D
        when {kind} = 'emo' then {m}.predicted = {param}
        when {kind} = 'pause' then {m}.correct
        when {fraction} is null then false
        when {fraction} >= {MIN_FRACTION}D - {EPSILON}D then true
        when {kind} = 'pitch' then if({number} > 0, {m}.shift + {EPSILON}D >= {MIN_PITCH}D, {m}.shift - {EPSILON}D <= -{MIN_PITCH}D)
        else if({number} > 1D, {m}.ratio <= 1D - {MIN_DURATION_CHANGE}D + {EPSILON}D,
          {m}.ratio >= 1D + {MIN_DURATION_CHANGE}D - {EPSILON}D) end, false)"""


def success(kind: str, fraction: str, done: str) -> str:
    """Execution, and for prosody a change close enough to the request."""
    return f"""if({kind} in ('pitch', 'rate'), coalesce({fraction} >= {MIN_FRACTION}D - {EPSILON}D
        and {fraction} <= {MAX_FRACTION}D + {EPSILON}D, false), {done})"""


def penalise(df: DataFrame) -> DataFrame:
    """Replace the outputs of failed generations by silence of no length.

    Everything measured on them then comes out as the full penalty, so failed
    and finished cases share one branch of the plan.
    """
    failed = F.col("status") == "candidate_error"
    silent = F.expr("transform(target_units, u -> named_struct('word', u.word, 'start', 0D, 'end', 0D))")
    return df.withColumns(
        {
            "penalty_applied": failed,
            "heard": F.when(failed, F.lit("")).otherwise(F.col("heard")),
            "target_units": F.when(failed, silent).otherwise(F.col("target_units")),
            "target_duration": F.when(failed, F.lit(0.0)).otherwise(F.col("target_duration")),
            "similarity": F.when(failed, F.lit(0.0)).otherwise(F.col("similarity")),
            "utmos": F.when(failed, F.lit(1.0)).otherwise(F.col("utmos")),
        }
    )


def with_operation_times(df: DataFrame) -> DataFrame:
    """Add ``timed_ops``: each operation with its intervals, anchors and unit pairs."""
    t = measure.operation_times()
    acoustic = "o.kind in ('pitch', 'rate')"
    return df.withColumn(
        "timed_ops",
        F.expr(
            f"""transform(parsed.ops, (o, i) -> named_struct('i', i, 'kind', o.kind, 'param', o.param,
              'source', if(o.kind in ('ins', 'del', 'sub'), null, {t['source']}),
              'target', if(o.kind in ('ins', 'del', 'sub'), null, if(whole, named_struct('start', 0D, 'end', target_duration), {t['target']})),
              'valid', o.kind = 'pause' and {t['valid']},
              'pairs', if({acoustic}, {t['pairs']}, null)))"""
        ),
    )


def with_components(df: DataFrame) -> DataFrame:
    """Add ``components``: measurement, execution and success per operation.

    Needs ``timed_ops`` of ``measure.with_measures``, ``local_errors`` and
    ``labels`` (operation index to predicted label).
    """
    number = "try_cast(x.param as double)"
    measured = df.withColumn(
        "measured",
        F.expr(
            f"""transform(timed_ops, x -> named_struct('x', x,
              'pitch', if(x.kind = 'pitch', {measure.pitch_value('x.m', number)}, null),
              'rate', if(x.kind = 'rate', {measure.rate('x.m', number)}, null),
              'pause', if(x.kind = 'pause', {measure.pause('x.param', 'x.m.source', 'x.m.target', 'x.m.valid')}, null),
              'empty', x.kind = 'emo' and coalesce(x.m.target.end <= x.m.target.start, true)))"""
        ),
    ).withColumn(
        "measured",
        F.expr(
            """transform(measured, y -> named_struct('i', y.x.i, 'kind', y.x.kind, 'param', y.x.param, 'm', named_struct(
              'status', coalesce(y.pitch.status, y.rate.status, y.pause.status, if(y.empty, 'empty_target', null)),
              'shift', y.pitch.shift, 'pitch_l1', y.pitch.l1, 'ratio', y.rate.ratio, 'rate_l1', y.rate.l1,
              'source_gap', y.pause.source_gap, 'target_gap', y.pause.target_gap, 'delta', y.pause.delta,
              'correct', y.pause.correct, 'predicted', if(y.kind = 'emo' and not y.empty, labels[y.x.i], null))))""".replace(
                "y.kind", "y.x.kind"
            )
        ),
    )
    fraction = change_fraction("z.kind", "z.param", "z.m.status", "z.m.shift", "z.m.ratio")
    scored = measured.withColumn(
        "measured", F.expr(f"transform(measured, z -> named_struct('z', z, 'fraction', {fraction}))")
    ).withColumn(
        "measured",
        F.expr(
            f"""transform(measured, w -> named_struct('z', w.z, 'fraction', w.fraction, 'executed', not penalty_applied and
              {executed('w.z.kind', 'w.z.param', 'w.z.m', 'w.fraction', 'get(local_errors.ops, w.z.i).error_rate')}))"""
        ),
    )
    final = f"""transform(measured, v -> named_struct('op_index', v.z.i,
        'family', case when v.z.kind in ('ins', 'del', 'sub') then 'text' when v.z.kind = 'emo' then 'emotion'
          when v.z.kind in ('pitch', 'rate') then 'prosody' else 'pause' end,
        'operation', case v.z.kind when 'ins' then 'insert' when 'del' then 'delete' when 'sub' then 'replace'
          when 'pause' then v.z.param else v.z.kind end,
        'param', v.z.param, 'measurement', v.z.m, 'fraction', v.fraction, 'executed', v.executed,
        'success', not penalty_applied and {success('v.z.kind', 'v.fraction', 'v.executed')}))"""
    return scored.withColumn("components", F.expr(final)).drop("measured")


EVALUATION_COLUMNS = (
    "case_id",
    "language",
    "category",
    "shard",
    "evaluation_status",
    "penalty_applied",
    "heard",
    "wer",
    "edit_region",
    "non_edit_region",
    "wdtw_dur",
    "wdtw_f0",
    "similarity",
    "utmos",
    "components",
)


def measured(cases: DataFrame) -> DataFrame:
    """Error counts, local errors, warping, intervals and F0 statistics, all where the cases are read."""
    short_batches(cases.sparkSession)
    first = {"heard_composed": nfkc("heard"), **frames.track_statistics()}
    read = case_ops.accepted(case_ops.read_instructions(penalise(cases), **first))
    declared = "category" if "category" in cases.columns else None
    named = read.withColumns({"category": case_ops.category(declared=declared), "whole": case_ops.is_whole_utterance()})
    counted = errors.with_errors(named, "heard", er_metric("category", "language"), composed="heard_composed")
    return measure.with_measures(counted)


def evaluate(cases: DataFrame) -> DataFrame:
    """The evaluation row of every case.

    ``cases`` carries instruction, units and tracks of both sides, recognised
    text, status, scores and labels in one row; nothing is shuffled.
    """
    scored = with_components(measured(cases))
    extra = [c for c in ("system", "mode") if c in cases.columns]
    status = F.when(F.col("penalty_applied"), STATUSES[1]).otherwise(STATUSES[0])
    regions = {"edit_region": F.col("local_errors.edit"), "non_edit_region": F.col("local_errors.other")}
    return scored.withColumns({"evaluation_status": status, **regions}).select(*EVALUATION_COLUMNS, *extra)
