"""Pooled summaries over evaluation rows.

Everything is sums of sufficient statistics, so Spark combines them map-side
and shuffles at most one row per group and task. What a case contributes is
summed inside its row first; nothing is exploded for the case-level figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.session import exploded

COUNTS = ("substitutions", "deletions", "insertions", "hits", "ref_length", "hyp_length")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def pooled_error(struct: str) -> Column:
    """Errors over reference units of the pool; null without reference units."""
    s = lambda f: F.sum(F.col(f"{struct}.{f}"))
    return F.when(s("ref_length") > 0, (s("substitutions") + s("deletions") + s("insertions")) / s("ref_length"))


def pooled_error_rate(df: DataFrame, struct: str, *keys: str) -> DataFrame:
    """Pooled counts, rate and metric name per group."""
    s = [F.sum(f"{struct}.{c}").alias(c) for c in COUNTS]
    return df.groupBy(*keys).agg(
        *s, pooled_error(struct).alias("error_rate"), metric_label(f"{struct}.metric").alias("metric"), F.count(F.lit(1)).alias("count")
    )


def metric_label(metric: str) -> Column:
    """One name if all agree, else mixed; unknown when there is none."""
    m = F.when(F.length(metric) > 0, F.col(metric))
    return F.when(F.min(m).isNull(), "unknown").when(F.min(m) == F.max(m), F.min(m)).otherwise("mixed")


def pooled_ratio(df: DataFrame, struct: str, scale: float, *keys: str) -> DataFrame:
    d, n = F.sum(f"{struct}.distance"), F.sum(f"{struct}.normalizer")
    return df.groupBy(*keys).agg((scale * ratio(d, n)).alias("value"), d.alias("distance"), n.alias("normalizer"))


def strict_mean(column: str) -> Column:
    """Mean that fails on a missing or non-finite input; null over no rows."""
    c = F.col(column)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(F.count_if(bad) > 0, F.raise_error(F.lit(f"missing or non-finite {column}")).cast("double")).otherwise(F.avg(c))


def explode_components(evaluation: DataFrame, *keep: str) -> DataFrame:
    return exploded(evaluation, "components", "c", "case_id", *keep).select("case_id", *keep, "c.*")


def component_rates(evaluation: DataFrame) -> DataFrame:
    """Execution and success rates per category and family, and per category and operation."""
    parts = explode_components(evaluation, "category")
    sets = [[F.col("category"), F.col("family")], [F.col("category"), F.col("operation")]]
    grouped = parts.groupingSets(sets, F.col("category"), F.col("family"), F.col("operation"))
    return grouped.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.col("executed").cast("int")).alias("execution_rate"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
    ).select(
        "category",
        F.when(F.col("family").isNotNull(), "family").otherwise("operation").alias("dimension"),
        F.coalesce("family", "operation").alias("name"),
        "count",
        "execution_rate",
        "success_rate",
    )


def with_case_sums(evaluation: DataFrame) -> DataFrame:
    """What a case adds to the component figures."""
    size = lambda cond: F.expr(f"size(filter(components, c -> {cond}))")
    total = lambda field, op: F.expr(
        f"aggregate(filter(components, c -> c.operation = '{op}' and c.measurement.{field} is not null), 0D, (a, c) -> a + c.measurement.{field})"
    )
    return evaluation.withColumns(
        {
            "n_ops": F.size("components"),
            "n_executed": size("c.executed"),
            "n_success": size("c.success"),
            "all_executed": F.expr("int(forall(components, c -> c.executed))"),
            "all_success": F.expr("int(forall(components, c -> c.success))"),
            "n_correct": size("c.measurement.correct"),
            "n_rate": size("c.operation = 'rate'"),
            "rate_l1": total("rate_l1", "rate"),
            "n_pitch": size("c.operation = 'pitch' and c.measurement.pitch_l1 is not null"),
            "pitch_l1": total("pitch_l1", "pitch"),
        }
    )


def unmeasured_pitch(evaluation: DataFrame) -> DataFrame:
    """Pitch operations that have no pitch distance (a source without F0); they count in no mean."""
    parts = exploded(evaluation, "components", "c", "case_id").filter("c.operation = 'pitch' and c.measurement.pitch_l1 is null")
    return parts.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def outcome_rates() -> list[Column]:
    return [
        ratio(F.sum("n_executed"), F.sum("n_ops")).alias("component_execution_rate"),
        ratio(F.sum("n_success"), F.sum("n_ops")).alias("component_success_rate"),
        F.avg("all_executed").alias("all_component_execution_rate"),
        F.avg("all_success").alias("all_component_success_rate"),
    ]


def category_metrics() -> list[Column]:
    """Figures that only one category reports; null for the others."""
    only = lambda name, value: F.when(F.col("category") == name, value)
    return [
        only("text", 100 * pooled_error("edit_region")).alias("edit_region_wer"),
        only("text", 100 * pooled_error("non_edit_region")).alias("non_edit_region_wer"),
        only("emotion", 100 * ratio(F.sum("n_success"), F.sum("n_ops"))).alias("emotion_accuracy"),
        only("pause", 100 * ratio(F.sum("n_correct"), F.sum("n_ops"))).alias("direction_accuracy"),
        ratio(F.sum("rate_l1"), F.sum("n_rate")).alias("duration_l1_sec"),
        ratio(F.sum("pitch_l1"), F.sum("n_pitch")).alias("pitch_l1_semitones"),
    ]


def group_measures() -> list[Column]:
    d = lambda s, f: F.sum(f"{s}.{f}")
    return [
        F.count(F.lit(1)).alias("count"),
        (100 * pooled_error("wer")).alias("asr_error"),
        strict_mean("similarity").alias("speaker_similarity"),
        strict_mean("utmos").alias("utmos"),
        (100 * ratio(d("wdtw_dur", "distance"), d("wdtw_dur", "normalizer"))).alias("wdtw_dur"),
        ratio(d("wdtw_f0", "distance"), d("wdtw_f0", "normalizer")).alias("wdtw_f0"),
        *outcome_rates(),
    ]


def summarize(evaluation: DataFrame) -> DataFrame:
    """All measures per category, and per category and shard (level 'shard')."""
    rows = with_case_sums(evaluation).withColumn("shard", F.coalesce("shard", F.lit("selected")))
    c, s = F.col("category"), F.col("shard")
    measures = rows.groupingSets([[c], [c, s]], c, s).agg(
        F.grouping("shard").alias("pooled"), *group_measures(), *category_metrics()
    )
    return measures.withColumn("level", F.when(F.col("pooled") == 1, "category").otherwise("shard")).drop("pooled")


def totals(evaluation: DataFrame) -> DataFrame:
    return evaluation.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("penalty_applied").alias("penalized")
    )


def generation_counts(generation: DataFrame) -> DataFrame:
    return generation.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") == "ok").alias("generated"),
        F.count_if(F.col("status") == "candidate_error").alias("failed"),
    )


def compare_systems(evaluation: DataFrame) -> DataFrame:
    """Pooled measures per system and mode, then the plain mean of a system's modes."""
    d = lambda s, f: F.sum(f"{s}.{f}")
    by_mode = (
        with_case_sums(evaluation)
        .groupBy("system", "mode")
        .agg(
            ratio(F.sum("n_success"), F.sum("n_ops")).alias("operation_success"),
            F.avg("all_success").alias("all_success"),
            strict_mean("similarity").alias("similarity"),
            (100 * ratio(d("wdtw_dur", "distance"), d("wdtw_dur", "normalizer"))).alias("wdtw_dur"),
            ratio(d("wdtw_f0", "distance"), d("wdtw_f0", "normalizer")).alias("wdtw_f0"),
        )
    )
    names = ("operation_success", "all_success", "similarity", "wdtw_dur", "wdtw_f0")
    return by_mode.groupBy("system").agg(F.count(F.lit(1)).alias("modes"), *[F.avg(n).alias(n) for n in names])
