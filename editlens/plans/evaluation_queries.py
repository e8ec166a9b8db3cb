"""Queries over the derived cases: units, joins, measurements, scores, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens import fixtures
from editlens.functions import text, units
from editlens.operators import aggregate, errors, frames, measure, score, sequence_checks
from editlens.operators import cases as case_ops
from editlens.session import exploded


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a precision that does not depend on the order of summation."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def read(spark: SparkSession, sf: str) -> DataFrame:
    return case_ops.accepted(case_ops.read_instructions(fixtures.cases(spark, sf)))


def timed(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with timed units, outputs of failed generations silenced."""
    cases = score.penalise(fixtures.cases(spark, sf))
    return case_ops.with_timed_units(case_ops.accepted(case_ops.read_instructions(cases)))


def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Timed cases with the tracks of both sides."""
    return fixtures.with_tracks(timed(spark, sf))


def with_labels(cases: DataFrame) -> DataFrame:
    """The predicted label of a case holds for each of its (at most two) operations."""
    return cases.withColumn("labels", F.create_map(F.lit(0), "predicted", F.lit(1), "predicted"))


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return score.evaluate(fixtures.with_tracks(with_labels(fixtures.cases(spark, sf))))


def component_rows(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.explode_components(evaluation(spark, sf))


# -- texts and operations


def p01_unit_spans(spark, sf):
    spans = F.explode(F.col("parsed.source_spans")).alias("u")
    rows = read(spark, sf).select("case_id", "parsed.source_text", spans)
    return rows.selectExpr(
        "case_id", "u.start as start", "u.end as end", "substring(source_text, u.start + 1, u.end - u.start) as unit"
    )


def p02_normalize_unit(spark, sf):
    docs = fixtures.documents(spark, sf)
    words = docs.select(F.explode(F.split("text", r"[ \n]+")).alias("w"))
    return words.select(text.normalize_unit("w").alias("unit")).filter("unit <> ''").groupBy("unit").agg(F.count("*").alias("n"))


def p03_normalize_er(spark, sf):
    return fixtures.documents(spark, sf).select("doc_id", text.text_sha(text.normalize_er("text")).alias("normal_sha256"))


def p04_mixed_tokens(spark, sf):
    tokens = text.mixed_tokens(text.normalize_er("text"))
    rows = fixtures.documents(spark, sf).select("doc_id", F.explode(tokens).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def p05_explode_instructions(spark, sf):
    return case_ops.explode_operations(read(spark, sf))


def p05_regions(spark, sf):
    return case_ops.explode_regions(read(spark, sf)).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("src_end").alias("src"), F.sum("tgt_end").alias("tgt")
    )


def p06_render_texts(spark, sf):
    return case_ops.texts(read(spark, sf))


def p07_replace_span(spark, sf):
    from editlens.functions.instructions import replace_span_text

    ops = case_ops.explode_operations(read(spark, sf), "parsed").filter(f"kind in {units.TEXT_KINDS}")
    new = F.expr("case kind when 'sub' then param when 'ins' then content else '' end")
    return ops.select(
        "case_id",
        "op_index",
        replace_span_text(F.col("parsed.source_text"), "src_start", "src_end", new).alias("changed"),
    )


def p08_quarantine(spark, sf):
    """Fragments with one fault each, by utterance; the rest stay valid."""
    cases = fixtures.cases(spark, sf)
    broken = """case uid % 6 when 0 then concat(instruction_xml, '<foo>x</foo>') when 1 then concat(instruction_xml, '<ins/>')
        when 2 then concat(instruction_xml, '<rate factor="0">x</rate>') when 3 then concat(instruction_xml, '<ins>x')
        when 4 then concat('<!-- -->', instruction_xml) else instruction_xml end"""
    bad = case_ops.quarantine(cases.withColumn("instruction_xml", F.expr(broken)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def p09_family(spark, sf):
    ops = case_ops.explode_operations(read(spark, sf))
    return ops.select("case_id", "op_index", case_ops.family("kind").alias("family"), case_ops.label("kind", "param").alias("operation"))


def p10_category(spark, sf):
    return read(spark, sf).select("case_id", case_ops.category().alias("category"))


def p11_edited_units(spark, sf):
    marks = units.marked("t", "o.tgt_start", "o.tgt_end")
    ops = timed(spark, sf).select("case_id", F.expr(f"explode(transform(parsed.ops, (o, i) -> named_struct('i', i, 'u', {marks})))").alias("m"))
    return ops.select("case_id", F.col("m.i").alias("op_index"), F.explode("m.u").alias("ord"))


def p12_preserved_pairs(spark, sf):
    kept = measure.with_preserved(timed(spark, sf))
    both = F.expr(
        """concat(transform(kept_dur, p -> named_struct('scope', 'duration', 'i', p.i, 'j', p.j)),
            transform(kept_f0, p -> named_struct('scope', 'f0', 'i', p.i, 'j', p.j)))"""
    )
    return exploded(kept, both, "p", "case_id").select("case_id", "p.*")


def p13_bounded_intervals(spark, sf):
    """Units clamped into a recording cut short by a tenth of a second at both sides."""
    moved = "transform(source_units, u -> named_struct('word', u.word, 'start', u.start - 0.1D, 'end', u.end + 0.1D))"
    cases = fixtures.cases(spark, sf).withColumn("moved", F.expr(moved))
    bounded = cases.select("case_id", F.posexplode(F.expr(units.bounded("moved", "source_duration"))).alias("ord", "u"))
    return rounded(bounded.select("case_id", "ord", "u.start", "u.end"))


def p14_crop_window(spark, sf):
    ops = f"""transform(filter(timed_ops, o -> o.kind = 'emo'), o -> named_struct('i', o.i, 'w',
        {measure.crop_window('o.target.start', 'o.target.end', 'target_duration', 'whole')}))"""
    rows = score.with_operation_times(timed(spark, sf).withColumn("whole", case_ops.is_whole_utterance()))
    return rounded(exploded(rows, F.expr(ops), "x", "case_id").selectExpr("case_id", "x.i as op_index", "x.w.start", "x.w.end"))


def p15_whole_utterance(spark, sf):
    return read(spark, sf).select("case_id", case_ops.is_whole_utterance().alias("whole"))


def p16_er_metric(spark, sf):
    cases = read(spark, sf).withColumn("category", case_ops.category())
    return cases.select("case_id", text.er_metric("category", "language").alias("metric"))


def p17_sequential_plan(spark, sf):
    return case_ops.sequential_plan(fixtures.cases(spark, sf)).drop("xml")


def p18_one_take_plan(spark, sf):
    return case_ops.one_take_plan(read(spark, sf)).select("case_id", "step", "source_text", "target_text", text.text_sha("xml").alias("xml_sha256"))


def p19_first_operation(spark, sf):
    first = case_ops.first_operation(read(spark, sf))
    return first.selectExpr("case_id", "first.i as first_op", "acoustic.i as acoustic_op", "composition")


def p29_text_edit_ledger(spark, sf):
    return case_ops.text_edit_ledger(read(spark, sf))


# -- times and pairs


def _timed_ops(spark, sf):
    return score.with_operation_times(timed(spark, sf).withColumn("whole", F.lit(False)))


def j03_pair_units(spark, sf):
    pairs = "flatten(transform(filter(timed_ops, o -> o.pairs is not null), o -> transform(o.pairs, p -> named_struct('op_index', o.i, 'i', p.i, 'j', p.j, 'same', p.sw = p.tw))))"
    return exploded(_timed_ops(spark, sf), F.expr(pairs), "p", "case_id").select("case_id", "p.*")


def j04_span_times(spark, sf):
    spans = F.expr("filter(timed_ops, o -> o.kind in ('emo', 'pitch', 'rate'))")
    rows = exploded(_timed_ops(spark, sf), spans, "o", "case_id")
    return rounded(rows.selectExpr("case_id", "o.i as op_index", "o.source.start", "o.source.end"))


def j05_point_gaps(spark, sf):
    rows = exploded(_timed_ops(spark, sf), F.expr("filter(timed_ops, o -> o.kind = 'pause')"), "o", "case_id")
    return rounded(
        rows.selectExpr(
            "case_id",
            "o.i as op_index",
            "greatest(0D, o.source.end - o.source.start) as source_gap",
            "greatest(0D, o.target.end - o.target.start) as target_gap",
            "o.valid",
        )
    )


def j06_frames_in_spans(spark, sf):
    units = frames.unit_rows(recorded(spark, sf))
    return rounded(units.groupBy("side", "ord").agg(F.sum("num_frames").alias("frames"), F.sum("total").alias("hz")), 3)


def j07_match_sequences(spark, sf):
    """Target words as aligned against those of the instruction; one in 23 is spelt otherwise."""
    noisy = "transform(target_units, (u, i) -> named_struct('word', if((uid + i) % 23 = 0, concat('x', u.word), u.word)))"
    cases = read(spark, sf).withColumn("heard_units", F.expr(noisy))
    expected = F.expr("transform(parsed.target_spans, p -> substring(parsed.target_text, p.start + 1, p.end - p.start))")
    return sequence_checks.mismatches(cases.withColumn("expected", expected), "expected", "heard_units")


def w01_monotone_violations(spark, sf):
    """Start times moved back by one unit at every 29th place."""
    segments = fixtures.cases(spark, sf).select("case_id", "uid", F.posexplode("source_units").alias("ord", "u"))
    moved = segments.selectExpr("case_id", "ord", "u.start - if((uid + ord) % 29 = 0, 0.5D, 0D) as start", "u.end")
    return rounded(sequence_checks.monotone_violations(moved, "case_id"))


# -- kernels


def heard(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted cases with what was recognised and its NFKC, read in one Python pass."""
    cases = score.penalise(fixtures.cases(spark, sf))
    return case_ops.accepted(case_ops.read_instructions(cases, heard_composed=text.nfkc("heard")))


def _counted(spark, sf):
    named = heard(spark, sf).withColumn("category", case_ops.category())
    metric = text.er_metric("category", "language")
    return errors.with_error_counts(named, "parsed.target_text", "heard", metric, ("parsed.composed", "heard_composed"))


def k01_error_counts(spark, sf):
    counted = _counted(spark, sf)
    return rounded(counted.select("case_id", "wer.*"))


def _local(spark, sf):
    return errors.with_local_errors(heard(spark, sf), "heard", composed="heard_composed")


def k02_region_errors(spark, sf):
    return rounded(_local(spark, sf).select("case_id", "local_errors.other.*"))


def k03_local_error_rate(spark, sf):
    rows = _local(spark, sf).select("case_id", F.posexplode_outer("local_errors.ops").alias("op_index", "e"))
    return rounded(rows.filter("e is not null").select("case_id", "op_index", "e.*"))


def k03_edit_region(spark, sf):
    return rounded(_local(spark, sf).select("case_id", "local_errors.edit.*"))


def k04_duration_dtw(spark, sf):
    """Warping of the two sides' units; one target word in 23 differs."""
    pairs = """transform(source_units, (u, i) -> named_struct('sw', u.word, 's0', u.start, 's1', u.end,
        'tw', if((uid + i) % 23 = 0, concat('x', u.word), u.word), 't0', i * 25 / 100D,
        't1', (i * 25 + if((uid * 5 + i) % 19 = 0, 0, 5 + (uid * 7 + i * 11) % 15)) / 100D))"""
    cases = fixtures.cases(spark, sf).withColumn("pairs", F.expr(pairs))
    return rounded(measure.with_duration_preservation(cases, "pairs").select("case_id", "wdtw_dur.*"))


def k05_f0_preservation(spark, sf):
    return rounded(evaluation(spark, sf).select("case_id", "wdtw_f0.*"))


def _measurements(spark, sf, operation, *fields):
    rows = component_rows(spark, sf).filter(operation)
    return rounded(rows.select("case_id", "op_index", *[f"measurement.{f}" for f in fields]))


def k06_pitch_shift(spark, sf):
    return _measurements(spark, sf, "operation = 'pitch'", "status", "shift", "pitch_l1")


def k07_rate_measure(spark, sf):
    return _measurements(spark, sf, "operation = 'rate'", "status", "ratio", "rate_l1")


def k08_pause_measure(spark, sf):
    return _measurements(spark, sf, "family = 'pause'", "status", "source_gap", "target_gap", "delta", "correct")


def k09_emotion_outcome(spark, sf):
    return _measurements(spark, sf, "family = 'emotion'", "status", "predicted")


def k10_cosine_similarity(spark, sf):
    """Each vector against its successor, by equi join on the identifier."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    after = vectors.selectExpr("vec_id - 1 as vec_id", "embedding as other")
    return rounded(vectors.join(after, "vec_id").select("vec_id", measure.cosine("embedding", "other").alias("similarity")), 5)


def k11_change_fraction(spark, sf):
    return rounded(component_rows(spark, sf).filter("family = 'prosody'").select("case_id", "op_index", "fraction"))


def k12_executed(spark, sf):
    return component_rows(spark, sf).select("case_id", "op_index", "executed")


def k13_success(spark, sf):
    return component_rows(spark, sf).select("case_id", "op_index", "success")


def k14_penalty_rows(spark, sf):
    failed = evaluation(spark, sf).filter("penalty_applied")
    return rounded(
        failed.selectExpr(
            "case_id",
            "evaluation_status",
            "wer.deletions",
            "wdtw_dur.distance as dur_distance",
            "wdtw_dur.normalizer as dur_normalizer",
            "wdtw_f0.distance as f0_distance",
            "wdtw_f0.normalizer as f0_normalizer",
            "similarity",
            "utmos",
            "size(filter(components, c -> c.executed or c.success)) as passed",
        )
    )


def k15_case_evaluation(spark, sf):
    return rounded(
        evaluation(spark, sf).selectExpr(
            "case_id",
            "language",
            "category",
            "shard",
            "evaluation_status",
            "wer.error_rate as wer",
            "edit_region.error_rate as edit_wer",
            "non_edit_region.error_rate as other_wer",
            "wdtw_dur.value as dur",
            "wdtw_f0.value as f0",
            "similarity",
            "utmos",
            "size(components) as ops",
            "size(filter(components, c -> c.success)) as passed",
        )
    )


# -- aggregates


def a01_pooled_error_rate(spark, sf):
    return rounded(aggregate.pooled_error_rate(evaluation(spark, sf), "wer", "category"))


def a02_pooled_ratio(spark, sf):
    ev = evaluation(spark, sf)
    dur = aggregate.pooled_ratio(ev, "wdtw_dur", 100.0, "category").withColumn("measure", F.lit("duration"))
    f0 = aggregate.pooled_ratio(ev, "wdtw_f0", 1.0, "category").withColumn("measure", F.lit("f0"))
    return rounded(dur.unionByName(f0), 4)


def a03_strict_mean(spark, sf):
    ev = fixtures.cases(spark, sf)
    return rounded(ev.groupBy("shard").agg(aggregate.strict_mean("similarity").alias("similarity"), aggregate.strict_mean("utmos").alias("utmos")))


def a04_component_rates(spark, sf):
    return rounded(aggregate.component_rates(evaluation(spark, sf)))


def a05_outcome_rates(spark, sf):
    rows = aggregate.with_case_sums(evaluation(spark, sf))
    return rounded(rows.groupBy("category").agg(*aggregate.outcome_rates()))


def a06_category_metrics(spark, sf):
    rows = aggregate.with_case_sums(evaluation(spark, sf))
    return rounded(rows.groupBy("category").agg(*aggregate.category_metrics()))


def a06_unmeasured_pitch(spark, sf):
    """Pitch operations left out of the mean, by case."""
    return aggregate.unmeasured_pitch(evaluation(spark, sf))


def a07_summarize(spark, sf):
    return rounded(aggregate.summarize(evaluation(spark, sf)))


def a08_totals(spark, sf):
    return aggregate.totals(score.penalise(fixtures.cases(spark, sf)))


def a09_generation_counts(spark, sf):
    return aggregate.generation_counts(fixtures.cases(spark, sf).select("status"))


def a10_span_stats(spark, sf):
    return rounded(frames.recorded_stats(recorded(spark, sf)))


def a11_metric_label(spark, sf):
    cases = read(spark, sf).withColumn("category", case_ops.category())
    named = cases.select("category", text.er_metric("category", "language").alias("metric"))
    return named.groupBy("category").agg(aggregate.metric_label("metric").alias("metric"))


def a18_compare_systems(spark, sf):
    """Two systems by document parity and two modes by utterance parity."""
    cases = with_labels(fixtures.cases(spark, sf)).withColumns(
        {"system": F.expr("if(doc_id % 2 = 0, 'even', 'odd')"), "mode": F.expr("if(utt % 2 = 0, 'one_take', 'sequential')")}
    )
    return rounded(aggregate.compare_systems(score.evaluate(fixtures.with_tracks(cases))))


def u04_accumulator(spark, sf):
    """Counts pooled per shard and merged again give the counts pooled at once."""
    counted = _counted(spark, sf)
    parts = aggregate.pooled_error_rate(counted, "wer", "category", "shard")
    return parts.groupBy("category").agg(*[F.sum(c).alias(c) for c in (*aggregate.COUNTS, "count")])


