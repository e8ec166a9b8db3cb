import pytest
from pyspark.sql import functions as F

from editlens.functions import text, units
from editlens.operators import cases as case_ops
from editlens.operators import errors, measure, requests, score


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_units_of_mixed_text(spark):
    got = values(spark, text.units(F.lit("你好 world, it's 3")))[0]
    assert got == ["你", "好", "world", "it", "s", "3"]


def test_error_normal_form(spark):
    raw = [("一个apple_X，第3个", "一个 apple_x 第 3 个"), ("Ｈello,  WORLD!", "hello world"), ("Café", "café")]
    df = spark.createDataFrame(raw, "raw string, want string").select(text.normalize_er("raw").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    tokens = values(spark, text.mixed_tokens(text.normalize_er(F.lit("你好 world"))))[0]
    assert tokens == ["你", "好", "world"]


@pytest.mark.parametrize(
    "ref, hyp, metric, rate, counts",
    [
        ("Hello, WORLD!", "hello word", "mixed", 0.5, (1, 0, 0)),
        ("你好 world", "你 world", "mixed", 1 / 3, (0, 1, 0)),
        ("", "word", "mixed", None, (0, 0, 1)),
        ("", "", "mixed", 0.0, (0, 0, 0)),
        ("你好吗", "你好", "cer", 1 / 3, (0, 1, 0)),
    ],
)
def test_error_counts(spark, ref, hyp, metric, rate, counts):
    df = spark.createDataFrame([(ref, hyp)], "ref string, hyp string")
    wer = errors.with_error_counts(df, "ref", "hyp", F.lit(metric)).first().wer
    assert (wer.error_rate is None) == (rate is None) and (rate is None or wer.error_rate == pytest.approx(rate))
    assert (wer.substitutions, wer.deletions, wer.insertions) == counts


def local(spark, xml, heard, context=3):
    df = spark.createDataFrame([("c", xml, heard)], "case_id string, instruction_xml string, heard string")
    return errors.with_local_errors(case_ops.read_instructions(df), "heard", context).first().local_errors


def test_failed_deletion_is_local(spark):
    xml = "please <del>delete </del>this word now"
    failed = local(spark, xml, "please delete this word now")
    assert (failed.edit.insertions, failed.edit.ref_length, failed.edit.error_rate) == (1, 4, 0.25)
    assert local(spark, xml, "please this word now").edit.error_rate == 0


def test_regions_partition_the_errors(spark):
    e = local(spark, "a b c d <del>x </del>x e f g h", "a b z d x y e f g h h", 1)
    assert e.edit.ref_length == 2
    assert e.edit.insertions + e.other.insertions == 2 and e.edit.substitutions + e.other.substitutions == 1
    assert e.edit.ref_length + e.other.ref_length == 9


def test_insertion_belongs_to_one_side(spark):
    path = "array(named_struct('p', 0, 'op', 'H', 'ins', 0), named_struct('p', 1, 'op', 'H', 'ins', 1), named_struct('p', 2, 'op', 'E', 'ins', 0))"
    left, right = values(spark, *[F.expr(errors.region_counts(path, f"{{p}} = {i}")).alias(str(i)) for i in (0, 1)])
    assert (left.insertions, right.insertions) == (0, 1)


@pytest.mark.parametrize(
    "act, delta, ok",
    [("ins", 0.159, False), ("ins", 0.16, True), ("ins", 0.16 - 5e-7, True), ("ins", 0.16 - 2e-6, False), ("red", -0.16, True), ("red", -0.159, False)],
)
def test_pause_threshold(spark, act, delta, ok):
    assert values(spark, F.expr(measure.pause_correct(f"'{act}'", "0.5D", f"double({0.5 + delta!r})")))[0] is ok


@pytest.mark.parametrize("fraction, ok", [(0.5999, False), (0.6, True), (1.6, True), (1.6001, False)])
def test_success_bounds(spark, fraction, ok):
    assert values(spark, F.expr(score.success("'pitch'", f"double({fraction})", "true")))[0] is ok


@pytest.mark.parametrize(
    "kind, param, shift, ratio, ok",
    [("pitch", "4", 0.9999, None, False), ("pitch", "4", 1.0, None, True), ("rate", "2", None, 0.9001, False), ("rate", "2", None, 0.9, True), ("pitch", "-4", -1.0, None, True)],
)
def test_execution_thresholds(spark, kind, param, shift, ratio, ok):
    value = lambda v: "cast(null as double)" if v is None else f"double({v})"
    m = f"named_struct('status', 'ok', 'shift', {value(shift)}, 'ratio', {value(ratio)}, 'predicted', '', 'correct', false)"
    fraction = score.change_fraction(f"'{kind}'", f"'{param}'", "'ok'", value(shift), value(ratio))
    got = values(spark, F.expr(units.let("m", m, score.executed(f"'{kind}'", f"'{param}'", "m", f"({fraction})", "0D"))))
    assert got[0] is ok


def test_requested_neutral_never_passes(spark):
    assert values(spark, requests.extract_label(F.lit("neutral")))[0] == "calm"


def pairs(*rows):
    body = ", ".join(
        f"named_struct('i', {i}, 'j', {i}, 'sw', 'w', 's0', 0D, 's1', {float(s)}D, 'tw', 'w', 't0', 0D, 't1', {float(t)}D)" for i, (s, t) in enumerate(rows)
    )
    return f"array({body})"


@pytest.mark.parametrize(
    "source, target, shift, status",
    [("map(0, 100D)", "map(0, 200D, 1, 100D)", 12.0, "ok"), ("map(0, 100D, 1, 100D)", "map(0, 200D)", 6.0, "missing_target")],
)
def test_pitch_shift(spark, source, target, shift, status):
    got = values(spark, F.expr(measure.pitch(pairs((1, 1), (1, 1)), "3D", source, target)))[0]
    assert (got.shift, got.status, got.l1) == (shift, status, abs(shift - 3))


def test_f0_preservation(spark):
    flat = lambda hz: f"named_struct('lo', {hz}D, 'hi', {hz}D, 'mean', {hz}D)"
    df = spark.range(1).select(
        F.expr(pairs((1, 1), (1, 1))).alias("kept_f0"),
        F.expr(f"map(0, {flat(100)}, 1, {flat(100)})").alias("source_f0"),
        F.expr(f"map(0, {flat(200)})").alias("target_f0"),
    )
    got = df.select(measure.f0_preservation().alias("v")).first().v
    assert (got.value, got.normalizer, got.status) == (10.0, 2.0, "penalized_missing_target_f0")


def timed(spark, xml, times):
    spans = f"array({', '.join(f'named_struct(\'word\', \'w\', \'start\', {a}D, \'end\', {b}D)' for a, b in times)})"
    df = spark.createDataFrame([("c", xml)], "case_id string, instruction_xml string").select(
        "*", F.expr(spans).alias("source_units"), F.expr(spans).alias("target_units"), F.lit(2.0).alias("source_duration"), F.lit(2.0).alias("target_duration")
    )
    return case_ops.with_timed_units(case_ops.read_instructions(df)).withColumn("whole", F.lit(False))


@pytest.mark.parametrize(
    "xml, start, end",
    [
        ('it <emo type="sad">it</emo> it', 0.1, 0.2),
        ('<pause act="ins"/>a b c', 0.0, 0.0),
        ('a b c<pause act="ins"/>', 0.3, 2.0),
        ('a<pause act="ins"/> b c', 0.1, 0.1),
    ],
)
def test_operation_times(spark, xml, start, end):
    row = score.with_operation_times(timed(spark, xml, [(0.0, 0.1), (0.1, 0.2), (0.2, 0.3)])).first()
    assert (row.timed_ops[0].source.start, row.timed_ops[0].source.end) == (start, end)


def test_connectors_mark_both_units(spark):
    xml = "don<del>'</del>t go"
    df = timed(spark, xml, [(0.0, 0.1), (0.1, 0.2), (0.2, 0.3)])
    assert df.select(F.expr(units.marked("s", "3", "4"))).first()[0] == [0, 1]


@pytest.mark.parametrize("value, snapped", [("0.97", 0.9), ("1.04", 1.1), ("1.25", 1.2), ("0.85", 0.9), ("0.1", 0.5), ("3", 2.0), ("1", 1.0)])
def test_speed_grid(spark, value, snapped):
    v, one = f"cast('{value}' as decimal(12, 6))", "cast(1 as decimal(12, 6))"
    assert float(values(spark, F.expr(requests.snap_to_grid(v, requests.RATE_GRID, one)))[0]) == snapped


def test_unique_context_counts_overlaps():
    assert not requests._occurs_once("哈哈哈", "哈哈")
    assert requests.smallest_unique("a b a c", 4, 5) == (2, 5)
    assert requests.smallest_unique("x x", 0, 1) == (0, 3)


def brute_context(content, start, end):
    """Windows by length, then place: the first that holds the edit, begins and ends at unit bounds and occurs once."""
    from editlens.functions.instructions import unit_bounds

    starts, ends = {0, start}, {len(content), end}
    for begin, stop, *_ in unit_bounds(content):
        starts.add(begin)
        ends.add(stop)
    for length in range(1, len(content) + 1):
        windows = [content[i : i + length] for i in range(len(content) - length + 1)]
        for at, window in enumerate(windows):
            if at in starts and at + length in ends and at <= start and end <= at + length and windows.count(window) == 1:
                return at, at + length
    return None


def test_unique_context_is_smallest():
    import random

    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(1, 9))]
        content = " ".join(words)
        start = rng.randint(0, len(content))
        end = rng.randint(start, len(content))
        assert requests.smallest_unique(content, start, end) == brute_context(content, start, end)


def test_label_order_is_a_seeded_permutation():
    first = requests.shuffled_labels("case", 0)
    assert sorted(first) == sorted(requests.EMOTION_LABELS)
    assert first == requests.shuffled_labels("case", 0) != requests.shuffled_labels("case", 1)
