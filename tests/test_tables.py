import pytest
from pyspark.sql import functions as F

from editlens import plugins, schemas
from editlens.operators import aggregate, provenance, quality, requests, sequence_checks, skew
from editlens.session import scratch
from editlens.streaming import logs

COUNTS = "named_struct('substitutions', {s}, 'deletions', 0, 'insertions', {i}, 'hits', {h}, 'ref_length', {n}, 'hyp_length', {h}, 'metric', 'mixed', 'error_rate', 0D)"


def pool(spark, *rows):
    df = spark.range(1).select(F.explode(F.expr(f"array({', '.join(COUNTS.format(**r) for r in rows)})")).alias("wer"))
    return aggregate.pooled_error_rate(df, "wer").first()


def test_pooled_rate(spark):
    assert pool(spark, {"s": 1, "i": 0, "h": 1, "n": 2}, {"s": 0, "i": 0, "h": 8, "n": 8}).error_rate == 0.1
    assert pool(spark, {"s": 0, "i": 1, "h": 0, "n": 0}, {"s": 0, "i": 0, "h": 2, "n": 2}).error_rate == 0.5
    assert pool(spark, {"s": 0, "i": 1, "h": 0, "n": 0}).error_rate is None


def test_outcomes(spark):
    c = lambda ok: f"named_struct('executed', {ok}, 'success', {ok}, 'operation', 'insert', 'measurement', named_struct('correct', {ok}, 'rate_l1', 0D, 'pitch_l1', 0D))"
    cases = f"array(array({c('true')}), array({c('true')}, {c('false')}))"
    df = spark.range(1).select(F.explode(F.expr(cases)).alias("components"))
    row = aggregate.with_case_sums(df).agg(*aggregate.outcome_rates()).first()
    assert row.component_success_rate == pytest.approx(2 / 3) and row.all_component_success_rate == 0.5


def test_strict_mean_refuses_nan(spark):
    assert spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(aggregate.strict_mean("v")).first()[0] == 1.5
    with pytest.raises(Exception, match="non-finite"):
        spark.createDataFrame([(1.0,), (float("nan"),)], "v double").agg(aggregate.strict_mean("v")).collect()


def attempt_log(spark, **runs):
    rows = [(i, n, f"2024-01-01 00:00:{n:02d}", s) for i, statuses in enumerate(runs.values()) for n, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "key long, event_id long, ts string, status string").withColumn("ts", F.to_timestamp("ts")).withColumn("error", F.lit("e"))


def test_attempts(spark):
    log = attempt_log(
        spark, retry=["error", "unsupported", "ok", "error"], refused=["unsupported"] * 5, mixed=["running"] * 4 + ["unsupported", "ok"], short=["running"], stopped=["error"] * 4 + ["running"]
    )
    got = {r.key: (r.status, r.attempts) for r in requests.terminal_status(log).collect()}
    assert got == {0: ("ok", 3), 1: ("unsupported", 5), 2: ("unsupported", 5), 3: ("pending", 1), 4: ("error", 5)}
    numbered = requests.number_attempts(log).filter("key = 3").first()
    assert (numbered.status, numbered.error) == ("error", requests.IN_FLIGHT)


def test_native_pause_gets_a_level_in_both_forms(spark):
    xml = spark.createDataFrame([('a<pause act="ins"/>b',), ('a<pause act="ins"></pause>b',)], "instruction_xml string")
    assert [r.x for r in xml.select(requests.native_tags().alias("x")).collect()] == ['a<pause act="ins" level="2"/>b', 'a<pause act="ins" level="2"></pause>b']


def test_streamed_attempts_resume(spark):
    """The same answer when the log arrives in two parts and the job is restarted between them."""
    path, table, point = scratch(spark), scratch(spark), scratch(spark)
    log = attempt_log(spark, retry=["error", "unsupported", "ok", "error"], refused=["unsupported"] * 5, mixed=["running"] * 4 + ["unsupported", "ok"], stopped=["error"] * 4 + ["running"])
    for part in ("event_id < 2", "event_id >= 2"):
        log.filter(part).coalesce(1).write.mode("append").json(path)
        stream = spark.readStream.schema("key long, event_id long, ts timestamp, status string").json(path)
        logs.stream_attempts(stream, table, point)
    got = {r.key: (r.status, r.attempts) for r in logs.latest_states(spark, table).collect()}
    assert got == {r.key: (r.status, r.attempts) for r in requests.terminal_status(log).collect()}


def test_stream_appends_each_key_once(spark):
    path, table, point = scratch(spark), scratch(spark), scratch(spark)
    for _ in range(2):
        spark.range(20).selectExpr("id % 15 as id", "'ok' as status").write.mode("append").json(path)
        logs.stream_runlog(spark.readStream.schema("id long, status string").json(path), "id", table, point)
    assert spark.read.parquet(table).count() == 15


def test_cache_fill_scores_new_keys_only(spark):
    path, cache, point, scored = scratch(spark), scratch(spark), scratch(spark), []
    schema = schemas.struct(key=schemas.LONG, answer=schemas.STRING)

    def answer(df):
        scored.append(df.count())
        return df.selectExpr("key", "'a' as answer")

    for n in (5, 8):
        spark.range(n).withColumnRenamed("id", "key").write.mode("append").json(path)
        logs.stream_fill_cache(spark.readStream.schema("key long").json(path), "key", cache, schema, answer, point)
    assert scored == [5, 3] and spark.read.parquet(cache).count() == 8


def test_hot_key_join_keeps_every_row(spark):
    many = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    one = spark.range(1000).selectExpr("id as k", "id * 2 as v")
    got = skew.salted_join(many, one, "k", hot_rows=10, salts=4)
    assert got.count() == 1000 and got.filter("v <> k * 2").count() == 0


def test_ordinals_of_a_hot_key(spark):
    df = spark.range(500).selectExpr("if(id % 2 = 0, 'hot', concat('k', id)) as k", "499 - id as v")
    rows = skew.ordinals(df, "k", "v").filter("k = 'hot'").orderBy("v").collect()
    assert [r.ord for r in rows] == list(range(250))


def test_previous_row_across_blocks(spark):
    df = spark.range(50).selectExpr("'a' as k", "cast(id as int) as ord", "id * 1.0D as start", "id + if(id = 17, -9, 1.0D) as end")
    got = sequence_checks.with_previous(df, "k", "ord", "start", block=7).orderBy("ord").collect()
    assert [r.prev_start for r in got] == [None, *[float(i) for i in range(49)]]
    assert [r.ord for r in sequence_checks.monotone_violations(df, "k").collect()] == [17]


def test_previous_row_across_gaps(spark):
    df = spark.createDataFrame([("a", i, float(i), i + 1.0) for i in (0, 5, 6, 7, 40, 41, 90)], "k string, ord int, start double, end double")
    got = sequence_checks.with_previous(df, "k", "ord", "start", block=7).orderBy("ord").collect()
    assert [r.prev_start for r in got] == [None, 0.0, 5.0, 6.0, 7.0, 40.0, 41.0]


def test_every_step_of_a_long_plan_runs(spark):
    steps = spark.createDataFrame([("c", i, "x") for i in range(5)] + [("d", 0, "x")], "case_id string, step int, xml string")
    sources = spark.createDataFrame([("c", "1"), ("d", "1")], "case_id string, input_sha256 string")
    done = plugins.apply_generator(steps, sources, lambda b: b.assign(output_sha256=b["input_sha256"] + "a", error=None))
    assert sorted((r.case_id, r.step, r.output_sha256) for r in done.collect()) == [("c", i, "1" + "a" * (i + 1)) for i in range(5)] + [("d", 0, "1a")]
    assert plugins.apply_generator(steps.limit(0), sources, None).count() == 0


@pytest.mark.parametrize("n", [99_999, 100_001])
def test_one_digest_rule_at_every_size(spark, n):
    import hashlib

    level = {}
    for i in range(n):
        key = hashlib.sha256(f"a{i}".encode()).hexdigest()
        level.setdefault(key[:4], []).append((key, hashlib.sha256(f'{{"asset_id":"a{i}","sha256":"s","size_bytes":{i}}}'.encode()).hexdigest()))
    for width in (3, 2, 1, 0, None):
        joined = [(k, hashlib.sha256("".join(d for _, d in sorted(v)).encode()).hexdigest()) for k, v in level.items()]
        level = {}
        for k, d in joined:
            level.setdefault(k[:width] if width is not None else None, []).append((k, d))
    table = spark.range(n).selectExpr("concat('a', id) as asset_id", "'s' as sha256", "id as size_bytes")
    assert provenance.inventory_digest(table).first() == (n, level[None][0][1])


def test_digest_ignores_order_and_sees_changes(spark):
    rows = [(f"a{i}", f"s{i}", i) for i in range(50)]
    table = lambda r: spark.createDataFrame(r, "asset_id string, sha256 string, size_bytes long")
    tree = lambda r: provenance.tree_digest(table(r), "asset_id", provenance.canonical_json("asset_id", "sha256", "size_bytes")).first().digest
    assert tree(rows) == tree(rows[::-1]) != tree([("a0", "s0", 1), *rows[1:]])
    import hashlib
    import json

    want = json.dumps([{"asset_id": a, "sha256": s, "size_bytes": n} for a, s, n in sorted(rows)], separators=(",", ":"))
    assert provenance.list_digest(table(rows)).first().digest == hashlib.sha256(want.encode()).hexdigest()


def test_request_key_is_the_digest_of_the_json(spark):
    import hashlib
    import json

    item = {"instruction_xml": 'a<ins>"é\\\n</ins>', "source_text": "a", "language": "zh"}
    df = spark.createDataFrame([tuple(item.values())], "x string, s string, l string")
    got = df.select(F.sha2(requests.spaced_json(instruction_xml="x", source_text="s", language="l").cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(json.dumps(item, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_gate_names_the_first_violation(spark):
    clean = spark.createDataFrame([("a",), ("b",)], "id string")
    assert quality.gate(quality.check_unique(clean, "id")).count() == 0
    with pytest.raises(ValueError, match="C03 a: 2 rows"):
        quality.gate(quality.check_unique(clean.union(clean.limit(1)), "id"))


@pytest.mark.parametrize(
    "json, check", [('{"kind":"bundle","path":"p"}', []), ('{"kind":"bundle","path":"p","x":1}', ["fields"]), ('{"path":"p"}', ["fields"])]
)
def test_recipes(spark, json, check):
    df = spark.createDataFrame([("a", json)], "asset_id string, recipe string")
    assert [r.detail for r in quality.check_recipes(df).collect()] == check


def test_case_path_rules(spark):
    df = spark.createDataFrame(
        [("a", "0" * 64, "x/y.wav"), ("b", "0" * 64, "../x"), ("c", "0" * 64, "a\\b"), ("d", "0" * 64, "a..b")], "case_id string, sha256 string, path string"
    )
    assert sorted(r.key for r in quality.check_patterns(df).collect()) == ["b", "c"]
