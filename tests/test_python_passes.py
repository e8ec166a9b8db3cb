"""Case rows meet Python twice, and nothing before an explode is made twice."""

import pytest
from pyspark.sql import functions as F

from editlens.functions import text
from editlens.plans import evaluation_queries as plans

SF = "/root/testdata/sf0.001"


def optimized(query, spark):
    return getattr(plans, query)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["a04_component_rates", "a07_summarize", "k03_edit_region", "k03_local_error_rate", "k13_success"])
def test_cases_meet_python_twice(spark, query):
    assert optimized(query, spark).count("ArrowEvalPython") == 2


@pytest.mark.parametrize("query", ["j03_pair_units", "j04_span_times", "j05_point_gaps", "k13_success", "p12_preserved_pairs", "p14_crop_window"])
def test_no_filter_makes_an_array_again(spark, query):
    filters = [line for line in optimized(query, spark).splitlines() if line.strip(" +-:").startswith("Filter")]
    assert not any("lambda" in line for line in filters)


def test_tracks_are_used_up_with_the_instruction(spark):
    lines = optimized("a07_summarize", spark).splitlines()
    (reading,) = [line for line in lines if "ArrowEvalPython" in line and "_parse_column" in line]
    assert reading.count("_statistics_column(") == 2


def test_ways_of_normalising_agree(spark):
    texts = ["", " ", "It's A_b-c,  d\t\n!", "\x1c\x00a\x7f1", "Ünï ﬁne", "你好 world", "a．b", None]
    rows = spark.createDataFrame([(t, t) for t in texts], "a string, b string").withColumn("made", text.nfkc("a"))
    slow = F.lower(F.col("made"))
    for pattern in text.BLANKED:
        slow = F.regexp_replace(slow, pattern, " ")
    rows = rows.withColumns({"slow": F.trim(slow), "one": text.normalize_er("a"), "two": text.normalize_er("a", "made")})
    rows = rows.withColumn("n", F.expr(text.composed_token_count("made"))).withColumn("tokens", F.size(text.mixed_tokens("slow")))
    for r in rows.collect():
        assert r.one == r.two == r.slow
        assert r.n == r.tokens or r.a is None


def test_few_rows_wait_at_python_columns(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for asked, got in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(setting, asked)
            plans.evaluation(spark, SF)
            assert spark.conf.get(setting) == got
    finally:
        spark.conf.set(setting, before)
