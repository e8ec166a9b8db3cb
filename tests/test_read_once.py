import pytest

from editlens.operators import requests
from editlens.plans import table_queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, reads", [("j10_cache_split", 0), ("j10_identity_split", 0), ("w04_step_lineage", 1)])
def test_instructions_are_read_once(spark, query, reads):
    plan = getattr(plans, query)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == reads


def test_lineage_of_null_inputs_and_missing_steps(spark):
    rows = [("a", 0, None, "x", "ok"), ("a", 1, "x", "y", "ok"), ("a", 2, None, "z", "ok"), ("b", 1, "x", "y", "ok"), ("c", 0, "s", "t", "error"), ("c", 1, "t", "u", "ok")]
    trace = spark.createDataFrame(rows, "case_id string, step int, input_sha256 string, output_sha256 string, status string")
    got = {(r.case_id, r.step, r.reason) for r in requests.step_lineage(trace).collect()}
    assert got == {("a", 2, "input is not the output before"), ("b", 1, "step before is missing"), ("c", 1, "step before failed")}
