"""The pipeline's near duplicates are the components of op5's fingerprints."""

import random

import corpus_pipeline
from editlens.llm import simhash


def test_stage_keeps_one_row_of_each_simhash_component(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=400)), "aa", "s", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " " + rng.choice(vocabulary), "aa", "s", 0) for i in range(20)]
    rows += [(200, rows[3][1], "aa", "s", 0), (200, rows[4][1], "aa", "s", 0), (None, rows[5][1], "aa", "s", 0), (None, "allein", "aa", "s", 0)]
    rows += [(300, "", "aa", "s", 0), (301, None, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    prints = spark.createDataFrame([(n, r[1]) for n, r in enumerate(rows)], "doc_id long, text string")
    component = {r.doc_id: r.component_id for r in simhash.groups(prints).collect()}
    best = {}
    for n, row in enumerate(rows):
        rank = (row[0] is None, row[0] or 0, n)
        best[component[n]] = min(best.get(component[n], (rank, row)), (rank, row), key=lambda x: x[0])
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(row) for _, row in best.values())
    assert len(kept) < len({row[1] or "" for row in rows})
