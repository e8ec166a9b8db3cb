"""The pipeline's stages on a small table, each judged on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from editlens.llm import decontaminate


def rows():
    rng = random.Random(3)
    vocabulary = {"aa": [f"{a}{b}ro" for a in "bcdfg" for b in "aeiou"], "bb": [f"x{a}{b}k" for a in "mnpqr" for b in "wyzuv"]}
    passage = " ".join(rng.choice(vocabulary["aa"]) for _ in range(30))
    line = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(40))
    docs = [(i, "\n".join(line(k) for _ in range(3)), k, f"s{i % 2}", 0) for i, k in enumerate(["aa", "bb"] * 12)]
    docs.append((100, docs[0][1], "aa", "s0", 0))  # an exact copy
    docs.append((101, docs[1][1].replace(" x", " y", 2), "bb", "s1", 0))
    docs.append((102, line("aa") + " " + passage + " " + line("aa"), "aa", "s0", 0))
    docs += [(103, None, "aa", "s0", 0), (104, "", None, None, 0), (105, "123 !!", "bb", "s1", 0)]
    return docs, passage


def test_stages(spark, tmp_path):
    data, passage = rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(24))
    assert set(seen["language"]) == clean | {100, 101, 102}
    lines = seen["lines"]
    assert set(lines) == set(seen["language"]) and lines[100].text == "" and all(lines[i].text == data[i][1] for i in clean)
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(seen["near_duplicates"]) == clean | {100, 102} | ({101} if lines[101].text else set())
    kept = {i for i, r in seen["near_duplicates"].items() if passage not in decontaminate.plain(r.text)}
    assert set(seen["benchmark"]) == kept and 102 not in kept
    assert set(seen["packing"]) == kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
