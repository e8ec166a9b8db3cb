"""Queries over assets, ledgers, manifests, requests, attempts and their contracts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from editlens import fixtures, plugins, schemas
from editlens.functions.instructions import plan_instructions
from editlens.functions.text import redact, text_sha
from editlens.operators import cases as case_ops
from editlens.operators import attempt_times, manifest_fields, provenance, quality, requests, runs, score, stages
from editlens.plans.evaluation_queries import read, rounded, timed
from editlens.session import scratch
from editlens.sources import cache, manifests, payloads, runlog
from editlens.streaming import attempts, logs

KNOWN_STATUSES = ("ok", "candidate_error")


# -- sources and sinks


def _manifest_root(spark, sf):
    """Manifests written from the cases: one per document, in folders by category and shard."""
    cases = read(spark, sf).withColumn("category", case_ops.category())
    digest = text_sha("source_text")
    case = F.struct(
        F.col("case_id").alias("id"),
        "language",
        F.struct(digest.alias("asset_id"), F.concat(F.lit("audio/"), digest, F.lit(".wav")).alias("path"), digest.alias("sha256")).alias("source_audio"),
        "instruction_xml",
        F.struct(F.struct(digest.alias("audio_sha256"), digest.alias("text_sha256"), F.col("source_units").alias("segments")).alias("source_alignment")).alias("annotations"),
    )
    recipe = F.struct(F.lit("generate").alias("kind"), F.lit("voxcpm2").alias("provider"), F.col("uid").alias("seed"), F.struct(F.col("n").alias("cfg_value")).alias("parameters"))
    # A document has a bounded number of utterances, so a manifest stays one row.
    rows = cases.groupBy("category", "shard", "doc_id").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat("case_id", F.lit("-a")), recipe)))).alias("audio_assets"),
        F.collect_list(case).alias("cases"),
    )
    root = scratch(spark)
    rows.drop("doc_id").write.option("compression", "gzip").partitionBy("category", "shard").json(root)
    return root


def s01_manifest_scan(spark, sf):
    cases = manifests.read_cases(spark, _manifest_root(spark, sf), multi_line=False)
    return cases.selectExpr("category", "shard", "case_id", "language", "sha256", "size(source_units) as units")


def s02_shard_pruning(spark, sf):
    cases = manifests.read_cases(spark, _manifest_root(spark, sf), category="text", shard="easy", multi_line=False)
    return cases.select("case_id", "category", "shard")


def s03_asset_map(spark, sf):
    assets = manifests.read_assets(spark, _manifest_root(spark, sf), multi_line=False)
    value = F.try_variant_get("parameters", "$.cfg_value", "bigint").alias("cfg_value")
    return assets.select("asset_id", "category", "kind", "provider", "seed", value)


def s04_payload_hash(spark, sf):
    return payloads.read_payloads(spark, sf, "*.parquet")


def _generation_log(spark, sf):
    path = scratch(spark)
    rows = fixtures.cases(spark, sf).selectExpr(
        "case_id as id", "status", "concat('out/', case_id, '.wav') as audio_path", "sha2(cast(target_text as binary), 256) as audio_sha256",
        "if(status = 'ok', null, 'no audio') as error", "utt % 2 as run_id",
    )
    for half in (0, 1):
        runlog.append_records(rows.filter(F.col("run_id") == half), path, "run_id")
    return path


def s05_runlog_scan(spark, sf):
    return runlog.read_generation(spark, _generation_log(spark, sf)).select("id", "status", "audio_sha256", "error")


def s06_ledger_scan(spark, sf):
    path = scratch(spark)
    fixtures.ledger(spark, sf).select("audio_sha256", "source", "decision").write.json(path)
    rows = runlog.read_ledger(spark, path)
    source = F.variant_get("record", "$.source", "string").alias("source")
    return quality.check_unique(rows.select("audio_sha256", source), "audio_sha256")


def s07_append_sink(spark, sf):
    stored = spark.read.json(_generation_log(spark, sf))
    return stored.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def s08_summary_sink(spark, sf):
    path = scratch(spark)
    cases = score.penalise(fixtures.cases(spark, sf))
    totals = cases.agg(F.count("*").alias("evaluated"), F.count_if("penalty_applied").alias("penalized"))
    runlog.write_summary(totals.select(F.lit("incomplete").alias("status"), F.struct(*totals.columns).alias("metrics")), path, 0)
    runlog.write_summary(totals.select(F.lit("complete").alias("status"), F.struct(*totals.columns).alias("metrics")), path, 1)
    return runlog.read_summary(spark, path).select("status", "metrics.*")


def s09_content_sink(spark, sf):
    """Stored in two goes with overlap; each content is kept once."""
    root = scratch(spark)
    docs = fixtures.documents(spark, sf).select("doc_id", text_sha("text").alias("sha256"), F.col("text").cast("binary").alias("content"))
    payloads.store_payloads(docs.filter("doc_id % 3 <> 0").drop("doc_id"), root)
    payloads.store_payloads(docs.drop("doc_id"), root)
    return spark.read.parquet(root).groupBy(F.col("prefix").cast("string").alias("prefix")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))


def s10_run_snapshot(spark, sf):
    cases = fixtures.cases(spark, sf).select("uid", "case_id").withColumnRenamed("uid", "ord")
    header, members = runlog.run_snapshot(cases, "run-1", candidate="identity", dataset_version="1")
    first = members.agg(F.min_by("case_id", "ord").alias("first_case"), F.max_by("case_id", "ord").alias("last_case"))
    return header.select("run_id", "cases", "candidate", "dataset_version", "status").withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k").drop("k")


def _inventory(spark, sf):
    return provenance.distinct_assets(
        fixtures.assets(spark, sf).withColumn("sha256", F.col("asset_id")), "sha256", "size_bytes"
    )


def s11_receipt(spark, sf):
    path = scratch(spark)
    assets = provenance.top_definition(fixtures.assets(spark, sf))
    rows = assets.selectExpr("asset_id", "kind", "if(kind = 'generate', 'voxcpm2', null) as provider", "asset_id as reference_sha256", "asset_id as sha256", "size_bytes")
    runlog.write_receipt(rows, provenance.inventory_digest(rows), path)
    header, _ = runlog.read_receipt(spark, path)
    return header.select("assets", "digest", F.explode("by_kind").alias("kind", "n"))


def s12_bundle_export(spark, sf):
    return provenance.export_bundle(fixtures.ledger(spark, sf), _inventory(spark, sf), ("allow",))


# -- commands, windows, labels, recipes


def p20_render_commands(spark, sf):
    ops = case_ops.explode_operations(read(spark, sf), "language")
    return requests.render_commands(ops)


def p20_native_tags(spark, sf):
    return fixtures.cases(spark, sf).select("case_id", requests.native_tags().alias("native"))


def p21_snap_to_grid(spark, sf):
    """Order totals and discounts as requests: every line item asks for a speed and a shift."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_quantity * 0.05 + 0.03 as decimal(12, 6)) as speed", "cast(l_discount * 100 - 5.5 as decimal(12, 6)) as shift"
    )
    one, zero = "cast(1 as decimal(12, 6))", "cast(0 as decimal(12, 6))"
    return lines.selectExpr(
        "l_orderkey",
        "l_linenumber",
        f"cast({requests.snap_to_grid('speed', requests.RATE_GRID, one)} as double) as speed",
        f"cast({requests.snap_to_grid('shift', requests.PITCH_GRID, zero)} as int) as shift",
    )


def p22_unique_context(spark, sf):
    ops = case_ops.explode_operations(read(spark, sf), "parsed").filter("kind in ('ins', 'del', 'sub')")
    found = ops.select("case_id", "op_index", requests.unique_context(F.col("parsed.source_text"), "src_start", "src_end").alias("c"))
    return found.select("case_id", "op_index", "c.start", "c.end")


def p23_edit_windows(spark, sf):
    """The first operation of each case; 16 kHz recordings."""
    rows = score.with_operation_times(timed(spark, sf).withColumn("whole", F.lit(False)))
    first = rows.selectExpr("*", "array_sort(transform(parsed.ops, (o, i) -> named_struct('at', o.src_start, 'i', i)))[0].i as f")
    ops = first.selectExpr(
        "case_id", "get(parsed.ops, f).kind as kind", "get(parsed.ops, f).param as param", "get(timed_ops, f).source.start as start",
        "get(timed_ops, f).source.end as end", "source_duration as duration", "16000 as sample_rate",
        "cast(round(source_duration * 16000) as bigint) as samples",
        """get(parsed.ops, f).kind in ('emo', 'rate', 'pitch') and not concat(substring(parsed.source_text, 1, get(parsed.ops, f).src_start),
          substring(parsed.source_text, get(parsed.ops, f).src_end + 1)) rlike '[A-Za-z0-9]' as whole""",
        "parsed.source_text",
        "case get(parsed.ops, f).kind when 'del' then '' else coalesce(get(parsed.ops, f).param, get(parsed.ops, f).content) end as new",
        "get(parsed.ops, f).src_start as a", "get(parsed.ops, f).src_end as b",
        "try_element_at(filter(s, u -> u.b <= get(parsed.ops, f).src_start), -1).t0 as left_start",
        "get(filter(s, u -> u.a >= get(parsed.ops, f).src_end), 0).t1 as right_end",
    )
    from editlens.functions.instructions import replace_span_text

    changed = replace_span_text("source_text", "a", "b", F.when(F.col("kind").isin("ins", "del", "sub"), F.col("new")).otherwise(""))
    windows = requests.edit_windows(ops.withColumn("target_text", changed))
    return rounded(windows.select("case_id", "kind", "start_frame", "end_frame", "target_frames", "generated_samples", "window_seconds", "identity"))


def _numbered(spark, sf):
    return requests.number_attempts(fixtures.attempts(spark, sf))


def p24_retry_prompt(spark, sf):
    rows = _numbered(spark, sf).withColumn("instruction_xml", F.concat(F.lit("request "), F.col("key").cast("string")))
    return requests.retry_prompt(rows, "Edit: ").select("key", "number", "prompt")


def p25_extract_label(spark, sf):
    """Turns as replies, each with a judgement appended."""
    said = "get(array(' Happy.', ' happy or sad', ' neutral', ' unhappy', ''), cast((conv_id * 7 + turn) % 5 as int))"
    replies = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id", "turn", f"concat(text, {said}) as reply")
    return replies.select("conv_id", "turn", requests.extract_label("reply").alias("label"))


def p26_label_order(spark, sf):
    """How often each label comes first; the permutation itself has no SQL form."""
    cases = fixtures.cases(spark, sf).select("case_id", requests.label_order("case_id", F.lit(0)).alias("labels"))
    return cases.select(F.col("case_id"), F.concat_ws(" ", "labels").alias("labels"))


def _records(spark, sf):
    """Ledger documents: a third generated, a third upstream, a third bundled."""
    docs = fixtures.documents(spark, sf)
    generation = """named_struct('generator', if(doc_id % 3 = 0, get(array('indextts2', 'voxcpm2', 'mimo_audio_instruct', 'qwen3_tts'), cast(doc_id % 4 as int)), null),
        'model_id', concat('m', doc_id % 5), 'seed', doc_id, 'control', if(doc_id % 2 = 0, lang, null), 'cfg_value', doc_id % 7,
        'reference_voice', if(doc_id % 6 = 0, named_struct('audio_sha256', concat('r', doc_id % 50)), null))"""
    names = "get(array('AISHELL-1', 'CommonVoice20.0', 'FLEURS', 'MLS'), cast(doc_id % 4 as int))"
    source = f"if(doc_id % 2 = 0, to_json(array({names})), to_json(array(named_struct('dataset', if(doc_id % 5 = 0, null, {names}), 'kind', 'written', 'uid', doc_id))))"
    record = f"""concat('{{"audio_sha256":"', sha2(cast(text as binary), 256), '","source_dataset":"', if(doc_id % 3 = 1, 'CommonVoice20.0', source),
        '","source_split":"', lang, '","source_clip_id":"clip', doc_id, '","source_path":"clips/', doc_id, '.mp3","source_raw_sha256":"', sha2(cast(lang as binary), 256),
        '","generation":', to_json({generation}), ',"rights":{{"transcript":{{"source":', regexp_extract({source}, '^.(.*).$', 1), '}}}}}}')"""
    return docs.select("doc_id", text_sha("text").alias("audio_sha256"), F.expr(f"parse_json({record})").alias("record"))


def p27_derive_recipes(spark, sf):
    rows = provenance.derive_recipes(_records(spark, sf))
    parameters = F.concat_ws(",", F.array_sort(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))).alias("parameters")
    return rows.select("doc_id", "kind", "provider", "model_id", "seed", "reference_asset_id", "split", "clip_id", "path", "sha256", parameters)


def p28_transcript_origin(spark, sf):
    return provenance.with_origin(_records(spark, sf), "own").select("doc_id", "dataset", "kind", "split", "source_id", "license", "redistribution")


def p30_redact(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.select("conv_id", "turn", redact("text", "on").alias("text"))


# -- joins


def _run(spark, sf):
    """Cases with source digests, generation records, and payloads (with copies)."""
    cases = fixtures.cases(spark, sf).selectExpr("case_id", "uid", "sha2(cast(source_text as binary), 256) as source_sha256")
    generation = runlog.read_generation(spark, _generation_log(spark, sf)).withColumnRenamed("id", "case_id")
    texts = fixtures.cases(spark, sf).selectExpr("explode(array(source_text, target_text)) as text")
    return cases, generation, texts.selectExpr("sha2(cast(text as binary), 256) as sha256", "octet_length(text) as size_bytes")


def j01_join_runs(spark, sf):
    """Cases with their generation record and payload sizes."""
    return runs.join_runs(*_run(spark, sf))


def j01_run_violations(spark, sf):
    """Records taken away, doubled and of unknown cases; payloads of some digests are gone."""
    cases, generation, payload = _run(spark, sf)
    number = cases.select("case_id", "uid")
    planted = generation.join(number, "case_id").filter("uid % 31 <> 0")
    copies = "if(uid % 37 = 0, array(case_id, case_id), if(uid % 41 = 0, array(case_id, concat('x', case_id)), array(case_id)))"
    records = planted.selectExpr(f"explode({copies}) as case_id", "status", "audio_sha256")
    return runs.run_violations(cases, records, payload.filter("sha256 not like '0%'"))


def j02_attach_groups(spark, sf):
    results = fixtures.cases(spark, sf).select("case_id", "similarity")
    groups = read(spark, sf).select("case_id", case_ops.category().alias("category"), "shard")
    return rounded(results.join(groups, "case_id", "left"))


def _ledger_rows(spark, sf):
    """One ledger row per content, for the documents that carry a label."""
    ledger = fixtures.ledger(spark, sf).filter("quality is not null")
    return ledger.groupBy(F.col("audio_sha256").alias("asset_id")).agg(F.max("decision").alias("decision"))


def j08_join_ledger(spark, sf):
    uses = fixtures.assets(spark, sf).select("case_id", "asset_id")
    return provenance.join_ledger(uses, _ledger_rows(spark, sf)).groupBy("decision").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


def j08_ledger_gaps(spark, sf):
    uses = fixtures.assets(spark, sf).select("asset_id")
    return provenance.unmatched(uses, _ledger_rows(spark, sf).select("asset_id"), "asset_id", "no ledger row", "unused ledger row")


def j09_asset_dependencies(spark, sf):
    """Every third document is generated from the voice of an earlier one, some of which are absent."""
    refs = "if(doc_id % 3 = 2, concat('d', cast(doc_id * 3 div 2 as bigint)), null)"
    assets = fixtures.documents(spark, sf).selectExpr("concat('d', doc_id) as asset_id", f"{refs} as reference_asset_id")
    return provenance.asset_dependencies(assets).select("asset_id", "stage")


def j09_asset_stages(spark, sf):
    """Chains as long as the ones at the end of a number in binary; references to nothing, a planted cycle and a way into it."""
    reference = """case when doc_id in (4, 8) then doc_id + 4 when doc_id in (12, 20) then 4 when doc_id % 7 = 0 then -doc_id - 1
        when doc_id % 2 = 1 then doc_id div 2 end"""
    assets = fixtures.documents(spark, sf).selectExpr(
        "concat('d', doc_id) as asset_id", f"concat('d', {reference}) as reference_asset_id",
        "if(doc_id % 2 = 1, get(array('qwen3_tts', 'indextts2', 'voxcpm2', 'mimo_audio'), cast(doc_id % 5 as int)), null) as provider",
    )
    return stages.asset_stages(assets)


def _requests(spark, sf):
    return requests.plan_requests(fixtures.cases(spark, sf))


def _request_keys(spark, sf):
    """Keys of the distinct requests, written once as bytes: each use of the plan would read every instruction again."""
    path = scratch(spark)
    _requests(spark, sf)[0].select(F.unhex("key").alias("key")).write.parquet(path)
    return spark.read.parquet(path).select(F.lower(F.hex("key")).alias("key"))


def j10_cache_split(spark, sf):
    keys = _request_keys(spark, sf)
    status = "get(array('ok', 'unsupported', 'pending', 'error'), cast(conv(substring(key, 1, 1), 16, 10) as int) % 4)"
    cache = keys.selectExpr("key", f"{status} as status").filter("substring(key, 2, 1) <= '7'")
    hits, pending = requests.split_cached(keys, cache)
    return hits.select("key", "status").unionByName(pending.select("key", F.lit("pending").alias("status")))


def j10_identity_split(spark, sf):
    """Two versions of a model: the first answered half of the requests, the second a quarter."""
    keys = _request_keys(spark, sf)
    one = keys.filter("substring(key, 1, 1) <= '7'").selectExpr("key", "'ok' as status", "'planner@1' as identity")
    two = keys.filter("substring(key, 2, 1) <= '3'").selectExpr("key", "if(substring(key, 3, 1) = '0', 'pending', 'error') as status", "'planner@2' as identity")
    split = [requests.split_cached(keys, one.unionByName(two), i) for i in ("planner@1", "planner@2")]
    parts = [
        hits.select(F.lit(f"planner@{n}").alias("identity"), "key", "status").unionByName(rest.select(F.lit(f"planner@{n}").alias("identity"), "key", F.lit("pending").alias("status")))
        for n, (hits, rest) in enumerate(split, 1)
    ]
    return parts[0].unionByName(parts[1])


def j14_plan_requests(spark, sf):
    return _requests(spark, sf)[1]


def _contract_tables(spark, sf):
    base = fixtures.cases(spark, sf).selectExpr("case_id", "uid", "language", "instruction_xml", "sha2(cast(source_text as binary), 256) as sha256", "cast(uid % 5 as string) as alignment")
    actual = base.filter("uid % 41 <> 0").selectExpr(
        "case_id", "uid", "if(uid % 37 = 0, 'zh', language) as language", "instruction_xml", "if(uid % 31 = 0, 'changed', sha256) as sha256", "if(uid % 29 = 0 or uid % 31 = 0, 'new', alignment) as alignment"
    )
    return base, actual


def j11_diff_contract(spark, sf):
    return provenance.diff_contract(*_contract_tables(spark, sf), ["language", "instruction_xml"])


def j12_compare_fingerprints(spark, sf):
    docs = fixtures.assets(spark, sf).selectExpr("case_id as asset_id", "doc_id", "kind", "asset_id as sha256")
    other = docs.filter("doc_id % 43 <> 0").selectExpr("asset_id", "if(doc_id % 5 = 0, 'other', sha256) as sha256")
    return provenance.compare_fingerprints(docs, other)


def _refreshed(spark, sf):
    cases = fixtures.assets(spark, sf).selectExpr("case_id", "asset_id", "asset_id as aligned_sha256", "'stored' as alignment")
    assets = provenance.distinct_assets(fixtures.assets(spark, sf))
    records = assets.selectExpr("asset_id", "if(substring(asset_id, 1, 1) < '4', concat(asset_id, '-new'), asset_id) as sha256")
    return provenance.refresh_alignments(cases, records, lambda df: df.selectExpr("asset_id", "concat('aligned ', substring(sha256, 1, 8)) as alignment"))


def j13_refresh_alignments(spark, sf):
    return _refreshed(spark, sf).select("case_id", "alignment", "alignment_source")


def j15_unused_assets(spark, sf):
    used = fixtures.assets(spark, sf).filter("doc_id % 4 <> 0").select("asset_id")
    declared = fixtures.assets(spark, sf).filter("doc_id % 5 <> 0").select("asset_id")
    return provenance.unmatched(declared, used, "asset_id", "unused asset", "no recipe")


# -- aggregates, windows, order, sets


def a12_inventory_digest(spark, sf):
    return provenance.inventory_digest(_inventory(spark, sf))


def a12_tree_digest(spark, sf):
    inventory = _inventory(spark, sf)
    return provenance.tree_digest(inventory, "asset_id", provenance.canonical_json("asset_id", "sha256", "size_bytes"))


def a13_request_counts(spark, sf):
    return requests.request_counts(*_requests(spark, sf))


def a14_recipe_counts(spark, sf):
    return provenance.recipe_counts(fixtures.assets(spark, sf))


def a15_alignment_counts(spark, sf):
    return provenance.alignment_counts(_refreshed(spark, sf))


def a16_source_rollup(spark, sf):
    return provenance.source_rollup(provenance.with_origin(_records(spark, sf), "own"))


def a17_cases_per_asset(spark, sf):
    return provenance.cases_per_asset(fixtures.assets(spark, sf)).select("asset_id", "ord", "case_id")


def a19_cache_progress(spark, sf):
    status = requests.terminal_status(fixtures.attempts(spark, sf))
    return requests.cache_progress(status.withColumn("reused", F.col("key") % 3 == 0))


def w02_number_attempts(spark, sf):
    return _numbered(spark, sf).select("key", "number", "event_id", "status", "previous_status")


def w03_terminal_status(spark, sf):
    return requests.terminal_status(fixtures.attempts(spark, sf))


def _trace(spark, sf):
    """Steps of chained runs: some inputs are wrong and some steps failed."""
    steps = fixtures.cases(spark, sf).select("case_id", "uid", F.explode(plan_instructions("instruction_xml")).alias("s")).select("case_id", "uid", "s.*")
    return steps.selectExpr(
        "case_id", "step", "if(uid % 10 = 0, 'wrong', sha2(cast(source_text as binary), 256)) as input_sha256",
        "sha2(cast(target_text as binary), 256) as output_sha256", "if(uid % 15 = 0 and step = 0, 'error', 'ok') as status",
    )


def w04_step_lineage(spark, sf):
    return requests.step_lineage(_trace(spark, sf))


def t01_canonical_order(spark, sf):
    return quality.canonical_order(_inventory(spark, sf), "asset_id")


def t02_order_operations(spark, sf):
    return case_ops.order_operations(case_ops.explode_operations(read(spark, sf))).select("case_id", "src_start", "op_index", "kind")


def t03_sample_violations(spark, sf):
    return quality.sample_violations(quality.check_unique(fixtures.assets(spark, sf), "asset_id"))


def t04_top1(spark, sf):
    rows = fixtures.assets(spark, sf).select("asset_id", "size_bytes", "doc_id", "case_id")
    return quality.top1(rows, ["asset_id"], ["size_bytes", "doc_id"])


def _key_sets(spark, sf):
    docs = fixtures.assets(spark, sf)
    return docs.filter("doc_id % 13 <> 0").select("asset_id"), docs.filter("doc_id % 17 <> 0").select("asset_id")


def x01_same_keys(spark, sf):
    return quality.assert_same_keys(*_key_sets(spark, sf), "asset_id")


def x02_key_diff(spark, sf):
    diff = quality.key_diff(*_key_sets(spark, sf), "asset_id")
    return diff.groupBy("side").agg(F.count("*").alias("n"), F.min("asset_id").alias("first_key"))


def x03_union_requests(spark, sf):
    return _requests(spark, sf)[0].select("key", "source_text", "language")


def x04_same_order(spark, sf):
    """Every hundredth entry is moved behind the list, to places that only moved entries have at any size."""
    a = fixtures.cases(spark, sf).selectExpr("named_struct('moved', false, 'at', uid) as ord", "case_id")
    b = a.selectExpr("named_struct('moved', ord.at % 100 = 7, 'at', ord.at) as ord", "if(ord.at % 97 = 5, concat(case_id, 'x'), case_id) as case_id")
    places = quality.assert_same_order(a, b, "case_id")
    return places.selectExpr("if(ord.moved, ord.at + 500000000, ord.at) as ord", "expected", "found")


# -- contract checks


def _raw_cases(spark, sf):
    """Case documents as text; some miss a field, some have one too many, some repeat a key."""
    return fixtures.cases(spark, sf).selectExpr(
        "case_id as key",
        """concat('{"id":"', case_id, '","language":"', language, '","source_audio":{"asset_id":"a","path":"p"', if(uid % 19 = 0, '', ',"sha256":"s"'),
          if(uid % 23 = 0, ',"path":"q"', ''), '},"instruction_xml":"x"', if(uid % 17 = 0, ',"extra":1', ''), if(uid % 29 = 0, ',"id":"again"', ''),
          if(uid % 13 = 0, '', ',"annotations":{}'), '}') as json""",
    )


def c01_fields(spark, sf):
    return quality.check_fields(_raw_cases(spark, sf))


def c02_duplicate_keys(spark, sf):
    return quality.check_duplicate_keys(_raw_cases(spark, sf))


def _raw_manifests(spark, sf):
    """A manifest per document as text, with unknown, missing and repeated keys at each level."""
    segment = """concat('{"word":"', w, '","start":', i, if(uid % 97 = 0 and i = 0, ',"start":7', ''), if(uid % 109 = 0 and i = n - 1, '', concat(',"end":', i + 1)), '}')"""
    case = f"""concat('{{"id":"', case_id, '","language":"', language, '","source_audio":{{"asset_id":"a","path":"p","sha256":"s"', if(uid % 89 = 0, ',"size":1', ''),
        '}},"instruction_xml":"x","annotations":{{"source_alignment":{{"audio_sha256":"s"', if(uid % 103 = 0, '', ',"text_sha256":"t"'), ',"segments":[',
        array_join(transform(tok, (w, i) -> {segment}), ','), ']}}', if(uid % 101 = 0, ',"note":{{"a b":1,"a b":2}}', ''), '}}', if(uid % 107 = 0, ',"\\\\u0069d":"again"', ''), '}}')"""
    cases = fixtures.cases(spark, sf).select("doc_id", "utt", F.expr(case).alias("case"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt", "case"))), lambda c: c["case"]), ",")
    head = """concat('{"category":"text","shard":"easy"', if(doc_id % 13 = 0, ',"shard":"hard"', ''), if(doc_id % 17 = 0, ',"extra":[]', ''), ',"audio_assets":{},"cases":[')"""
    return cases.groupBy("doc_id").agg(listed.alias("cases")).select(F.col("doc_id").alias("key"), F.concat(F.expr(head), "cases", F.lit("]}")).alias("json"))


def c02_every_level(spark, sf):
    """Both checks of raw manifests: field sets (C01) and repeated keys (C02), with the path of each violation."""
    return manifest_fields.check_manifests(_raw_manifests(spark, sf))


def c03_unique(spark, sf):
    return quality.check_unique(fixtures.assets(spark, sf), "asset_id")


def c04_patterns(spark, sf):
    faulty = fixtures.cases(spark, sf).selectExpr(
        "if(uid % 19 = 0, concat('-', case_id), case_id) as case_id", "if(uid % 23 = 0, 'ABC', sha2(cast(source_text as binary), 256)) as sha256",
        "case when uid % 17 = 0 then '/a' when uid % 29 = 0 then 'a/../b' else concat('audio/', case_id) end as path",
    )
    return quality.check_patterns(faulty)


def c05_enums(spark, sf):
    rows = read(spark, sf).withColumn("category", F.expr("if(uid % 31 = 0, 'other', 'text')"))
    docs = fixtures.documents(spark, sf).select("doc_id", "lang")
    return quality.check_enums(rows.join(docs, "doc_id").withColumn("language", F.col("lang")))


def c06_alignment(spark, sf):
    faulty = read(spark, sf).selectExpr(
        "case_id", "parsed.source_text", "source_duration as duration", "tok as expected",
        """transform(source_units, (u, i) -> named_struct('word', if((uid + i) % 53 = 0, 'x', u.word), 'start', if((uid + i) % 59 = 0, 0D, u.start), 'end', u.end)) as units""",
        "sha2(cast(if(uid % 61 = 0, 'x', parsed.source_text) as binary), 256) as text_sha256", "if(uid % 67 = 0, 'x', 'y') as aligned_sha256", "'y' as sha256",
    )
    return quality.check_alignment(faulty)


def c07_error_counts(spark, sf):
    counts = """named_struct('substitutions', cast(uid % 5 as int), 'deletions', cast(uid % 3 as int) - if(uid % 71 = 0, 9, 0), 'insertions', cast(uid % 2 as int), 'hits', n,
        'ref_length', n + cast(uid % 5 as int) + cast(uid % 3 as int) + if(uid % 73 = 0, 1, 0), 'hyp_length', n, 'error_rate',
        (uid % 5 + uid % 3 + uid % 2) / (n + uid % 5 + uid % 3) + if(uid % 79 = 0, 0.1D, 0D))"""
    return quality.check_error_counts(fixtures.cases(spark, sf).withColumn("wer", F.expr(counts)))


def c08_ratio_stats(spark, sf):
    stats = "named_struct('distance', double(if(uid % 31 = 0, -1, uid % 7)), 'normalizer', double(if(uid % 37 = 0, 0, 5)))"
    return quality.check_ratio_stats(fixtures.cases(spark, sf).withColumn("wdtw_dur", F.expr(stats)), "wdtw_dur")


def c09_outcomes(spark, sf):
    parts = "if(uid % 31 = 0, filter(parsed.ops, o -> false), parsed.ops)"
    parts = f"transform({parts}, o -> named_struct('executed', if(uid % 37 = 0, null, true), 'success', o.kind <> 'ins'))"
    return quality.check_outcomes(read(spark, sf).withColumn("components", F.expr(parts)))


def c10_version(spark, sf):
    rows = fixtures.cases(spark, sf).withColumn("protocol_version", F.expr("case when uid % 41 = 0 then '2' when uid % 43 = 0 then null else '1' end"))
    return quality.check_version(rows, "1")


def c11_status(spark, sf):
    rows = fixtures.cases(spark, sf).withColumn("status", F.expr("if(uid % 47 = 0, 'running', status)"))
    return quality.check_status(rows, KNOWN_STATUSES)


def c11_evaluation_gate(spark, sf):
    """All that keeps evaluation rows from being pooled, in one table."""
    rows = fixtures.cases(spark, sf).select(
        F.expr("if(uid % 53 = 0, array(case_id, case_id), array(case_id))").alias("case_ids"), F.expr("if(uid % 47 = 0, 'running', status)").alias("status"),
        F.expr("case when uid % 41 = 0 then '2' when uid % 43 = 0 then null else '1' end").alias("protocol_version"),
    )
    return runs.evaluation_violations(rows.withColumn("case_id", F.explode("case_ids")).drop("case_ids"), "1")


def c12_conflicts(spark, sf):
    return quality.check_conflicts(fixtures.assets(spark, sf), "asset_id", "kind", "language", "size_bytes")


def c13_recipes(spark, sf):
    recipe = """case doc_id % 6 when 0 then concat('{"kind":"bundle","path":"p', doc_id, '"}') when 1 then '{"kind":"bundle"}'
        when 2 then concat('{"kind":"generate","provider":"voxcpm2","model_id":"m","seed":', if(doc_id % 4 = 0, '-1', '7'), ',"parameters":{}}')
        when 3 then '{"kind":"generate","provider":"nobody","model_id":"m","seed":1,"parameters":{},"reference_asset_id":"r"}'
        when 4 then '{"kind":"upstream","dataset":"d","split":"s","clip_id":"c","path":"p","sha256":"zz"}' else '{"kind":"unknown"}' end"""
    rows = fixtures.documents(spark, sf).selectExpr("concat('d', doc_id) as asset_id", f"{recipe} as recipe")
    return quality.check_recipes(rows)


def c14_totals(spark, sf):
    counts = provenance.recipe_counts(fixtures.assets(spark, sf))
    return quality.check_totals(counts, "kind", {"bundle": 334, "upstream": 333, "generate": 1, "external": 5})


def c15_payloads(spark, sf):
    found = payloads.read_payloads(spark, sf, "*.parquet")
    inventory = found.filter("path not like 'n%'").withColumn("size_bytes", F.when(F.col("path").startswith("o"), 1).otherwise(F.col("size_bytes")))
    return quality.check_payloads(inventory, found).select("check", "key", "detail")


def _little(value):
    return f"unhex(concat_ws('', transform(array(3, 2, 1, 0), i -> substring(lpad(hex({value}), 8, '0'), i * 2 + 1, 2))))"


def c16_wav_profile(spark, sf):
    """Documents framed as 16-bit mono recordings; every 41st lacks its marker."""
    content = f"""concat(cast(if(doc_id % 41 = 0, 'RIFX', 'RIFF') as binary), {_little('octet_length(text) + 36')}, cast('WAVEfmt ' as binary), {_little('16')}, X'01000100', {_little('16000')},
        {_little('32000')}, X'02001000', cast('data' as binary), {_little('octet_length(text)')}, cast(text as binary))"""
    rows = fixtures.documents(spark, sf).select(F.expr("concat('d', doc_id)").alias("path"), F.expr(content).alias("content"))
    return quality.wav_profile(rows).drop("encoding")


def c16_chunk_walk(spark, sf):
    """Documents framed as recordings in six ways: plain, a note first, data first, extensible, truncated, no format."""
    size = "octet_length(text)"
    form = f"cast('fmt ' as binary), {_little('16')}, X'01000100', {_little('16000')}, {_little('32000')}, X'02001000'"
    longer = f"cast('fmt ' as binary), {_little('40')}, X'FEFF0100', {_little('16000')}, {_little('32000')}, X'02001000', X'1600100004000000', X'0300000000001000800000AA00389B71'"
    data = f"cast('data' as binary), {_little(size)}, cast(text as binary)"
    note = f"cast('LIST' as binary), {_little('3')}, X'61626300'"
    ways = (
        f"{form}, {data}",
        f"{note}, {form}, {data}",
        f"{data}, if({size} % 2 = 1, X'00', X''), {form}",
        f"{longer}, cast('fact' as binary), {_little('4')}, {_little(size)}, {data}",
        f"{form}, cast('data' as binary), {_little(size + ' + 10')}, cast(text as binary)",
        data,
    )
    branches = " ".join(f"when {n} then concat({way})" for n, way in enumerate(ways))
    content = f"concat(cast('RIFF' as binary), {_little('0')}, cast('WAVE' as binary), case doc_id % 6 {branches} end)"
    rows = fixtures.documents(spark, sf).select(F.expr("concat('d', doc_id)").alias("path"), F.expr(content).alias("content"))
    return quality.wav_profile(rows)


# -- streams


def _event_log(spark, sf):
    """The event table as a log in several files, every seventh row written twice."""
    path = scratch(spark)
    rows = fixtures.attempts(spark, sf)
    rows.unionByName(rows.filter("event_id % 7 = 0")).repartition(4).write.json(path)
    schema = "key bigint, event_id bigint, ts timestamp, status string, error string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(path)


def r01_stream_runlog(spark, sf):
    table = scratch(spark)
    logs.stream_runlog(_event_log(spark, sf), "event_id", table, scratch(spark))
    return spark.read.parquet(table).select("event_id", "key", "status")


def r01_duplicate_ids(spark, sf):
    table, wrong = scratch(spark), scratch(spark)
    logs.stream_runlog(_event_log(spark, sf), "event_id", table, scratch(spark), wrong)
    return spark.read.parquet(wrong).select("check", "key", "detail")


def r02_stream_progress(spark, sf):
    table = scratch(spark)
    logs.stream_progress(_event_log(spark, sf), table, scratch(spark))
    return runlog.read_summary(spark, table)


def _ordered_stream(spark, sf):
    """Attempts in arrival order: one file per stretch of time, read one at a time."""
    path = scratch(spark)
    fixtures.attempts(spark, sf).repartitionByRange(3, "ts", "event_id").write.json(path)
    schema = "key bigint, event_id bigint, ts timestamp, status string, error string"
    return spark.readStream.schema(schema).json(path)


def r03_stream_attempts(spark, sf):
    table = scratch(spark)
    logs.stream_attempts(_ordered_stream(spark, sf), table, scratch(spark))
    return logs.latest_states(spark, table)


LIMIT, DELAY = timedelta(hours=6), timedelta(hours=2)


def _daily(log):
    """A request for each user and day, so that many attempts are under way when the log ends."""
    return log.withColumn("key", F.expr("key * 100 + day(ts)"))


def r03_timed_attempts(spark, sf):
    log = _daily(fixtures.attempts(spark, sf))
    return attempt_times.timed_status(log, LIMIT, attempt_times.watermark(log, DELAY))


def r03_attempt_spans(spark, sf):
    log = _daily(fixtures.attempts(spark, sf))
    spans = attempt_times.attempt_spans(log, LIMIT, attempt_times.watermark(log, DELAY))
    return spans.select("key", "number", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "status")


def r03_stream_timed_attempts(spark, sf):
    table = scratch(spark)
    attempts.stream_timed_attempts(_daily(_ordered_stream(spark, sf)), table, scratch(spark), LIMIT, DELAY)
    return attempts.latest_timed_states(spark, table)


ANSWERS = schemas.struct(key=schemas.LONG, answer=schemas.STRING)


def _fill(spark, sf, cache, identity=""):
    answer = lambda df: df.selectExpr("key", f"concat('answer ', key, '{identity}') as answer")
    logs.stream_fill_cache(_event_log(spark, sf).select("key"), "key", cache, ANSWERS, answer, scratch(spark), identity)


def r04_stream_fill_cache(spark, sf):
    path = scratch(spark)
    _fill(spark, sf, path)
    return cache.read_cache(spark, path, ANSWERS, "").select("key", "answer")


def r04_two_versions(spark, sf):
    """Two versions fill one cache, one of them twice; buckets are then put together."""
    path = scratch(spark)
    for identity in ("@1", "@2", "@1"):
        _fill(spark, sf, path, identity)
    cache.compact(spark, path, ANSWERS, "key", "@1", files=1)
    both = [cache.read_cache(spark, path, ANSWERS, i).select(F.lit(i).alias("identity"), "key", "answer") for i in ("@1", "@2")]
    return both[0].unionByName(both[1])


# -- plug-ins


def _load_length_scorer():
    def run(batch):
        return batch.assign(score=batch["text"].str.len() / 100.0)[["doc_id", "score"]]

    return run


def u01_scorer(spark, sf):
    plugins.register_scorer("length", _load_length_scorer, schemas.struct(doc_id=schemas.LONG, score=schemas.DOUBLE), "length-1")
    return rounded(plugins.score(fixtures.documents(spark, sf).select("doc_id", "text"), "length"))


def _stand_in(batch):
    """A generator that fails where the input ends in 0 and otherwise extends it."""
    failed = batch["input_sha256"].str.endswith("0")
    return batch.assign(
        output_sha256=(batch["input_sha256"] + "a").where(~failed), error=failed.map({True: "refused", False: None})
    )


def u02_generator(spark, sf):
    cases = fixtures.cases(spark, sf)
    steps = case_ops.sequential_plan(cases)
    sources = cases.selectExpr("case_id", "sha2(cast(source_text as binary), 256) as input_sha256")
    return plugins.apply_generator(steps, sources, _stand_in).groupBy("step", "status").agg(F.count("*").alias("n"))


def u03_planner(spark, sf):
    plugins.register_planner("sequential", case_ops.sequential_plan)
    plugins.register_planner("one_take", lambda cases: case_ops.one_take_plan(case_ops.read_instructions(cases)))
    cases = fixtures.cases(spark, sf)
    both = plugins.plan(cases, "sequential").select(F.lit("sequential").alias("planner"), "step").unionByName(plugins.plan(cases, "one_take").select(F.lit("one_take").alias("planner"), "step"))
    return both.groupBy("planner", "step").agg(F.count("*").alias("n"))


def u05_identity(spark, sf):
    cases = fixtures.cases(spark, sf).selectExpr("case_id", "sha2(cast(source_text as binary), 256) as sha256")
    return plugins.identity(cases)
