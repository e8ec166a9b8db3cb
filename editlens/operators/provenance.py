"""Assets, ledgers and their contracts: projections, joins, digests and diffs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.operators.skew import ordinals, salted_join

# Generator names of ledger rows and the provider each stands for.
PROVIDERS = {
    "indextts2": "indextts2",
    "voxcpm2": "voxcpm2",
    "mimo_audio_instruct": "mimo_audio",
    "qwen3_tts": "qwen3_tts",
}
# Generation settings kept as recipe parameters, by ledger name.
PARAMETERS = {
    "control": "control",
    "preset_speaker": "speaker",
    "emotion_vector": "emotion_vector",
    "emotion_alpha": "emotion_alpha",
    "cfg_value": "cfg_value",
    "inference_timesteps": "inference_timesteps",
    "max_new_tokens": "max_new_tokens",
}
UPSTREAM = "CommonVoice20.0"
# Licence terms of the transcript sources.
LICENCES = (
    ("AISHELL-1", "Apache-2.0", "allowed_with_notice"),
    ("AISHELL3", "Apache-2.0", "allowed_with_notice"),
    ("CommonVoice20.0", "CC0-1.0", "public_domain_dedication"),
    ("Emo-Emilia", "CC-BY-NC-4.0", "noncommercial_with_attribution"),
    ("FLEURS", "CC-BY-4.0", "allowed_with_attribution"),
    ("LibriTTS-R", "CC-BY-4.0", "allowed_with_attribution"),
    ("MLS", "CC-BY-4.0", "allowed_with_attribution"),
    ("WenetSpeech", "CC-BY-4.0", "noncommercial_with_attribution"),
)
OWN_TERMS = ("Apache-2.0", "allowed_with_notice")
#: Hexadecimal digits of the leaves' prefix; changing it changes every digest.
DIGEST_DEPTH = 4


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("record", f"$.{path}", kind)


def derive_recipes(ledger: DataFrame) -> DataFrame:
    """Ledger rows (``audio_sha256``, ``record`` as VARIANT) to recipes; null parameters are dropped."""
    generator = _get("generation.generator")
    names = F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair])
    kind = (
        F.when(generator.isin(*PROVIDERS), "generate")
        .when(_get("source_dataset") == UPSTREAM, "upstream")
        .otherwise("bundle")
    )
    entries = F.array(*[F.struct(F.lit(new).alias("key"), _get(f"generation.{old}").alias("value")) for old, new in PARAMETERS.items()])
    parameters = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    only = lambda k, value: F.when(F.col("kind") == k, value)
    return (
        ledger.withColumn("kind", kind)
        .withColumns(
            {
                "provider": only("generate", names[generator]),
                "model_id": only("generate", _get("generation.model_id")),
                "seed": only("generate", _get("generation.seed", "bigint")),
                "parameters": only("generate", parameters),
                "reference_asset_id": only("generate", _get("generation.reference_voice.audio_sha256")),
                "split": only("upstream", _get("source_split")),
                "clip_id": only("upstream", _get("source_clip_id")),
                "path": only("upstream", _get("source_path")),
                "sha256": only("upstream", _get("source_raw_sha256")),
            }
        )
        .withColumn("path", F.when(F.col("kind") == "bundle", F.concat(F.lit("audio/"), "audio_sha256", F.lit(".wav"))).otherwise(F.col("path")))
        .drop("record")
    )


def with_origin(ledger: DataFrame, own: str) -> DataFrame:
    """Transcript origin and terms; ``transcript.source`` is a name or an object.

    The licence table is a fixed list, so its join is a broadcast of known size.
    """
    spark = ledger.sparkSession
    terms = spark.createDataFrame([*LICENCES, (own, *OWN_TERMS)], "dataset string, license string, redistribution string")
    source = lambda field="": _get(f"rights.transcript.source{field}")
    is_name = F.schema_of_variant(F.variant_get("record", "$.rights.transcript.source", "variant")) == "STRING"
    origin = ledger.withColumns(
        {
            "dataset": F.when(is_name, source()).otherwise(F.coalesce(source(".dataset"), F.lit(own))),
            "kind": F.when(is_name, "dataset_transcript").otherwise(source(".kind")),
            "split": F.when(is_name, _get("source_split")).otherwise(source(".split")),
            "source_id": F.when(is_name, _get("source_clip_id")).otherwise(source(".uid")),
        }
    )
    return origin.join(F.broadcast(terms), "dataset", "left").drop("record")


def distinct_assets(uses: DataFrame, *columns: str) -> DataFrame:
    return uses.select("asset_id", *columns).dropDuplicates(["asset_id"])


def top_definition(uses: DataFrame) -> DataFrame:
    """One row per asset: its least definition, so the choice does not depend on order."""
    rest = [c for c in uses.columns if c not in ("asset_id", "case_id", "doc_id")]
    return uses.groupBy("asset_id").agg(F.min(F.struct(*rest)).alias("d")).select("asset_id", "d.*")


def join_ledger(uses: DataFrame, ledger: DataFrame, key: str = "asset_id") -> DataFrame:
    """Uses with their ledger row; copies of one payload may repeat the key without limit."""
    return salted_join(uses, ledger, key)


def unmatched(left: DataFrame, right: DataFrame, key: str, missing: str, extra: str) -> DataFrame:
    """Keys on one side only, with the reason; both directions."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    gone = a.join(b, key, "left_anti").select(F.lit(missing).alias("reason"), key)
    return gone.unionByName(b.join(a, key, "left_anti").select(F.lit(extra).alias("reason"), key))


def asset_dependencies(assets: DataFrame) -> DataFrame:
    """Each asset with the stage it can be built in; a reference outside the table is dangling."""
    base = assets.select("asset_id", "reference_asset_id")
    known = assets.select(F.col("asset_id").alias("reference_asset_id"), F.lit(True).alias("known"))
    joined = salted_join(base.filter("reference_asset_id is not null"), known, "reference_asset_id", "left")
    status = F.when(F.col("known"), "generate_after").otherwise("dangling")
    free = base.filter("reference_asset_id is null").withColumn("stage", F.lit("independent"))
    return free.unionByName(joined.withColumn("stage", status).drop("known"))


def canonical_json(*names: str) -> Column:
    """Compact JSON of the columns in the given (sorted) order."""
    return F.to_json(F.struct(*names))


def tree_digest(df: DataFrame, key: str, leaf: Column) -> DataFrame:
    """Order-free digest of a table of any size: leaves by hash prefix, then sixteen to one.

    The depth is part of the definition and the same for every table: DIGEST_DEPTH hexadecimal digits, so a leaf holds
    one row in 65,536 and no group sees more than that or sixteen digests. An empty table has no assets and the digest of
    nothing.
    """
    level = df.select(F.sha2(F.col(key).cast("binary"), 256).alias("h"), F.sha2(leaf.cast("binary"), 256).alias("d"), F.lit(1).cast("long").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "d"))), lambda x: x["d"]), "")
    digest = F.sha2(joined.cast("binary"), 256)
    for width in range(DIGEST_DEPTH, 0, -1):
        level = level.groupBy(F.substring("h", 1, width).alias("p")).agg(digest.alias("d"), F.sum("n").alias("n"))
        level = level.withColumnRenamed("p", "h")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assets"), digest.alias("digest"))


def list_digest(df: DataFrame) -> DataFrame:
    """Digest of the canonical JSON list (asset_id, sha256, size_bytes) sorted by id, for exchange with list-based tools.

    The list is one value, so this is only for inventories that the caller knows to be small; ``inventory_digest`` has
    no such limit and never changes to this one.
    """
    row = F.struct("asset_id", "sha256", "size_bytes")
    text = F.to_json(F.array_sort(F.collect_list(row)))
    return df.agg(F.count(F.lit(1)).alias("assets"), F.sha2(text.cast("binary"), 256).alias("digest"))


def inventory_digest(df: DataFrame) -> DataFrame:
    """The tree digest of an asset inventory, one definition at every size."""
    return tree_digest(df, "asset_id", canonical_json("asset_id", "sha256", "size_bytes"))


def diff_contract(canonical: DataFrame, actual: DataFrame, fixed: list[str]) -> DataFrame:
    """Rows of two case tables that break the contract, one reason each.

    Only the payload digest and the alignment may change, the alignment only
    together with the digest.
    """
    a = canonical.select("case_id", F.struct(*fixed).alias("fixed_a"), F.col("sha256").alias("sha_a"), F.col("alignment").alias("align_a"))
    b = actual.select("case_id", F.struct(*fixed).alias("fixed_b"), F.col("sha256").alias("sha_b"), F.col("alignment").alias("align_b"))
    reason = (
        F.when(F.col("fixed_a").isNull(), "extra")
        .when(F.col("fixed_b").isNull(), "missing")
        .when(~F.col("fixed_a").eqNullSafe(F.col("fixed_b")), "fixed field changed")
        .when(F.col("sha_a").eqNullSafe(F.col("sha_b")) & ~F.col("align_a").eqNullSafe(F.col("align_b")), "alignment of unchanged payload changed")
    )
    return a.join(b, "case_id", "full_outer").withColumn("reason", reason).filter("reason is not null").select("case_id", "reason")


def compare_fingerprints(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """Assets whose digest differs: tolerated for generated ones, strict for the rest."""
    b = reference.select("asset_id", F.col("sha256").alias("expected"))
    both = ours.join(b, "asset_id", "full_outer")
    label = (
        F.when(F.col("expected").isNull(), "extra")
        .when(F.col("sha256").isNull(), "missing")
        .when(F.col("kind") == "generate", "generated_mismatch")
        .otherwise("strict_mismatch")
    )
    return both.filter("not sha256 <=> expected").select("asset_id", label.alias("mismatch"))


def refresh_alignments(cases: DataFrame, records: DataFrame, align: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keep alignments of unchanged payloads; recompute one per changed asset and hand it to its cases.

    ``records`` has one row per asset with its present ``sha256``; ``align`` maps
    (asset_id, sha256) rows to (asset_id, alignment).
    """
    joined = salted_join(cases, records, "asset_id")
    changed = joined.filter("aligned_sha256 <> sha256")
    fresh = align(changed.select("asset_id", "sha256").dropDuplicates(["asset_id"]))
    redone = salted_join(changed.drop("alignment"), fresh, "asset_id").withColumn("alignment_source", F.lit("generated"))
    kept = joined.filter("aligned_sha256 = sha256").withColumn("alignment_source", F.lit("reused"))
    return kept.unionByName(redone).withColumn("aligned_sha256", F.col("sha256"))


def alignment_counts(refreshed: DataFrame) -> DataFrame:
    return refreshed.groupBy("alignment_source").agg(F.count(F.lit(1)).alias("n"))


def recipe_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def source_rollup(rows: DataFrame) -> DataFrame:
    """Rows per source and licence, and the total."""
    return rows.rollup("dataset", "license").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).filter("g in (0, 3)").drop("g")


def cases_per_asset(uses: DataFrame) -> DataFrame:
    """Sorted distinct case ids of each asset, one row per id with its place."""
    return ordinals(uses.select("asset_id", "case_id").distinct(), "asset_id", "case_id")


def new_payloads(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Payloads once per digest, without those already stored."""
    return found.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")


def export_bundle(ledger: DataFrame, files: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Files of the ledger rows that may be released, in digest order."""
    selected = ledger.filter(F.col("decision").isin(*allowed)).select("audio_sha256").distinct()
    return selected.join(files, F.col("audio_sha256") == F.col("sha256")).select("sha256", "size_bytes").orderBy("sha256")
