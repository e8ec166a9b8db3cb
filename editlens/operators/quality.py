"""Data contract as violation tables (check, key, detail); a gate fails on any row."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.functions.text import text_sha

EXTENSIBLE = 0xFFFE  # fixed value: the format tag whose real encoding follows in a longer header

# Field sets, enumerations and patterns of the contract.
CASE_FIELDS = ("annotations", "id", "instruction_xml", "language", "source_audio")
AUDIO_FIELDS = ("asset_id", "path", "sha256")
LANGUAGES = ("en", "zh")
CATEGORIES = ("text", "emotion", "prosody", "pause", "compositional")
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
DIGEST = r"^[0-9a-f]{64}$"
RECIPE_FIELDS = {
    "bundle": (("kind", "path"), ()),
    "upstream": (("kind", "dataset", "split", "clip_id", "path", "sha256"), ()),
    "generate": (("kind", "provider", "model_id", "seed", "parameters"), ("reference_asset_id",)),
}
RECIPE_PROVIDERS = ("qwen3_tts", "indextts2", "voxcpm2", "mimo_audio")


def violations(df: DataFrame, check: str, key: str, *rules: tuple[Column, str]) -> DataFrame:
    """One row per broken rule; all rules are tested in a single pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(detail)) for bad, detail in rules]))
    return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.explode(broken).alias("detail"))


def gate(*tables: DataFrame) -> DataFrame:
    """All violations; fails when there is any, naming the first few."""
    found = reduce(DataFrame.unionByName, tables)
    first = sample_violations(found).collect()
    if first:
        raise ValueError("; ".join(f"{r['check']} {r['key']}: {r['detail']}" for r in first))
    return found


def sample_violations(df: DataFrame, k: int = 5) -> DataFrame:
    """The first k by check and key, for a message."""
    return df.orderBy("check", "key", "detail").limit(k)


def _exact_keys(json: Column, wanted: tuple[str, ...]) -> Column:
    keys = F.json_object_keys(json)
    want = F.array(*[F.lit(k) for k in wanted])
    return (F.size(F.array_except(keys, want)) > 0) | (F.size(F.array_except(want, keys)) > 0)


def check_fields(raw: DataFrame) -> DataFrame:
    """Exact field sets of raw case documents (``key``, ``json``), nested audio object included."""
    audio = F.get_json_object("json", "$.source_audio")
    return violations(
        raw, "C01", "key", (_exact_keys(F.col("json"), CASE_FIELDS), "case fields"), (_exact_keys(audio, AUDIO_FIELDS), "audio fields")
    )


def check_duplicate_keys(raw: DataFrame) -> DataFrame:
    """The same key twice in one object; a schema read would keep the last one silently."""
    twice = lambda j: F.size(F.json_object_keys(j)) > F.size(F.array_distinct(F.json_object_keys(j)))
    nested = F.coalesce(twice(F.get_json_object("json", "$.source_audio")), F.lit(False))
    return violations(raw, "C02", "key", (twice(F.col("json")) | nested, "duplicate key"))


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row; counted map-side, so a hot key costs no more than others."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.select(F.lit("C03").alias("check"), F.concat_ws("|", *key).alias("key"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def check_patterns(df: DataFrame) -> DataFrame:
    """Identifier, digest and relative path of each case."""
    path = F.col("path")
    unsafe = (F.length(path) == 0) | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)")
    return violations(
        df, "C04", "case_id", (~F.col("case_id").rlike(IDENTIFIER), "identifier"), (~F.col("sha256").rlike(DIGEST), "digest"), (unsafe, "path")
    )


def check_enums(df: DataFrame) -> DataFrame:
    return violations(
        df, "C05", "case_id", (~F.col("language").isin(*LANGUAGES), "language"), (~F.col("category").isin(*CATEGORIES), "category")
    )


def check_alignment(cases: DataFrame) -> DataFrame:
    """Words, times, order and digests of a case's alignment (``units``, ``expected``, ``duration``)."""
    bad = lambda cond: F.expr(f"exists(units, u -> {cond})")
    order = F.expr(
        "exists(sequence(1, greatest(1, size(units) - 1)), i -> size(units) > 1 and (units[i].start < units[i - 1].start or units[i].end < units[i - 1].end))"
    )
    words = F.expr("not expected <=> transform(units, u -> u.word)")
    return violations(
        cases,
        "C06",
        "case_id",
        (bad("isnan(u.start) or isnan(u.end) or u.start < 0 or u.end < u.start or u.end > duration"), "time"),
        (order, "order"),
        (words, "words"),
        (F.col("text_sha256") != text_sha("source_text"), "text digest"),
        (F.col("aligned_sha256") != F.col("sha256"), "payload digest"),
    )


def check_error_counts(df: DataFrame, struct: str = "wer") -> DataFrame:
    """Counts are not negative, add up, and agree with the stored rate."""
    s = lambda f: F.col(f"{struct}.{f}")
    negative = F.least(*[s(f) for f in ("substitutions", "deletions", "insertions", "hits", "ref_length", "hyp_length")]) < 0
    sums = s("hits") + s("substitutions") + s("deletions") != s("ref_length")
    rate = F.try_divide(s("substitutions") + s("deletions") + s("insertions"), s("ref_length"))
    close = F.abs(s("error_rate") - rate) <= F.greatest(1e-9 * F.greatest(F.abs(s("error_rate")), F.abs(rate)), F.lit(1e-12))
    disagree = F.when(s("ref_length") > 0, ~F.coalesce(close, F.lit(False))).otherwise(False)
    return violations(df, "C07", "case_id", (negative, "negative count"), (sums, "counts do not add up"), (disagree, "rate disagrees"))


def check_ratio_stats(df: DataFrame, struct: str) -> DataFrame:
    d, n = F.col(f"{struct}.distance"), F.col(f"{struct}.normalizer")
    return violations(df, "C08", "case_id", ((d < 0) | (n < 0), "negative"), ((n == 0) & (d != 0), "distance without normaliser"))


def check_outcomes(evaluation: DataFrame) -> DataFrame:
    """Every case has operations, each with both outcomes."""
    empty = F.size("components") == 0
    null = F.expr("exists(components, c -> c.executed is null or c.success is null)")
    return violations(evaluation, "C09", "case_id", (empty, "no operation"), (null, "missing outcome"))


def check_version(df: DataFrame, version: str) -> DataFrame:
    return violations(df, "C10", "case_id", (~F.col("protocol_version").eqNullSafe(F.lit(version)), "protocol version"))


def check_status(df: DataFrame, known: tuple[str, ...]) -> DataFrame:
    return violations(df, "C11", "case_id", (~F.col("status").isin(*known), "status"))


def check_conflicts(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """Keys defined in more than one way: least and greatest definition differ.

    Both are partial aggregates, so copies of one asset collapse map-side.
    """
    definition = F.struct(*fields)
    ends = df.groupBy(key).agg(F.min(definition).alias("low"), F.max(definition).alias("high"))
    return ends.filter("not low <=> high").select(F.lit("C12").alias("check"), F.col(key).alias("key"), F.lit("conflicting definitions").alias("detail"))


def check_recipes(assets: DataFrame) -> DataFrame:
    """Fields, provider, seed and digest of a recipe (``asset_id``, ``recipe`` as JSON text)."""
    field = lambda name: F.get_json_object("recipe", f"$.{name}")
    kind = field("kind")
    keys = F.json_object_keys("recipe")
    array = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    wrong = F.lit(True)
    for name, (required, optional) in RECIPE_FIELDS.items():
        bad = (F.size(F.array_except(array(required), keys)) > 0) | (F.size(F.array_except(keys, array((*required, *optional)))) > 0)
        wrong = F.when(kind == name, bad).otherwise(wrong)
    generated = kind == "generate"
    seed = field("seed").rlike(r"^\d+$")
    return violations(
        assets,
        "C13",
        "asset_id",
        (wrong, "fields"),
        (F.coalesce(generated & ~F.col("asset_id").rlike(IDENTIFIER), F.lit(False)), "identifier"),
        (F.coalesce(generated & ~field("provider").isin(*RECIPE_PROVIDERS), F.lit(False)), "provider"),
        (F.coalesce(generated & ~seed, F.lit(False)), "seed"),
        (F.coalesce((kind == "upstream") & ~field("sha256").rlike(DIGEST), F.lit(False)), "digest"),
    )


def check_totals(counts: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """Declared totals that the table does not meet; ``counts`` has key and n."""
    spark = counts.sparkSession
    want = spark.createDataFrame([(k, v) for k, v in expected.items()], f"{key} string, expected long")
    both = counts.join(want, key, "full_outer").filter("not n <=> expected")
    detail = F.concat_ws(" ", F.lit("found"), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit("expected"), F.coalesce("expected", F.lit(0)).cast("string"))
    return both.select(F.lit("C14").alias("check"), F.col(key).alias("key"), detail.alias("detail"))


def check_payloads(inventory: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded payloads against those present: missing, changed, resized, unexpected."""
    a = inventory.select("path", F.col("sha256").alias("sha_a"), F.col("size_bytes").alias("size_a"))
    b = found.select("path", F.col("sha256").alias("sha_b"), F.col("size_bytes").alias("size_b"))
    both = a.join(b, "path", "full_outer")
    detail = (
        F.when(F.col("sha_b").isNull(), "missing")
        .when(F.col("sha_a").isNull(), "unexpected")
        .when(F.col("size_a") != F.col("size_b"), "size")
        .when(F.col("sha_a") != F.col("sha_b"), "digest")
    )
    return both.select(F.lit("C15").alias("check"), F.col("path").alias("key"), detail.alias("detail")).filter("detail is not null")


def _chunk_walk(contents: pd.Series) -> pd.DataFrame:
    """Format and data chunk of each payload, found by following the chunk sizes."""
    rows = []
    for content in contents:
        size = 0 if content is None else len(content)
        form, data, at = None, None, 12
        marked = size >= 12 and content[:4] == b"RIFF" and content[8:12] == b"WAVE"
        sound = size >= 12
        while sound and at < size:
            length = int.from_bytes(content[at + 4 : at + 8], "little")
            end = at + 8 + length
            name = content[at : at + 4]
            # The last chunk may lack its pad byte; nothing may lack more.
            sound = at + 8 <= size and end <= size
            if sound and name == b"fmt " and form is None and length >= 16:
                form = struct.unpack_from("<HHIIHH", content, at + 8)
                if form[0] == EXTENSIBLE:
                    sound = length >= 40
                    form = (int.from_bytes(content[at + 32 : at + 34], "little") if sound else 0, *form[1:])
            elif sound and name == b"data" and data is None:
                data = length
            at = end + length % 2
        known = form or (None,) * 6
        rows.append((known[0], known[1], known[2], known[4], data, marked and sound and form is not None and data is not None))
    return pd.DataFrame(rows, columns=["encoding", "channels", "sample_rate", "block", "data_bytes", "sound"]).astype(
        {"encoding": "Int64", "channels": "Int64", "sample_rate": "Int64", "block": "Int64", "data_bytes": "Int64"}
    )


def wav_profile(payloads: DataFrame) -> DataFrame:
    """Channels, rate, data size and length from a payload's chunks; nothing is decoded.

    Chunks may stand in any order, with pad bytes and with chunks of other names between them; an extensible format gives
    its sub-format as ``encoding``. ``valid`` is false for files of another kind, for a missing, empty or truncated format or data
    chunk, for a chunk that reaches beyond the file, and for a null payload; what was found until then is given. The
    first chunk of a name counts.
    """
    walk = F.pandas_udf(_chunk_walk, "encoding long, channels long, sample_rate long, block long, data_bytes long, sound boolean")
    head = payloads.select("path", walk("content").alias("w")).select("path", "w.*")
    valid = F.col("sound") & (F.col("channels") > 0) & (F.col("sample_rate") > 0) & (F.col("block") > 0) & (F.col("data_bytes") > 0)
    return head.select(
        "path",
        "channels",
        "sample_rate",
        "data_bytes",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(valid, F.col("data_bytes") / (F.col("block") * F.col("sample_rate"))).alias("duration"),
        "encoding",
    )


def assert_same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys missing from either side; empty when the sets are equal."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
    return left.join(right, key, "full_outer").withColumn("side", side).filter("side is not null").select(key, "side")


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Multiset difference in both directions."""
    only = lambda x, y, side: x.select(key).exceptAll(y.select(key)).withColumn("side", F.lit(side))
    return only(a, b, "missing").unionByName(only(b, a, "extra"))


def assert_same_order(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Places (``ord``) at which two ordered id lists differ; no list is gathered."""
    left, right = a.select("ord", F.col(key).alias("expected")), b.select("ord", F.col(key).alias("found"))
    return left.join(right, "ord", "full_outer").filter("not expected <=> found")


def canonical_order(df: DataFrame, *keys: str) -> DataFrame:
    """Global order by the keys (range partitions, sorted inside)."""
    return df.orderBy(*keys)


def top1(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each group by a compound key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")
