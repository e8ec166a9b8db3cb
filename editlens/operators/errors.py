"""Recognition errors: counts, region-attributed counts and the local window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.functions.sequences import align_both, align_locally, align_tokens
from editlens.functions.text import composed_token_count, er_tokens, mixed_tokens, normalize_er
from editlens.functions.units import let

CONTEXT = 3


def with_error_counts(
    df: DataFrame, reference: str, hypothesis: str, metric: Column, composed: tuple[str | None, str | None] = (None, None)
) -> DataFrame:
    """Add ``wer``: counts and rate of a text pair under the metric; rate null without reference.

    ``composed`` names the NFKC of both texts where it was made before (see ``normalize_er``).
    """
    tokens = (
        _normal(df, reference, hypothesis, composed)
        .withColumn("metric", metric)
        .withColumns({"ref_tokens": er_tokens("ref_norm", "metric"), "hyp_tokens": er_tokens("hyp_norm", "metric")})
        .withColumn("wer_counts", align_tokens("ref_tokens", "hyp_tokens"))
    )
    return tokens.withColumn("wer", with_rate("wer_counts", "metric"))


def _normal(df: DataFrame, reference: str, hypothesis: str, composed: tuple[str | None, str | None]) -> DataFrame:
    return df.withColumns({"ref_norm": normalize_er(reference, composed[0]), "hyp_norm": normalize_er(hypothesis, composed[1])})


def with_rate(counts: str, metric: str) -> Column:
    return F.expr(
        f"""named_struct('error_rate',
          case when {counts}.ref_length > 0
            then ({counts}.substitutions + {counts}.deletions + {counts}.insertions) / {counts}.ref_length
            when {counts}.hyp_length = 0 then 0D end,
          'substitutions', {counts}.substitutions, 'deletions', {counts}.deletions, 'insertions', {counts}.insertions,
          'hits', {counts}.hits, 'ref_length', {counts}.ref_length, 'hyp_length', {counts}.hyp_length, 'metric', {metric})"""
    )


def region_counts(path: str, inside: str) -> str:
    """Errors on the reference positions where ``inside`` holds.

    ``inside`` is a condition on the position ``{p}``. ``path`` has one element
    per position with its op and the insertions before it; the gap at the end of
    the text counts with the last position, so a text splits without remainder.
    """
    n = f"(size({path}) - 1)"
    own = inside.replace("{p}", "e.p")
    gap = inside.replace("{p}", f"least(e.p, {n} - 1)")
    zero = "named_struct('s', 0, 'd', 0, 'h', 0, 'i', 0)"
    step = f"""named_struct('s', k.s + int(e.op = 'S' and {own}), 'd', k.d + int(e.op = 'D' and {own}),
        'h', k.h + int(e.op = 'H' and {own}), 'i', k.i + if(e.ins > 0 and {n} > 0 and {gap}, e.ins, 0))"""
    result = """c -> named_struct('error_rate', coalesce(try_divide(c.s + c.d + c.i, c.s + c.d + c.h), 0D),
        'substitutions', c.s, 'deletions', c.d, 'insertions', c.i, 'hits', c.h,
        'ref_length', c.s + c.d + c.h, 'hyp_length', c.s + c.h + c.i, 'metric', 'mixed')"""
    return f"aggregate({path}, {zero}, (k, e) -> {step}, {result})"


def with_local_errors(df: DataFrame, hypothesis: str, context: int = CONTEXT, composed: str | None = None) -> DataFrame:
    """Counts in mixed units around the text edits, away from them, and per operation.

    Needs ``parsed``. The token bounds of an operation are the numbers of tokens
    of the target text before its two ends. ``composed`` names the NFKC of the
    hypothesis where it was made before.
    """
    tokens = _local_tokens(_normal(df, "parsed.target_text", hypothesis, ("parsed.composed", composed)))
    found = tokens.withColumn("_local", align_locally(*LOCAL, F.lit(context)))
    return found.withColumn("local_errors", _bound("_local")).drop("ref_norm", "hyp_norm", "_ref", "_hyp", "_lo", "_hi", "_local")


LOCAL = ("_ref", "_hyp", "parsed.ops", "_lo", "_hi")


def _bound(local: str) -> Column:
    """The struct as it is; an explode of a field that comes straight from Python is not planned by Spark."""
    return F.expr(let("x", local, "named_struct('edit', x.edit, 'other', x.other, 'ops', x.ops, 'bounds', x.bounds)"))


def _local_tokens(normal: DataFrame) -> DataFrame:
    """Mixed units of both texts, and the numbers of units before the two ends of each operation.

    No lambda here reads a variable of another one: Spark does not plan a Python column over such an expression.
    """
    count = lambda name, end: F.expr(
        f"""transform(coalesce(parsed.composed_{name}, transform(parsed.ops, o -> substring(parsed.target_text, 1, o.tgt_{end}))),
            x -> {composed_token_count('x')})"""
    )
    return normal.withColumns(
        {"_ref": mixed_tokens("ref_norm"), "_hyp": mixed_tokens("hyp_norm"), "_lo": count("lo", "start"), "_hi": count("hi", "end")}
    )


def with_errors(df: DataFrame, hypothesis: str, metric: Column, context: int = CONTEXT, composed: str | None = None) -> DataFrame:
    """``with_error_counts`` of the target text and ``with_local_errors`` at once.

    Both align mixed units for most cases; tokens of another metric are made and aligned besides where a case has one.
    """
    normal = _normal(df, "parsed.target_text", hypothesis, ("parsed.composed", composed)).withColumn("metric", metric)
    own = lambda norm: F.when(F.col("metric") != "mixed", er_tokens(norm, "metric"))
    tokens = _local_tokens(normal).withColumns({"ref_tokens": own("ref_norm"), "hyp_tokens": own("hyp_norm")})
    both = tokens.withColumn("_both", align_both(*LOCAL, F.lit(context), "ref_tokens", "hyp_tokens"))
    named = both.withColumns({"wer": with_rate("_both.counts", "metric"), "local_errors": _bound("_both.local")})
    return named.drop("ref_norm", "hyp_norm", "ref_tokens", "hyp_tokens", "_ref", "_hyp", "_lo", "_hi", "_both")
