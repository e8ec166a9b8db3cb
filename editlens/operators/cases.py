"""Cases with their instruction read: operations, regions, texts, families, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.functions.instructions import parse_instructions, plan_instructions
from editlens.functions.text import text_sha
from editlens.functions.units import TEXT_KINDS, timed_units

# Family and label of each operation kind.
FAMILIES = {
    "ins": "text",
    "del": "text",
    "sub": "text",
    "emo": "emotion",
    "pitch": "prosody",
    "rate": "prosody",
    "pause": "pause",
}
LABELS = {"ins": "insert", "del": "delete", "sub": "replace"}


def _lookup(kind: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind]


def family(kind: Column | str) -> Column:
    return _lookup(F.col(kind) if isinstance(kind, str) else kind, FAMILIES)


def label(kind: Column | str, param: Column | str) -> Column:
    """Reported operation name; a pause goes by its act."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    param = F.col(param) if isinstance(param, str) else param
    return F.when(kind == "pause", param).otherwise(F.coalesce(_lookup(kind, LABELS), kind))


def read_instructions(cases: DataFrame, **others: Column) -> DataFrame:
    """Add ``parsed``; one Python pass, whatever is derived from it afterwards.

    ``others`` are columns made in Python from what the cases have, in the same pass.
    """
    return cases.withColumns({"parsed": parse_instructions("instruction_xml"), **others})


def accepted(read: DataFrame) -> DataFrame:
    return read.filter("parsed.error is null")


def quarantine(cases: DataFrame) -> DataFrame:
    """Rejected fragments with a reason."""
    return read_instructions(cases).filter("parsed.error is not null").selectExpr(
        "case_id", "instruction_xml", "parsed.error as reason"
    )


def explode_operations(read: DataFrame, *keep: str) -> DataFrame:
    """One row per operation."""
    return read.select("case_id", *keep, F.posexplode("parsed.ops").alias("op_index", "op")).select(
        "case_id", *keep, "op_index", "op.*"
    )


def explode_regions(read: DataFrame, *keep: str) -> DataFrame:
    return read.select("case_id", *keep, F.posexplode("parsed.regions").alias("region", "r")).select(
        "case_id", *keep, "region", "r.*"
    )


def texts(read: DataFrame) -> DataFrame:
    return read.selectExpr("case_id", "parsed.source_text", "parsed.target_text")


def category(ops: str = "parsed.ops", declared: str | None = None) -> Column:
    """Declared category, else the only family, else compositional."""
    families = F.array_distinct(F.transform(F.col(ops), lambda o: family(o["kind"])))
    derived = F.when(F.size(families) > 1, "compositional").otherwise(F.get(families, F.lit(0)))
    return F.coalesce(F.col(declared), derived) if declared else derived


def is_whole_utterance() -> Column:
    """A lone emotion operation with only blanks around its target span."""
    op = F.get("parsed.ops", F.lit(0))
    text = F.col("parsed.target_text")
    before = F.expr("substring(parsed.target_text, 1, get(parsed.ops, 0).tgt_start)")
    after = F.expr("substring(parsed.target_text, get(parsed.ops, 0).tgt_end + 1)")
    blank = r"^(?U)\s*$"
    return (
        (F.size("parsed.ops") == 1)
        & (op["kind"] == "emo")
        & before.rlike(blank)
        & after.rlike(blank)
        & text.isNotNull()
    )


def with_timed_units(read: DataFrame) -> DataFrame:
    """Add ``s`` and ``t``: units of both sides with characters and times together."""
    return read.withColumns(
        {
            "s": F.expr(timed_units("parsed.source_spans", "source_units")),
            "t": F.expr(timed_units("parsed.target_spans", "target_units")),
        }
    )


def sequential_plan(cases: DataFrame, *keep: str) -> DataFrame:
    """One row per operation in the order a chained run applies them."""
    steps = cases.select("case_id", *keep, F.explode(plan_instructions("instruction_xml")).alias("s"))
    return steps.select("case_id", *keep, "s.*")


def one_take_plan(read: DataFrame, *keep: str) -> DataFrame:
    """One row per case with the whole fragment."""
    return accepted(read).select(
        "case_id",
        *keep,
        F.lit(0).alias("step"),
        F.lit(None).cast("int").alias("op_index"),
        F.col("instruction_xml").alias("xml"),
        F.col("parsed.source_text").alias("source_text"),
        F.col("parsed.target_text").alias("target_text"),
    )


def order_operations(ops: DataFrame) -> DataFrame:
    """Source order of a case's operations, ties by index."""
    return ops.orderBy("case_id", "src_start", "op_index")


def first_operation(read: DataFrame, *keep: str) -> DataFrame:
    """Earliest operation, earliest acoustic operation, and whether families mix.

    Selection families keep emotion and pause as kinds of their own.
    """
    ordered = """array_sort(transform(parsed.ops, (o, i) -> named_struct(
        'at', o.src_start, 'i', i, 'kind', o.kind, 'param', o.param, 'content', o.content, 'src_end', o.src_end)))"""
    own = f"""array_distinct(transform(parsed.ops, o -> case when o.kind in {TEXT_KINDS} then 'text'
        when o.kind in ('pitch', 'rate') then 'prosody' else o.kind end))"""
    return accepted(read).selectExpr("case_id", *keep, "parsed", f"{ordered} as o", f"size({own}) > 1 as composition").selectExpr(
        "case_id",
        *keep,
        "parsed",
        "composition",
        "get(o, 0) as first",
        f"get(filter(o, x -> x.kind not in {TEXT_KINDS}), 0) as acoustic",
    )


def text_edit_ledger(read: DataFrame) -> DataFrame:
    """Digests of the replaced and the new text of each text operation."""
    source = F.expr("substring(parsed.source_text, src_start + 1, src_end - src_start)")
    inserted = F.expr("substring(parsed.target_text, tgt_start + 1, tgt_end - tgt_start)")
    target = F.when(F.col("kind") == "ins", inserted).when(F.col("kind") == "sub", F.col("param")).otherwise("")
    return (
        explode_operations(read, "parsed")
        .filter(F.col("kind").isin("ins", "del", "sub"))
        .select(
            "case_id",
            "op_index",
            "kind",
            text_sha(source).alias("source_sha256"),
            text_sha(target).alias("target_sha256"),
        )
    )
