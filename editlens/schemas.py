"""Row types of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT_KINDS = ("ins", "del", "sub")
STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
DOUBLE, BOOLEAN = T.DoubleType(), T.BooleanType()

UNIT = struct(word=STRING, start=DOUBLE, end=DOUBLE)
UNITS = T.ArrayType(UNIT)
# A unit with its character bounds; pre/post: an apostrophe or hyphen touches it.
SPANS = T.ArrayType(struct(start=INT, end=INT, pre=BOOLEAN, post=BOOLEAN))
_BOUNDS = {"src_start": INT, "src_end": INT, "tgt_start": INT, "tgt_end": INT}
OPERATION = struct(kind=STRING, **_BOUNDS, param=STRING, content=STRING)
REGION = struct(kind=STRING, **_BOUNDS)
PARSED = struct(
    error=STRING,
    source_text=STRING,
    target_text=STRING,
    ops=T.ArrayType(OPERATION),
    regions=T.ArrayType(REGION),
    source_spans=SPANS,
    target_spans=SPANS,
    # NFKC of the target text and of its parts before the two ends of each operation; null where the text is ASCII.
    composed=STRING,
    composed_lo=T.ArrayType(STRING),
    composed_hi=T.ArrayType(STRING),
)
STEPS = T.ArrayType(struct(step=INT, op_index=INT, xml=STRING, source_text=STRING, target_text=STRING))

ALIGNMENT = struct(audio_sha256=STRING, text_sha256=STRING, segments=UNITS)
CASE = struct(
    id=STRING,
    language=STRING,
    source_audio=struct(asset_id=STRING, path=STRING, sha256=STRING),
    instruction_xml=STRING,
    annotations=struct(source_alignment=ALIGNMENT, span_granularity=STRING, source_emotion=STRING),
)
# Recipes are a tagged union with free parameters; they stay JSON text until S03.
MANIFEST = struct(
    category=STRING,
    shard=STRING,
    audio_assets=T.MapType(STRING, STRING),
    cases=T.ArrayType(CASE),
)
GENERATION = struct(id=STRING, status=STRING, audio_path=STRING, audio_sha256=STRING, error=STRING)
EVALUATION = struct(id=STRING, metrics=STRING)

# One element per reference token, and a last one for the end of the text:
# op of the token, hypothesis position (-1 if none), tokens inserted before it.
EDIT_PATH = T.ArrayType(struct(op=STRING, hyp=INT, ins=INT))
ERROR_COUNTS = struct(
    substitutions=INT, deletions=INT, insertions=INT, hits=INT, ref_length=INT, hyp_length=INT, path=EDIT_PATH
)
COUNTS = T.StructType([f for f in ERROR_COUNTS if f.name != "path"])
REGION_ERRORS = struct(
    error_rate=DOUBLE, substitutions=INT, deletions=INT, insertions=INT, hits=INT, ref_length=INT, hyp_length=INT, metric=STRING
)
# Whether an operation edits text, and the numbers of tokens before its two ends.
TOKEN_BOUNDS = struct(text=BOOLEAN, lo=INT, hi=INT)
LOCAL_ERRORS = struct(edit=REGION_ERRORS, other=REGION_ERRORS, ops=T.ArrayType(REGION_ERRORS), bounds=T.ArrayType(TOKEN_BOUNDS))
ALL_ERRORS = struct(counts=COUNTS, local=LOCAL_ERRORS)
