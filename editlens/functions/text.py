"""Text units and normalisation as Spark columns.

Everything is a built-in expression except Unicode NFKC, which Spark lacks; that
runs over Arrow batches and skips ASCII texts.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens import schemas

# Code-point ranges counted as one-character units. The
# recognition table has one range more than the alignment table.
ALIGNMENT_CJK = (
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
    r"\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
)
RECOGNITION_CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
UNIT_PATTERN = rf"[{ALIGNMENT_CJK}]|[\p{{L}}\p{{N}}&&[^{ALIGNMENT_CJK}]]+"


def _composed(texts: pa.Array) -> pa.Array:
    """NFKC of each text. Arrow's own kernel leaves letters decomposed, so it is not used."""
    return pa.array(
        [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string()
    )


@F.arrow_udf(schemas.STRING)
def nfkc(text: pa.Array) -> pa.Array:
    return _composed(text)


@F.arrow_udf(T.ArrayType(schemas.STRING))
def nfkc_each(texts: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(texts.offsets, _composed(texts.values))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(text: Column | str) -> Column:
    """Alignment units in order: a CJK character or a run of letters and digits."""
    return F.regexp_extract_all(_col(text), F.lit(UNIT_PATTERN), 0)


def normalize_unit(text: Column | str) -> Column:
    """NFKC, trim, lower, keep letters, digits and CJK."""
    return F.regexp_replace(F.lower(nfkc(_col(text))), rf"[^\p{{L}}\p{{N}}{ALIGNMENT_CJK}]", "")


# Each match becomes one blank, in this order: script boundaries, punctuation
# (letters, numbers and underscore stay), runs of Unicode blanks.
BLANKED = (
    rf"(?<=[{RECOGNITION_CJK}])(?=[A-Za-z0-9])",
    rf"(?<=[A-Za-z0-9])(?=[{RECOGNITION_CJK}])",
    r"(?U)[^\p{L}\p{N}_\s]",
    r"(?U)[\s\x1c-\x1f]+",
)
# All of it in an ASCII text, which has no script boundary and is its own NFKC.
ASCII_BLANKED, ASCII_TOKEN = "[^A-Za-z0-9_]+", "[A-Za-z0-9_]+"
MIXED_TOKEN = rf"[{RECOGNITION_CJK}]|[^\s{RECOGNITION_CJK}]+"


def normalize_er(text: Column | str, composed: Column | str | None = None) -> Column:
    """Normal form for error rates. ``composed`` is the text's NFKC, made elsewhere; null where the text is ASCII."""
    text = _col(text)
    value = F.lower(nfkc(text) if composed is None else F.coalesce(_col(composed), text))
    for pattern in BLANKED:
        value = F.regexp_replace(value, pattern, " ")
    plain = F.regexp_replace(F.lower(text), ASCII_BLANKED, " ")
    return F.trim(F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(value))


def composed_token_count(composed: str) -> str:
    """Number of mixed tokens of an NFKC text, as SQL for use in a lambda."""
    value = f"lower({composed})"
    for pattern in BLANKED:
        value = f"regexp_replace({value}, r'{pattern}', ' ')"
    return f"""if(octet_length({composed}) = char_length({composed}), size(regexp_extract_all({composed}, '{ASCII_TOKEN}', 0)),
        size(regexp_extract_all({value}, r'{MIXED_TOKEN}', 0)))"""


def mixed_tokens(normalized: Column | str) -> Column:
    """CJK characters singly, other runs by blanks; input is ``normalize_er`` output."""
    return F.regexp_extract_all(_col(normalized), F.lit(MIXED_TOKEN), 0)


def er_metric(category: Column | str, language: Column | str) -> Column:
    """Unit of the error rate: emotion follows the case language, the rest mixed."""
    chinese = F.lower(_col(language)).isin("zh", "chinese", "zho", "cmn")
    return (
        F.when(_col(category) != "emotion", "mixed")
        .when(F.lower(_col(language)).isin("auto", "mixed"), "mixed")
        .when(chinese, "cer")
        .otherwise("wer")
    )


def er_tokens(normalized: Column | str, metric: Column | str) -> Column:
    """Tokens of a normalised text under the chosen metric."""
    text, metric = _col(normalized), _col(metric)
    return (
        F.when(metric == "cer", F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit("")), F.lit(r"(?s)."), 0))
        .when(metric == "wer", F.regexp_extract_all(text, F.lit(r"[^ ]+"), 0))
        .otherwise(mixed_tokens(text))
    )


def trim_zeros(number: Column | str) -> Column:
    """Plain decimal text without trailing zeros, e.g. 1.20 -> 1.2 and 2.0 -> 2."""
    text = _col(number).cast("decimal(20,9)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def redact(text: Column | str, secret: str) -> Column:
    return F.replace(_col(text), F.lit(secret), F.lit("[REDACTED]"))


def text_sha(text: Column | str) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)
