"""Language by compression: a text belongs to the language whose zstandard dictionary makes it smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows a language and letters of each that are learned from, and bytes of a dictionary: the sample's bounds.
SAMPLE_ROWS, EXCERPT, DICTIONARY = 800, 300, 3 << 16
#: Bytes compressed at a time, so that a text is measured against the dictionary and not against itself.
PIECE = 128
#: A text is rejected if its smallest size is not below the second by this share (no language stands out), or if the best
#: language of each piece saves more than this over one language for all (several languages). Both were set on held-out
#: labelled rows, see README.
MARGIN, MIXED = 0.025, 0.06
LEVEL = 3
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]+")
SLICE = 1 << 16


def plain(text: str) -> str:
    """Lower case; anything but letters is one space."""
    return NO_LETTER.sub(" ", text.lower())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None) -> dict[str, bytes]:
    """A raw-content dictionary for each language, from SAMPLE_ROWS of its texts, those with the smallest hashes.

    Copies of a text share a hash and count once (``order`` sets another hash). Hashes alone are ranked, and a task
    sends SAMPLE_ROWS of them a language at most; a second look at the table takes the rows up to the last rank. The driver gets SAMPLE_ROWS excerpts a language; languages are as few as labels in
    use.
    """
    order = F.xxhash64(F.col(text)) if order is None else order
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    some = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("at"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    hashes = some.select("lang", "at").distinct().withColumn("r", rank).filter(F.col("r") <= SAMPLE_ROWS)
    last = {r["lang"]: r["at"] for r in hashes.groupBy("lang").agg(F.max("at").alias("at")).collect()}
    if not last:
        return {}
    limit = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    few = some.filter(F.col("at") <= limit[F.col("lang")]).select("lang", "at", F.substring("text", 1, 4 * EXCERPT).alias("text"))
    chosen = few.groupBy("lang", "at").agg(F.min("text").alias("text"))
    found: dict[str, list[str]] = {}
    for row in chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).filter(F.col("r") <= SAMPLE_ROWS).orderBy("lang", "r").collect():
        found.setdefault(row["lang"], []).append(plain(row["text"])[:EXCERPT])
    return {k: "\n".join(dict.fromkeys(v)).encode()[:DICTIONARY] for k, v in found.items()}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = {}
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False)

        self.empty = {lang: len(c.compress(b"")) for lang, c in self.by.items()}  # of a frame without content

    def sizes(self, text: str) -> tuple[dict[str, int], int]:
        """Size of the text by language, and its size if each piece takes the language that makes it smallest."""
        total, free = dict.fromkeys(self.by, 0), 0
        for at in range(0, len(text), SLICE):
            data = plain(text[at : at + SLICE]).encode("utf-8", "replace")
            for i in range(0, len(data), PIECE):
                piece = data[i : i + PIECE]
                found = {lang: len(c.compress(piece)) - self.empty[lang] for lang, c in self.by.items()}
                free += min(found.values())
                for lang, size in found.items():
                    total[lang] += size
        return total, free

    def of(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin to the second one (0 to 1) and whether the text is rejected."""
        if not text or not self.by or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        total, free = self.sizes(text)
        order = sorted((size, lang) for lang, size in total.items())
        best = max(order[0][0], 1)
        if len(order) == 1:
            return order[0][1], 1.0, False
        margin = max(0.0, 1 - best / max(order[1][0], 1))
        return order[0][1], margin, margin < MARGIN or 1 - free / best > MIXED


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row; all other columns stay (those names are replaced).

    The text is looked at in lower case without anything but letters, in pieces. ``score`` is the share by which the
    smallest size undercuts the second. A text is rejected if that is below MARGIN, or if its pieces together are smaller
    by more than MIXED when each takes its own language. Null
    texts and texts without a letter (numeral signs such as ½ are none) are UNKNOWN with score 0 and rejected. Equal sizes go to the first language in
    alphabetical order. With no dictionary everything is UNKNOWN; an empty table stays empty.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(dictionaries)
        for texts in batches:
            yield pd.DataFrame([judge.of(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*rest, judged(F.col(text)).alias("_judged")).select(*rest, "_judged.*")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
