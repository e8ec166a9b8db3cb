"""From documents to packed training sequences: five stages, each written as Parquet and read back by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm import decontaminate, language, line_dedup, packing, simhash
from editlens.llm.common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is clear. Dictionaries are learned from the labelled rows; a missing label is filled in."""
    judged = language.predict(docs, language.learn(docs))
    return judged.filter("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; of each line, only its first occurrence is left. A text with no line left is empty."""
    cleaned = line_dedup.deduplicate(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: SimHash of three-word shingles, links at two or fewer bits."""
    return simhash.one_per_component(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    marked = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("leaks") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", new_lines),
    ("near_duplicates", one_of_each),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: The first, third and last stage (compression, fingerprints, tokenising) are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
