"""One query for each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm import alignment, bpe, decontaminate, html_text, language, line_dedup, merkle, order_minhash, packing, repeats, shards, simhash, token_file
from editlens.llm.common import table
from editlens.session import scratch


def op1_token_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark)
    token_file.write_tokens(table(spark, sf, "documents"), folder)
    return token_file.read_documents(spark, folder)


def op2_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf, "documents"))


def op3_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.assign(table(spark, sf, "documents"), 40)


def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(table(spark, sf, "documents"))


def op6_repeats(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = repeats.remove_repeats(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each document and passage of the benchmark in it."""
    marked = decontaminate.contaminated(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return marked.select("doc_id", F.inline("leaks")).withColumnRenamed("item", "item_id")


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_dedup.deduplicate(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", language.held_out())
    dictionaries = language.learn(docs.filter(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "text", "held_out"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op11_bpe(spark: SparkSession, sf: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf, "documents"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"))


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Of rows whose id has a checksum divisible by five, the text is tampered with."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    proofs = merkle.manifest(table(spark, sf, "documents"), tampered_when=tampered)
    found = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_order_minhash, op3_shards, op4_html_text, op5_simhash, op6_repeats, op7_decontaminate, op8_line_dedup, op9_language, op10_packing, op11_bpe, op12_alignment, op13_merkle)}
SQL: dict[str, str] = {}
