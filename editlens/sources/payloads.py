"""Payload files by content."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.operators.provenance import new_payloads
from editlens.session import stored_or_empty

#: Files up to this size are read as one value. Spark holds such a value in memory, and refuses one of 2 GB.
WHOLE_BYTES = 32 << 20
#: Endings of files that Spark's text reader unpacks.
PACKED = r"\.(gz|gzip|bz2|zst|lz4|snappy|deflate)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
HASHED = "path string, size_bytes long, sha256 string"


def _digest(name: str, size: int, stretches: Iterator[list[bytes]]) -> str:
    """SHA-256 of a file from stretches of its lines, which lack their ends and, at the begin of the file, a byte order mark.

    The size of the file tells whether there was a mark and whether the last line had an end.
    """
    plain, marked, read = hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK), -1
    for lines in stretches:
        content = b"\n".join(lines if read < 0 else [b"", *lines])
        plain.update(content)
        marked.update(content)
        read = max(read, 0) + len(content)
    lost = size - read
    if lost in (1, 4):
        plain.update(b"\n")
        marked.update(b"\n")
    if lost in (0, 1):
        return plain.hexdigest()
    if lost in (3, 4):
        return marked.hexdigest()
    raise ValueError(f"{name}: read {read} of {size} bytes")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """The lines of one file in a batch: (file, size, lines)."""
    for batch in batches:
        names, at = batch.column(0).to_pylist(), 0
        for name, run in itertools.groupby(names):
            stop = at + sum(1 for _ in run)
            yield name, batch.column(1)[at].as_py(), batch.column(2).slice(at, stop - at).to_pylist()
            at = stop


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files from rows (file, size, line) in the order of the file, one file after the other."""
    for (name, size), own in itertools.groupby(_stretches(batches), key=lambda stretch: stretch[:2]):
        digest = _digest(name, size, (lines for _, _, lines in own))
        yield pa.RecordBatch.from_pydict({"path": [unquote(name)], "size_bytes": [size], "sha256": [digest]})


def _large(spark: SparkSession, path: str, pattern: str, largest: int) -> DataFrame:
    """Digests of the files that are too large for one value. Each is one split, so its lines come in order to one task."""
    # The settings belong to the session that reads, and the caller's must stay as they are.
    own = spark.newSession()
    for setting in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{setting}", str(largest + 1))
    lines = own.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    return rows.filter(f"size > {WHOLE_BYTES} and not file rlike r'{PACKED}'").mapInArrow(_hash_lines, HASHED)


def read_payloads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with size and SHA-256; the bytes are hashed where they are read.

    A file of over ``WHOLE_BYTES`` is hashed line by line, so that no task holds all of it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("path")
    hashed = lambda df: df.select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    # Spark leaves out files by a plain comparison of the length before it opens them.
    found = hashed(files.filter(F.col("length") <= WHOLE_BYTES))
    large = files.select("path", "length").filter(F.col("length") > WHOLE_BYTES)
    largest = large.filter(~F.col("path").rlike(PACKED)).agg(F.max("length")).first()[0]
    if largest is not None:
        found = found.unionByName(_large(spark, path, pattern, largest).select(name, "size_bytes", "sha256"))
    packed = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in large.filter(F.col("path").rlike(PACKED)).collect()]
    return found.unionByName(hashed(spark.read.format("binaryFile").load(packed))) if packed else found


def verified(uses: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded (path, digest) pairs whose file is absent or differs; each pair is checked once."""
    pairs = uses.select("path", F.col("sha256").alias("recorded")).dropDuplicates()
    both = pairs.join(found, "path", "left")
    return both.filter("not recorded <=> sha256").select("path", "recorded", "sha256")


def store_payloads(payloads: DataFrame, root: str) -> None:
    """Append payloads not stored yet, once per digest, in folders by digest prefix."""
    spark = payloads.sparkSession
    digests = payloads.withColumn("prefix", F.substring("sha256", 1, 2))
    stored = stored_or_empty(spark, root, digests.select("sha256").schema)
    fresh = new_payloads(digests, stored)
    fresh.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(root)
