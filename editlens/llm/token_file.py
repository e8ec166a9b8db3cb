"""Token ids of all documents in a compressed, checksummed block format, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm.common import before_part, ranged
from editlens.llm.range_coder import decode_blocks, encode_blocks
from editlens.llm.tokens import default_path, encoder

#: Blocks coded side by side at most, and ids in a block; a frame of few ids has shorter blocks.
LANES, LONG_BLOCK, SHORT_BLOCK = 768, 8192, 1024
END_ID = 0
PIECES = [("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())]
BLOCK = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("length", pa.int32()),
        ("crc32", pa.int64()),
        ("payload", pa.binary()),
        ("pieces", pa.list_(pa.struct(PIECES))),
    ]
)
BLOCK_DDL = (
    "part int, block long, first long, n_ids long, length int, crc32 long, payload binary, "
    "pieces array<struct<doc_id: long, row: long, n: long>>"
)


class _Part:
    """Collects the ids of one range of documents and gives them out as rows of coded blocks."""

    def __init__(self, part: int):
        self.part, self.block, self.first = part, 0, 0
        self.ids: list[bytes] = []
        self.owners: list[tuple[int | None, int, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, row: int, ids: bytes) -> Iterator[pa.RecordBatch]:
        room = LANES * LONG_BLOCK
        at, n = 0, len(ids) // 4
        while n:
            take = min(n, room - self.held)
            self.ids.append(ids[4 * at : 4 * (at + take)])
            self.owners.append((doc_id, row, take))
            self.held, at, n = self.held + take, at + take, n - take
            if self.held == room:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(self.ids), dtype="<u4")
        length = int(np.clip(len(ids) // 64, SHORT_BLOCK, LONG_BLOCK))
        blocks = -(-len(ids) // length)
        padded = np.zeros(blocks * length, dtype="<u4")
        padded[: len(ids)] = ids
        rows = []
        owners, left = iter(self.owners), (None, 0, 0)
        payloads = encode_blocks(padded.reshape(blocks, length))
        for i, payload in enumerate(payloads):
            own = ids[i * length : (i + 1) * length]
            pieces, need = [], len(own)
            while need:
                if not left[2]:
                    left = next(owners)
                n = min(need, left[2])
                pieces.append({"doc_id": left[0], "row": left[1], "n": n})
                left, need = (left[0], left[1], left[2] - n), need - n
            rows.append((self.part, self.block, self.first, len(own), length, zlib.crc32(own.tobytes()), payload, pieces))
            self.block, self.first = self.block + 1, self.first + len(own)
        self.ids, self.owners, self.held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK)


def write_tokens(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> None:
    """Write the ids of all whole texts to a folder, in ascending order of the id.

    The file format is Parquet with a row for each block: the range (``part``) and the block's number in it, the
    number of ids before it in the range, its ids as a payload of the range coder, their CRC-32, and the documents
    its ids belong to. Ids of a range run through its blocks without gaps; a block can be decoded alone. Each document
    ends with END_ID. A null or empty text has only that; rows with a null id come first; repeated rows are documents
    of their own, in no set order; an empty table gives an empty folder that reads as no rows. Other columns are
    ignored. A vocabulary of over 65,536 ids is refused.
    """
    path = path or default_path()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        if tokens.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the range coder takes ids below 65,536")
        state = None
        for batch in batches:
            texts = (t.as_py() for t in batch["text"])
            for part, row, doc, ids in zip(batch["part"].to_pylist(), batch["row"].to_pylist(), batch["doc_id"].to_pylist(), tokens.encode_all(texts), strict=True):
                state = state or _Part(part)
                yield from state.add(doc, row, ids + end)
        if state and state.held:
            yield state.flush()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = given.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", "text", F.spark_partition_id().alias("part"), inside.alias("row"))
    placed.mapInArrow(code, BLOCK_DDL).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the blocks: a row for each run of a document's ids in a block, with their CRC-32 and perhaps the ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "row", "doc_id", "at", "n", "crc32", "ids"]
        types = [pa.int32()] + [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            lengths = np.asarray(batch["length"].to_pylist())
            for length in np.unique(lengths):
                chosen = np.flatnonzero(lengths == length)
                for some in np.array_split(chosen, -(-len(chosen) // LANES)):
                    rows = [batch.slice(i, 1).to_pylist()[0] for i in some]
                    out = []
                    for r, ids in zip(rows, decode_blocks([r["payload"] for r in rows], int(length)), strict=True):
                        raw = ids[: r["n_ids"]].astype("<u4").tobytes()
                        if zlib.crc32(raw) != r["crc32"]:
                            raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                        at = 0
                        for p in r["pieces"]:
                            own = raw[4 * at : 4 * (at + p["n"])]
                            out.append((r["part"], r["block"], p["row"], p["doc_id"], r["first"] + at, p["n"], zlib.crc32(own), own if with_ids else None))
                            at += p["n"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "part int, block long, row long, doc_id long, at long, n long, crc32 long, ids binary"
    return spark.read.schema(BLOCK_DDL).parquet(folder).mapInArrow(decode, schema)


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of data from ``(bytes, CRC-32)`` of its parts in order.

    Appending n bytes multiplies the polynomial of the data before by x^(8n); CRCs are kept bit-reversed.
    """
    total = 0
    for size, crc in parts:
        power, square, n = 0x80000000, 0x00800000, size  # 1 and x^8
        while n:
            if n & 1:
                power = _times(power, square)
            square, n = _times(square, square), n >> 1
        total = _times(power, total) ^ crc
    return total


def _times(a: int, b: int) -> int:
    """Product of two bit-reversed polynomials modulo that of CRC-32."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document; ``start`` counts the ids of all documents before it."""
    sizes = spark.read.schema(BLOCK_DDL).parquet(folder).groupBy(F.col("part").alias("_part")).agg(F.sum("n_ids").alias("_ids"))
    shift = F.broadcast(before_part(sizes, "_ids", "_before"))

    @F.pandas_udf("long")
    def join_crc(runs: pd.Series) -> pd.Series:
        return pd.Series([r[0]["crc32"] if len(r) == 1 else crc32_joined([(4 * x["n"], x["crc32"]) for x in r]) for r in runs], dtype="int64")

    runs = read_blocks(spark, folder)
    docs = runs.groupBy("part", "row", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "crc32"))).alias("runs"), F.min("at").alias("at"), F.sum("n").alias("n_tokens")
    )
    placed = docs.join(shift, F.col("part") == F.col("_part"))
    return placed.select("doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", join_crc("runs").alias("ids_crc32"))
