"""Packing: first-fit decreasing in random groups of documents, with a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm.common import stored
from editlens.llm.tokens import default_path, encoder

CAPACITY = 2048
END_ID = 1
#: Pieces a group should have; more pieces make more groups.
GROUP_PIECES = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, ids binary"


class Bins:
    """Free space of the bins in a complete binary tree; a node has the most free space below it."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the first bin that has room; gives the bin and the free space it had."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < length:
                at += 1
        free = tree[at]
        bin_ = at - self.leaves
        tree[at] = free - length
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return bin_, free


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of every piece. Pieces of equal length keep their order."""
    bins = Bins(capacity, max(1, len(lengths)))
    at, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        bin_, free = bins.place(int(lengths[i]))
        at[i], offset[i] = bin_, capacity - free
    return at, offset


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with END_ID, and cut it into pieces of the capacity and one remainder."""
    path = path or default_path()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path).encode_all
        names = [n for n in PIECES.replace(" long", "").replace(" binary", "").split(", ")]
        types = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            texts = (t.as_py() for t in batch["text"])
            for doc, row, ids in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), encode_all(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, row, part if with_ids else None))
                    held += len(part) if with_ids else 64
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return given.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Gives a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked
    for, its ``ids``. Remainders are dealt into groups at random (by a hash of the row), and each group is packed by
    itself; full pieces are sequences of their own. A null or empty text is its end id alone; rows with a null id and
    repeated rows are packed like others; an empty table gives no rows. Other columns are ignored. Pieces go into
    sequences in decreasing length, so the last sequences of a group may be short: pad them to ``capacity``, or leave
    one that is a power of two long as it is.
    """
    cut = stored(pieces(docs, text, doc_id, path, capacity, with_ids))
    groups = max(1, cut.filter(F.col("length") < capacity).count() // group_pieces)
    # A row's place in the input is no part of the deal, so copies of a row are told apart by the row number.
    deal = F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups))
    full = cut.filter(F.col("length") == capacity).withColumns({"group": F.lit(-1).cast("long"), "bin": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < capacity).withColumn("group", deal)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "row", "start"], kind="stable")
        group["bin"], group["offset"] = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group

    schema = PIECES + ", group long, bin long, offset long"
    placed = rest.groupBy("group").applyInPandas(packed, schema)
    #: Odd ids for full pieces and even ones for groups: a group has fewer than 2^31 bins.
    sequence = F.when(F.col("group") < 0, F.shiftleft("bin", 1) + 1).otherwise(F.shiftleft(F.shiftleft("group", 31) + F.col("bin"), 1))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset"]
    return full.unionByName(placed).select(*columns, *(["ids"] if with_ids else []))


def sequences(spark: SparkSession, packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, ``(sequence_id, ids array<int>, n_ids)``, from pieces packed with ``with_ids``."""

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(group.sort_values("offset")["ids"]), dtype="<u4").astype(np.int64).tolist()
        n = len(ids)
        pad = 0 if n & (n - 1) == 0 else capacity - n
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "ids": [ids + [pad_id] * pad], "n_ids": [n]})

    return packed.groupBy("sequence_id").applyInPandas(joined, "sequence_id long, ids array<long>, n_ids long")
