"""Cross-tokenizer alignment: token groups of two tokenizers over the same bytes, and how many documents link id pairs.

Documents are taken in spills of bounded size. A spill's (pair, document) records are radix-partitioned by the id of the
first side and written as sorted, zstd-compressed runs, one row each. Per radix part, a k-way heap merge of the runs
counts the documents of each pair, in passes of FAN_IN runs until one is left; its order (first side, then second) gives
the highest count of each first id as it goes by. Then the counts meet the runs again, FAN_IN spills at a time, and
what they add to each document streams back to its spill as one dense array. A pair that very many documents hold is
spread over all spills, and no task ever holds more than FAN_IN runs or one vocabulary-bounded list of counts.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens.llm.common import stored
from editlens.llm.tokens import Encoder
from editlens.llm.tokens import default_path as default_a_path

#: A spill ends with the document that takes it over this many records, or documents.
SPILL_RECORDS = 1_000_000
SPILL_DOCUMENTS = 1 << 14
#: Radix parts, by the id of the first side. A part has at most (ids of A / PARTS) x (ids of B) pairs.
PARTS = 64
FAN_IN = 64
#: Different stretches of text a worker remembers.
CACHE = 450_000
BLOCK = 1 << 16
#: A space between two signs that are no white space, and any other space.
SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"(?<!\S) | (?!\S)")
DOCUMENTS = "spill long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def default_b_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def packed(values: np.ndarray, steps: bool = False) -> bytes:
    """Unsigned numbers in their narrowest type (or the steps between them, which may wrap around), zstd-compressed."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    values = values.astype(kind)
    if steps:
        values = np.diff(values, prepend=kind.type(0))
    return bytes([kind.itemsize, steps]) + zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def blocks(blob: bytes) -> Iterator[np.ndarray]:
    """The numbers again, a bounded block at a time."""
    kind, steps, last = np.dtype(f"<u{blob[0]}"), blob[1], 0
    reader = zstandard.ZstdDecompressor().stream_reader(blob[2:])
    while raw := reader.read(BLOCK):
        values = np.frombuffer(raw, dtype=kind)
        if steps:
            values = np.cumsum(values, dtype=kind) + kind.type(last)
            last = values[-1]
        yield values.astype(np.uint64)


def unpacked(blob: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.uint64), *blocks(blob)])


def numbers(blob: bytes) -> Iterator[int]:
    for block in blocks(blob):
        yield from block.tolist()


class Aligner:
    """Tokens of both sides for a text.

    The first tokenizer begins a word at a space before something else than white space. The second has no piece with
    a space after another sign, so it never merges over the start of a space. Both therefore end a token before a
    space between two signs that are no white space; texts are cut there, and what a stretch gives is cached.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {letter: byte for byte, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes, space = [], "▁"
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            if space in piece.lstrip(space):
                raise ValueError(f"a piece crosses a space: {piece}")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(space, " ").encode())
        self.cache: dict[str, tuple | bool] = {}

    def _a_ids(self, piece: str) -> list[int]:
        """Ids of a space and the piece. Letters are one word, so the model gets them without the steps before it."""
        if not piece.isalpha():
            return self.a.tokenizer.encode(" " + piece, add_special_tokens=False).ids
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.a.letters)
        return [t.id for t in self.a.model.tokenize(self.a.letters[32] + word)]

    def stretch(self, piece: str, b: list[int]) -> tuple | bool:
        """``n_a, n_b, n_groups, n_links, groups, links`` of a stretch, which a space precedes; False if bytes differ."""
        a = self._a_ids(piece)
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + piece).encode():
            return False
        if len(a) == 1 or len(b) == 1:
            found = [(a, b)]
        else:
            a_ends, b_ends = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
            found, at_a, at_b, place = [], 0, 0, {end: j for j, end in enumerate(b_ends, 1)}
            for i, end in enumerate(a_ends, 1):
                j = place.get(end)
                if j:
                    found.append((a[at_a:i], b[at_b:j]))
                    at_a, at_b = i, j
        links = array.array("I", [x << 16 | y for left, right in found for x in left for y in right])
        groups = ";".join([f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in found])
        return len(a), len(b), len(found), len(links), groups, links.tobytes()

    def document(self, text: str | None) -> tuple | None:
        """Sums over all stretches, digest of the groups, and the distinct links with their numbers of occurrences."""
        if not text:
            return None
        if len(self.cache) > CACHE:
            self.cache.clear()
        pieces = SPACE.split(text) if ODD.search(text) else text.split(" ")
        found = list(map(self.cache.get, pieces))
        if None in found:
            new = list(dict.fromkeys(p for p, v in zip(pieces, found, strict=True) if v is None))
            made = dict(zip(new, map(self.stretch, new, self.b.encode(new, num_threads=1)), strict=True))
            self.cache.update((p, v) for p, v in made.items() if len(p) < 64)
            found = [made[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
        if False in found:
            return None
        n_a, n_b, n_groups, n_links, groups, links = zip(*found, strict=True)
        pairs, times = np.unique(np.frombuffer(b"".join(links), dtype=np.uint32), return_counts=True)
        return sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, times


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process, so that its cache serves all tasks of the worker."""
    return Aligner(a_path, b_path)


def _runs(pairs: np.ndarray, rows: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """A spill's records as runs: part, distinct pairs, documents of each, and row and occurrences of each record."""
    part = (pairs >> 16) % PARTS
    order = np.argsort(part.astype(np.uint64) << np.uint64(32) | pairs, kind="stable")
    pairs, rows, times, part = pairs[order], rows[order], times[order], part[order]
    cuts = np.searchsorted(part, np.arange(PARTS + 1))
    for p, (low, high) in enumerate(itertools.pairwise(cuts.tolist())):
        if low < high:
            distinct, counts = np.unique(pairs[low:high], return_counts=True)
            yield p, packed(distinct, steps=True), packed(counts), packed(rows[low:high], steps=True), packed(times[low:high])


def spills(docs: DataFrame, text: str, doc_id: str, a_path: str, b_path: str, spill_records: int) -> DataFrame:
    """Rows of documents and rows of runs (``part`` is not null) in one stored table."""
    names = ["spill", "row", "doc_id", *COUNTS, "groups_sha256", "part", "pairs", "counts", "rows", "times"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), *[pa.binary()] * 4]

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 4096):
            columns = zip(*rows[i : i + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path).document
        number, held = itertools.count(TaskContext.get().partitionId() << 32), 0
        rows: list[tuple] = []
        records: list[tuple[np.ndarray, np.ndarray]] = []

        def ended() -> Iterator[pa.RecordBatch]:
            spill_id = next(number)
            yield from out([(spill_id, i, *row, *[None] * 5) for i, row in enumerate(rows)])
            pairs, times = (np.concatenate(x) for x in zip(*records, strict=True))
            at = np.repeat(np.arange(len(records)), [len(p) for p, _ in records])
            yield from out([(spill_id, *[None] * 7, *run) for run in _runs(pairs, at, times)])

        nothing = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for doc, value in zip(batch["doc_id"], batch["text"], strict=True):
                found = align(value.as_py())
                rows.append((doc.as_py(), *(found[:5] if found else (0, 0, 0, 0, ""))))
                records.append(found[5:] if found else nothing)
                held += len(records[-1][0])
                if held > spill_records or len(rows) >= SPILL_DOCUMENTS:
                    yield from ended()
                    rows, records, held = [], [], 0
        if rows:
            yield from ended()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(given.mapInArrow(spill, DOCUMENTS + ", part int, pairs binary, counts binary, rows binary, times binary"))


def merge_counts(runs: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """K-way heap merge of runs of (pairs, counts): every pair once, in order, with its sum."""
    pairs, sums = array.array("Q"), array.array("Q")
    for pair, same in itertools.groupby(heapq.merge(*[zip(numbers(p), numbers(c), strict=True) for p, c in runs]), key=lambda x: x[0]):
        pairs.append(pair)
        sums.append(sum(n for _, n in same))
    return np.array(pairs, dtype=np.uint64), np.array(sums, dtype=np.uint64)


def side_maxima(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its first id. Pairs are in order, so a first id is one stretch."""
    first = pairs >> np.uint64(16)
    starts = np.flatnonzero(np.diff(first, prepend=first[:1] - np.uint64(1)))
    highest = np.maximum.reduceat(counts, starts)
    return counts == np.repeat(highest, np.diff(np.append(starts, len(pairs))))


def count_pairs(runs: DataFrame) -> DataFrame:
    """``part, pairs, counts``: one row a part, from passes of k-way merges; a pass leaves one run of FAN_IN chunks."""

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = merge_counts(zip(group["pairs"], group["counts"], strict=True))
        return pd.DataFrame([{"part": key[0], "chunk": key[1] // FAN_IN, "pairs": packed(pairs, steps=True), "counts": packed(counts)}])

    current = runs.select("part", "chunk", "pairs", "counts")
    while True:
        last = not current.filter("chunk > 0").limit(1).count()
        current = stored(current.groupBy("part", "chunk").applyInPandas(merged, "part int, chunk long, pairs binary, counts binary"))
        if last:
            return current.select("part", "pairs", "counts")


def _contributions(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """What the pairs of a part add to each document of the spills, as dense arrays."""
    out = {"spill": [], "best": [], "sums": []}
    if runs.num_rows:
        pairs, counts = unpacked(totals["pairs"][0].as_py()), unpacked(totals["counts"][0].as_py())
        best = side_maxima(pairs, counts)
        for spill, own, n, rows, times in zip(*[runs[c] for c in ("spill", "pairs", "counts", "rows", "times")], strict=True):
            at = np.repeat(np.searchsorted(pairs, unpacked(own.as_py())), unpacked(n.as_py()).astype(np.int64))
            row, many = unpacked(rows.as_py()).astype(np.int64), unpacked(times.as_py())
            sums, bests = (np.zeros(int(row.max()) + 1, dtype=np.uint64) for _ in range(2))
            np.add.at(sums, row, counts[at] * many)
            np.add.at(bests, row, best[at] * many)
            for name, value in (("spill", spill.as_py()), ("best", packed(bests)), ("sums", packed(sums))):
                out[name].append(value)
    return pa.table({"spill": pa.array(out["spill"], pa.int64()), "best": pa.array(out["best"], pa.binary()), "sums": pa.array(out["sums"], pa.binary())})


def _together(documents: pa.Table, parts: pa.Table) -> pa.Table:
    """The documents of a spill with the sums over all parts."""
    rows = documents["row"].to_numpy()
    totals = {"n_best": np.zeros(SPILL_DOCUMENTS, dtype=np.uint64), "count_sum": np.zeros(SPILL_DOCUMENTS, dtype=np.uint64)}
    for name, column in (("n_best", "best"), ("count_sum", "sums")):
        for blob in parts[column]:
            value = unpacked(blob.as_py())
            totals[name][: len(value)] += value
    found = {name: pa.array(value[rows].astype(np.int64)) for name, value in totals.items()}
    return pa.table({c: documents[c] for c in ("doc_id", *COUNTS)} | found | {"groups_sha256": documents["groups_sha256"]})


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a_path: str | None = None, b_path: str | None = None, spill_records: int = SPILL_RECORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A null or empty text, and one whose bytes the tokens of either side do not give back, has zeros and an empty
    digest. Rows with a null id and repeated rows are documents of their own, also for the counts; an empty table gives
    no rows; other columns are ignored.
    """
    table = spills(docs, text, doc_id, a_path or default_a_path(), b_path or default_b_path(), spill_records)
    documents = table.filter("part is null").select(*[c.split()[0] for c in DOCUMENTS.split(", ")])
    chunks = max(1, -(-documents.filter("row = 0").count() // FAN_IN))
    runs = table.filter("part is not null").select("spill", "part", "pairs", "counts", "rows", "times")
    runs = runs.withColumn("chunk", F.pmod(F.xxhash64("spill"), F.lit(chunks)))
    totals = count_pairs(runs).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    parts = runs.groupBy("part", "chunk").cogroup(totals.groupBy("part", "chunk")).applyInArrow(_contributions, "spill long, best binary, sums binary")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("spill").cogroup(parts.groupBy("spill")).applyInArrow(_together, schema)
