"""Byte-level BPE by ranks: higher-order functions fold the merges of distinct words, and decoding concatenates pieces.

A Python worker splits texts into words and sends each word on once (for each stretch of texts of a task). Spark's
higher-order functions encode these words; a second worker puts the ids of the words together again. The three steps
are one stage without a shuffle, and what the workers remember is bounded by KNOWN.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.llm.tokens import CUT, ODD, SEGMENT

#: Distinct words and distinct stretches between spaces that a worker remembers at a time.
KNOWN = 600_000
BUCKETS = 1 << 16
#: Ranks are kept above an index of this many bits, so that the least of an array is the leftmost of the lowest rank.
INDEX_BITS = 20
NO_RANK = ((1 << 31) - 1) << INDEX_BITS
FLUSH = 1 << 22
#: A fold copies a word's pieces in each step. Words of more bytes are merged with a heap in the worker that splits.
LONG_WORD = 400


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by the bytes of a piece; every single byte must have one."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the rank file lacks single bytes")
    return ranks


@functools.lru_cache(maxsize=2)
def _rank_json(path: str) -> str:
    """The rank map in buckets of a hash. Bytes are written as ISO-8859-1 letters, one for each."""
    buckets: list[dict[str, int] | None] = [None] * BUCKETS
    for piece, rank in read_ranks(path).items():
        letters = piece.decode("latin-1")
        at = xxhash.xxh64_intdigest(letters.encode(), seed=42) & (BUCKETS - 1)
        buckets[at] = (buckets[at] or {}) | {letters: rank << INDEX_BITS}
    return json.dumps(buckets)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(words: Column, path: str | None = None) -> Column:
    """Ids of each word (``array<string>``, a byte as an ISO-8859-1 letter) by ranked merges: ``array<array<int>>``.

    A word that is a piece has the id of it. Else its bytes are folded: in each step, the leftmost adjacent pair of the
    lowest rank becomes one piece, and only the ranks of the two new pairs are looked up. An empty word has no ids; a
    word may have up to 2^20 bytes.
    """
    none = F.array().cast("array<bigint>")

    def with_ranks(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            bucket = F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
            return F.coalesce(F.try_element_at(bucket, piece), F.lit(NO_RANK))

        def piece_id(ranked: Column) -> Column:
            return F.shiftright(ranked, INDEX_BITS).cast("int")

        def one(word: Column) -> Column:
            n = F.char_length(word)
            pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2))))

            def step(state: Column, _: Column) -> Column:
                # Each value is bound by a fold over one element, which, unlike a transform, does not copy the state.
                def bound(value: Column, body: Callable[[Column], Column]) -> Column:
                    return F.aggregate(F.array(value), state, lambda _, found: body(found))

                parts, ranks = state["parts"], state["ranks"]

                def merge(i: Column) -> Column:
                    def put(joined: Column) -> Column:
                        before = F.when(i > 1, F.array(rank(F.concat(F.get(parts, i - 2), joined)))).otherwise(none)
                        after = F.when(i + 1 < F.size(parts), F.array(rank(F.concat(joined, F.get(parts, i + 1))))).otherwise(none)
                        return F.struct(
                            F.flatten(F.array(F.slice(parts, F.lit(1), i - 1), F.array(joined), F.slice(parts, i + 2, n))).alias("parts"),
                            F.flatten(F.array(F.slice(ranks, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(ranks, i + 2, n))).alias("ranks"),
                        )

                    return bound(F.concat(F.get(parts, i - 1), F.get(parts, i)), put)

                def lowest(found: Column) -> Column:
                    return F.when(found < NO_RANK, bound(found.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).cast("int"), merge)).otherwise(state)

                return bound(F.array_min(F.transform(ranks, lambda r, i: r.bitwiseOR(i + 1))), lowest)

            start = F.struct(F.split(word, "").alias("parts"), pairs.alias("ranks"))
            folded = F.aggregate(F.sequence(F.lit(2), n), start, step, lambda s: F.transform(s["parts"], lambda p: piece_id(rank(p))))
            whole = _let(rank(word), lambda found: F.when(found < NO_RANK, F.array(piece_id(found))).otherwise(folded))
            return F.when(n > 0, whole).otherwise(F.array().cast("array<int>"))

        return F.transform(words, one)

    return _let(F.from_json(F.lit(_rank_json(path or default_path())), "array<map<string,bigint>>"), with_ranks)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids of a long word, the same merges with a heap of pairs. A place holds the end of the piece that begins there."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))

    def pair(a: int) -> int | None:
        return ranks.get(word[a : end[end[a]]]) if end[a] < n else None

    heap = [(r, a, 2) for a in range(n - 1) if (r := pair(a)) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, size = heapq.heappop(heap)
        if end[a] <= a or end[a] >= n or end[end[a]] - a != size:
            continue  # one of both pieces has become part of another
        b = end[a]
        end[a], end[b] = end[b], -1
        if end[a] < n:
            before[end[a]] = a
        for c in (a, before[a]):
            if c >= 0 and (r := pair(c)) is not None:
                heapq.heappush(heap, (r, c, end[end[c]] - c))
    out, at = array.array("I"), 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out.tobytes()


class Splitter:
    """Words of texts as numbers. A text gives the numbers of its words and the words that have not been sent yet."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], known: int = KNOWN):
        import regex

        self.ranks = ranks
        self.long: list[bytes] = []
        self.find = regex.compile(pattern).findall
        self.most = known
        self.number: dict[str, int] = {}
        self.cache: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def _words(self, piece: str) -> bytes:
        number, fresh = self.number, self.fresh
        out = array.array("I")
        for word in self.find(piece):
            n = number.get(word)
            if n is None:
                n = number[word] = len(number)
                raw = word.encode()
                if len(raw) > LONG_WORD and raw not in self.ranks:
                    self.long.append(merge_long(raw, self.ranks))
                    raw = b""
                fresh.append(raw.decode("latin-1"))
            out.append(n)
        return out.tobytes()

    def _new(self, piece: str) -> bytes:
        numbers = self.cache[piece] = self._words(" " + piece)
        return numbers

    def split(self, text: str) -> tuple[bool, bytes, list[str], list[bytes]]:
        """Whether all earlier words are forgotten, the numbers of the words, the new words, and the ids of long ones.

        A long word is empty among the new words.

        A space before something else than white space begins a word, so a text is cut there and pieces are cached.
        """
        forget = len(self.number) > self.most or len(self.cache) > self.most
        if forget:
            self.number.clear()
            self.cache.clear()
        self.fresh, self.long = [], []
        head, *rest = CUT.split(text, maxsplit=1)
        out, at, body = [self._words(head)], 0, rest[0] if rest else None
        while body is not None and at <= len(body):
            cut = CUT.search(body, at + SEGMENT)
            end = cut.start() if cut else len(body)
            part = body[at:end]
            pieces = CUT.split(part) if ODD.search(part) else part.split(" ")
            found, get, new = list(map(self.cache.get, pieces)), self.cache.get, self._new
            if None in found:
                found = [v if v is not None else get(p) or new(p) for p, v in zip(pieces, found, strict=True)]
            out += found
            at = end + 1
        return forget, b"".join(out), self.fresh, self.long


def _batch(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str | None = None, known: int = KNOWN) -> DataFrame:
    """Ids of whole texts: ``doc_id, n_tokens, ids array<int>, ids_sha256``, a row for each row of ``docs``.

    Each match of the pattern is encoded by itself, without special tokens. A null or empty text has no ids; rows with
    a null id and repeated rows are encoded like others; an empty table gives no rows; other columns are ignored. A text
    is split as a whole, in stretches of bounded length. ``ids_sha256`` is over little-endian unsigned 32-bit integers.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern, read_ranks(path), known)
        types = [pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary())]
        names = ["doc_id", "forget", "numbers", "words", "long"]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            held = 0
            for doc, value in zip(batch["doc_id"], batch["text"], strict=True):
                row = (doc.as_py(), *splitter.split(value.as_py() or ""))
                for column, cell in zip(columns, row, strict=True):
                    column.append(cell)
                held += len(row[2]) + 16 * len(row[3])
                if held > FLUSH:
                    yield _batch(columns, types, names)
                    columns, held = [[] for _ in names], 0
            if columns[0]:
                yield _batch(columns, types, names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes] = []

        def out(docs_: list, ids: list[bytes]) -> pa.RecordBatch:
            sizes = [len(x) // 4 for x in ids]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(ids))])
            digests = [hashlib.sha256(x).hexdigest() for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(digests)], ["doc_id", "n_tokens", "ids", "ids_sha256"]
            )

        for batch in batches:
            words = batch["encoded"]
            first, inner = words.offsets.to_pylist(), words.values
            ends = inner.offsets.to_numpy()
            data = np.asarray(inner.values.to_numpy(zero_copy_only=False), dtype="<i4").tobytes()
            docs_, ids, held = [], [], 0
            for i, (doc, forget, numbers) in enumerate(zip(batch["doc_id"].to_pylist(), batch["forget"].to_pylist(), batch["numbers"], strict=True)):
                if forget:
                    table.clear()
                cuts = (4 * ends[first[i] : first[i + 1] + 1]).tolist()
                long = iter(batch["long"][i].as_py())
                table += [data[a:b] if b > a else next(long) for a, b in zip(cuts, cuts[1:], strict=False)]
                found = b"".join(map(table.__getitem__, np.frombuffer(numbers.as_py(), dtype="<u4").tolist()))
                docs_.append(doc)
                ids.append(found)
                held += len(found)
                if held > FLUSH:
                    yield out(docs_, ids)
                    docs_, ids, held = [], [], 0
            if docs_:
                yield out(docs_, ids)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = given.mapInArrow(split, "doc_id long, forget boolean, numbers binary, words array<string>, long array<binary>")
    encoded = words.select("doc_id", "forget", "numbers", "long", encode_words(F.col("words"), path).alias("encoded"))
    return encoded.mapInArrow(join, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string")


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of ids: their pieces put together. A null array gives null, an id without a piece gives nothing."""
    ranks = read_ranks(path or default_path())
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    letters = _let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return F.encode(letters, "ISO-8859-1")
