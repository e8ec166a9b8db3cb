"""Removal of long repeated byte strings: windows of equal bytes are found by hashes of stretches around their anchors.

This takes the place of a merge of the shards' Burrows-Wheeler transforms, which was not built and so not measured: no
suffix order, no transform, no interleave and no common prefixes are made. The reason was an estimate of the merge's
CPU time (README). What is done instead: windows are grouped by hashes at three growing lengths, and a window that is
alone in its group leaves. The results are those of comparing all windows, up to collisions of hashes.

- Windows are followed in runs. Each 400-byte window has an anchor, its smallest 64-byte gram (the last of equal ones);
  equal windows have equal anchors in equal places, so neighbouring windows of one anchor stay together.
- The lengths are 273 bytes (what 128 neighbouring windows of an anchor share), 385 bytes (16 windows) and 400 bytes.
- Tasks send the sizes of their groups, which are added up before and after the shuffle, never lists of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.llm.common import stored

#: Length of a repeated string, of an anchor, and numbers of neighbouring windows in a stretch and in a wide one.
LENGTH, GRAM, STRETCH, WIDE = 400, 64, 16, 128
SPAN = LENGTH - GRAM + 1
CORE = LENGTH - STRETCH + 1
#: Window starts looked at together, so that memory is bounded for a text of any length.
CHUNK = 1 << 18
PLACE = (1 << 28) - 1
U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8")[:, 0]
    n = len(data) - GRAM + 1
    h = np.zeros(n, dtype=U)
    for at in range(0, GRAM, 8):
        h = (h ^ words[at : at + n]) * U(0x9E3779B185EBCA87)
        h ^= h >> U(29)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by minima from both ends of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash and place of each anchor, and first and last of the window starts that have it."""
    starts = len(data) - LENGTH + 1
    for at in range(0, starts, CHUNK):
        n = min(CHUNK, starts - at)
        part = np.frombuffer(data, dtype=np.uint8, count=n + LENGTH - 1, offset=at)
        hashes = gram_hashes(part)
        order = (hashes & ~U(PLACE)) | (U(PLACE) - np.arange(len(hashes), dtype=U))
        places = PLACE - (window_minimum(order, SPAN) & U(PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        last = np.append(first[1:], n) - 1
        yield hashes[places[first]], places[first] + at, first + at, last + at


def _record(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["core", "whole", "k1", "k2", "anchor", "low", "high"]
    types = [pa.int64()] * 7
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, text in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"], strict=True):
            data = _data(text.as_py())
            for _, places, lows, highs in anchors(data):
                for place, first, last in zip(places.tolist(), lows.tolist(), highs.tolist(), strict=True):
                    for b in range((place - last) // WIDE, (place - first) // WIDE + 1):
                        base = place - b * WIDE
                        low, high = max(first, base - WIDE + 1), min(last, base)
                        core = xxhash.xxh3_64_intdigest(data[base : base + LENGTH - WIDE + 1], b) - (1 << 63)
                        whole = xxhash.xxh3_64_intdigest(data[low : high + LENGTH], base - low) - (1 << 63)
                        rows.append((core, whole, k1, k2, place, low, high))
            if len(rows) > 100_000:
                yield _record(names, types, rows)
                rows = []
        if rows:
            yield _record(names, types, rows)


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of 16 window starts, on a grid that begins at the anchor and goes left."""
    names = ["core", "whole", "head", "tail", "k1", "k2", "base", "near", "far"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.binary()] + [pa.int64()] * 5
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, text, runs in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"], batch["runs"], strict=True):
            data = _data(text.as_py())
            for run in runs.as_py():
                anchor, low, high = run["anchor"], run["low"], run["high"]
                for b in range((anchor - high) // STRETCH, (anchor - low) // STRETCH + 1):
                    base = anchor - b * STRETCH  # the stretch has the starts base - far ... base - near
                    near, far = max(0, base - high), min(STRETCH - 1, base - low)
                    head, tail = data[max(0, base - far) : base], data[base + CORE : base + LENGTH - near]
                    core = xxhash.xxh3_128_digest(data[base : base + CORE], b)
                    whole = xxhash.xxh3_64_intdigest(head + b"|" + tail, near * STRETCH + far) - (1 << 63)
                    rows.append((core, whole, head, tail, k1, k2, base, near, far))
            if len(rows) > 50_000:
                yield _record(names, types, rows)
                rows = []
        if rows:
            yield _record(names, types, rows)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, end in sorted((s["low"], s["end"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((low, end))
    return out


def _refined(suffixes: DataFrame, *prefix: str) -> tuple[DataFrame, DataFrame]:
    """Intervals of equal prefix with two suffixes or more: those that agree in ``whole``, and those that part later."""
    sizes = suffixes.groupBy(*prefix).agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lowest"), F.max("whole").alias("highest")).filter("n > 1")
    # Stored, because both parts are read, in different jobs, and most suffixes are gone.
    shared = stored(suffixes.join(sizes, list(prefix)))
    return shared.filter("lowest = highest"), shared.filter("lowest <> highest")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``(k1, k2, spans)``: byte ranges covered by a string of LENGTH bytes that also starts elsewhere.

    ``keyed`` has ``k1``, ``k2`` (never null), ``text`` and perhaps more; rows of equal keys have equal texts.
    """
    found = stored(keyed.select("k1", "k2", "text").mapInArrow(_find_anchors, "core long, whole long, k1 long, k2 long, anchor long, low long, high long"))
    equal1, open1 = _refined(found, "core")
    spans1 = equal1.select("k1", "k2", "low", (F.col("high") + LENGTH).alias("end"))
    runs = open1.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "low", "high")).alias("runs"))
    # Each document of equal keys is cut by itself.
    joined = keyed.select("k1", "k2", "text").join(runs, ["k1", "k2"])
    schema = "core binary, whole long, head binary, tail binary, k1 long, k2 long, base long, near long, far long"
    cut = stored(joined.mapInArrow(_cut_stretches, schema))
    equal2, open2 = _refined(cut, "core")
    spans2 = equal2.select("k1", "k2", (F.col("base") - F.col("far")).alias("low"), (F.col("base") - F.col("near") + LENGTH).alias("end"))
    single = open2.withColumn("d", F.explode(F.sequence("near", "far"))).withColumns(
        {
            "before": F.substr("head", F.length("head") - F.col("d").cast("int") + 1, F.col("d").cast("int")),
            "after": F.substr("tail", F.lit(1), F.lit(STRETCH - 1) - F.col("d").cast("int")),
        }
    )
    single = single.select("core", "d", "before", "after", "k1", "k2", (F.col("base") - F.col("d")).alias("low"))
    sizes = single.groupBy("core", "d", "before", "after").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spans3 = single.join(sizes, ["core", "d", "before", "after"]).select("k1", "k2", "low", (F.col("low") + LENGTH).alias("end"))
    spans = spans1.union(spans2).union(spans3).groupBy("k1", "k2")
    return stored(spans.agg(F.collect_set(F.struct("low", "end")).alias("spans")))


def keys(doc_id: str, text: str) -> dict[str, Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return {"k1": F.xxhash64(F.col(doc_id), body), "k2": F.crc32(body.cast("binary"))}


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Remove each byte that is covered by a string of LENGTH bytes that starts a second time anywhere in the table.

    Gives a row for each input row: ``doc_id, n_bytes, n_removed, spans`` (removed ranges, maximal and in order) and
    ``kept`` (the remaining bytes). Texts are UTF-8 bytes and matches never cross documents; a second start may be in
    the same document and may overlap; everything is judged on the input. Null texts count as empty. Rows of equal id
    and text are separate documents of equal text. Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[c.alias(k) for k, c in keys(doc_id, text).items()])
    spans = repeated_spans(keyed)
    id_type = dict(keyed.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("low", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_bytes, n_removed, spans_, kept = [], [], [], []
            for text_, found in zip(batch["text"], batch["spans"], strict=True):
                data = _data(text_.as_py())
                merged = _merged(found.as_py() or [])
                edges = [0, *(x for span in merged for x in span), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                spans_.append([{"low": a, "end": b} for a, b in merged])
                kept.append(rest)
            arrays = [batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    rows = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, spans array<struct<low: long, end: long>>, kept binary")
