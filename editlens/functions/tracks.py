"""Statistics of a recording's F0 frames over its spans, one vectorised pass per Arrow batch.

A recording's track stays in the row of its units, so frames meet spans without a shuffle: both ends of each span are
found by bisection in the track.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens import schemas
from editlens.functions.sequences import BLOCK_CELLS

SLACK = 1e-10
STATISTICS = schemas.struct(
    num_frames=schemas.INT, num_voiced=schemas.INT, total=schemas.DOUBLE, lo=schemas.DOUBLE, hi=schemas.DOUBLE,
    mean=schemas.DOUBLE, median=schemas.DOUBLE,
)


def bounds(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each row among the flattened values; a null row is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def column(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


def _first(t: np.ndarray, low: np.ndarray, high: np.ndarray, point: np.ndarray, after: np.ndarray) -> np.ndarray:
    """First place in ``[low, high)`` whose time is not before the point; where ``after``, whose time is past it."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        before = (t[middle] < point[live]) | (after[live] & (t[middle] == point[live]))
        low[live] = np.where(before, middle + 1, low[live])
        high[live] = np.where(before, high[live], middle)
        live = live[low[live] < high[live]]
    return low


def statistics(start, end, closed, ranked, owner, tracks: pa.ListArray) -> pa.StructArray:
    """Per span: frames whose centre it holds, and voiced statistics; null where no frame is voiced.

    The end of a span that is ``closed`` belongs to it. Medians are made where ``ranked``. ``owner`` is the row of a span.
    """
    frames = tracks.flatten()
    t, hz = column(frames, "t"), column(frames, "hz")
    row_from, row_to = bounds(tracks)
    row_of = np.repeat(np.arange(len(row_from)), row_to - row_from)
    if np.any((t[1:] < t[:-1]) & (row_of[1:] == row_of[:-1])):
        order = np.lexsort((t, row_of))
        t, hz = t[order], hz[order]
    low, high = row_from[owner], row_to[owner]
    first = _first(t, low, high, start - SLACK, np.zeros(len(owner), bool))
    last = np.maximum(first, _first(t, low, high, np.where(closed, end + SLACK, end - SLACK), closed))
    voiced = np.flatnonzero(hz > 0)
    pitch, rank = hz[voiced], np.concatenate([[0], np.cumsum(hz > 0)])
    begin, count = rank[first], rank[last] - rank[first]
    total, lo, hi, median = (np.zeros(len(owner)) for _ in range(4))
    for n in np.unique(count[count > 0]):
        same = np.flatnonzero(count == n)
        for some in np.array_split(same, len(same) * int(n) // BLOCK_CELLS + 1):
            block = pitch[begin[some][:, None] + np.arange(n)]
            total[some], lo[some], hi[some] = block.sum(axis=1), block.min(axis=1), block.max(axis=1)
            asked = ranked[some]
            median[some[asked]] = np.median(block[asked], axis=1) if asked.any() else 0.0
    silent = count == 0
    mean = np.divide(total, count, out=np.zeros(len(owner)), where=~silent)
    columns = [
        pa.array((last - first).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(total),
        *[pa.array(c, mask=silent) for c in (lo, hi, mean)], pa.array(median, mask=silent | ~ranked),
    ]
    return pa.StructArray.from_arrays(columns, STATISTICS.names)


def _times(units: pa.StructArray, *names: str) -> np.ndarray:
    (name,) = [n for n in names if units.type.get_field_index(n) >= 0]
    return column(units, name).astype(float)


def unit_statistics(units: pa.ListArray, durations: pa.Array, ranked: pa.ListArray, tracks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Units (places among all of the batch, ordinals) that hold a frame, and their statistics.

    Units are cut to their recording and count if they then have a positive length. A unit that reaches the end of its
    recording includes its last frame. Medians are made for the ordinals in ``ranked``, for all where that is null.
    """
    (begin, stop), flat = bounds(units), units.flatten()
    row = np.repeat(np.arange(len(begin)), stop - begin)
    length = durations.to_numpy(zero_copy_only=False).astype(float)[row]
    t0, t1 = _times(flat, "t0", "start"), _times(flat, "t1", "end")
    # As in SQL, greatest and least pass over what is missing.
    start, end = np.fmin(np.fmax(t0, 0.0), length), np.fmin(t1, length)
    asked = np.ones(len(row) + 1, bool)
    asked[:-1] = ~np.array(ranked.is_valid())[row]
    (rank_from, rank_to), ordinals = bounds(ranked), ranked.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(rank_from)), rank_to - rank_from)
    inside = ordinals < (stop - begin)[of]
    asked[(begin[of] + ordinals)[inside]] = True
    some = np.flatnonzero(end > start)
    found = statistics(start[some], end[some], (t1 >= length - SLACK)[some], asked[some], row[some], tracks)
    held = np.flatnonzero(column(found, "num_frames") > 0)
    some = some[held]
    return some, some - begin[row[some]], found.take(pa.array(held))


@F.arrow_udf(T.ArrayType(STATISTICS))
def _statistics_column(units: pa.Array, duration: pa.Array, ranked: pa.Array, track: pa.Array) -> pa.Array:
    """Statistics of a recording's units over its track (t, hz); null for a unit that holds no frame."""
    begin, stop = bounds(units)
    places, _, found = unit_statistics(units, duration, ranked, track)
    at = np.full(stop[-1] if len(stop) else 0, -1)
    at[places] = np.arange(len(places))
    offsets = np.concatenate([begin, stop[-1:]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), found.take(pa.array(at, mask=at < 0)), mask=pa.array(~np.array(units.is_valid())))


# Marked nondeterministic so that a filter on what is derived from it stays above it.
span_statistics = _statistics_column.asNondeterministic()
