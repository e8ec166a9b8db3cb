"""Measurements of cases over their units, one vectorised pass per Arrow batch.

A recording's units arrive nested in its row and are laid end to end here. Units of a text are in its order and do not
overlap, so the units that an edit touches are one stretch of them, whose ends are found by bisection: the work grows
with the units and edits of a batch, not with their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens import schemas
from editlens.functions.sequences import padded_distances
from editlens.functions.tracks import STATISTICS, bounds, column, unit_statistics

#: Keeps the character positions of different rows apart.
STEP = 1 << 40
MISSING_F0_SEMITONES = 8.0
ACOUSTIC_KINDS = ("pitch", "rate")

WARPED = schemas.struct(distance=schemas.DOUBLE, normalizer=schemas.DOUBLE)
PITCHED = schemas.struct(d=schemas.DOUBLE, n=schemas.DOUBLE, missing=schemas.BOOLEAN, none=schemas.BOOLEAN)
INTERVAL = schemas.struct(start=schemas.DOUBLE, end=schemas.DOUBLE)
#: ``voiced``: units with F0 in the source; ``heard``: all of them have one in the target; ``long`` and ``kept``: some
#: source unit has a length, and each that has one has a partner with a length.
OPERATION = schemas.struct(
    source=INTERVAL, target=INTERVAL, valid=schemas.BOOLEAN, voiced=schemas.INT, heard=schemas.BOOLEAN, shift=schemas.DOUBLE,
    long=schemas.BOOLEAN, kept=schemas.BOOLEAN,
)


def _numbers(values: pa.Array) -> np.ndarray:
    """As doubles, and one more that stands for nothing; NaN is null."""
    return np.append(values.to_numpy(zero_copy_only=False).astype(float), np.nan)


def _kinds(structs: pa.StructArray) -> np.ndarray:
    return np.array(structs.field("kind").to_pylist(), dtype=object)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


class Side:
    """Units of one side of a batch: character bounds, and times that are NaN where a unit has none."""

    def __init__(self, spans: pa.ListArray, units: pa.ListArray):
        span, self.units = spans.flatten(), units.flatten()
        self.begin, self.end = bounds(spans)
        self.row = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        self.place = np.arange(len(self.row)) - self.begin[self.row]
        self.a, self.b = (column(span, name).astype(np.int64) for name in ("start", "end"))
        self.pre, self.post = (column(span, name).astype(bool) for name in ("pre", "post"))
        self.key_a, self.key_b = self.row * STEP + self.a, self.row * STEP + self.b
        self.known = np.array(spans.is_valid()) & np.array(units.is_valid())
        self.at = self.place_in(units)
        self.t0, self.t1 = (np.append(_numbers(self.units.field(name))[self.at], np.nan) for name in ("start", "end"))
        self.long = self.t1 > self.t0

    def place_in(self, lists: pa.ListArray) -> np.ndarray:
        """For each unit its place among the values of lists as long as the units; -1 if the list is shorter."""
        first, last = bounds(lists)
        return np.where(self.place < (last - first)[self.row], first[self.row] + self.place, -1)

    def statistics(self, found: pa.ListArray, *names: str) -> list[np.ndarray]:
        """Statistics of each unit; NaN where it has none."""
        at, flat = self.place_in(found), found.flatten()
        present = np.append(np.array(flat.is_valid(), bool), False)[at] & (_numbers(flat.field("num_frames"))[at] > 0)
        return [np.append(np.where(present, _numbers(flat.field(name))[at], np.nan), np.nan) for name in names]

    def marked(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of units that an edit of [low, high) touches; an edited connector marks both sides."""
        first = np.searchsorted(self.key_b, row * STEP + low, "right")
        last = np.maximum(first, np.searchsorted(self.key_a, row * STEP + high, "left"))
        before, after = np.append(self.b, -1)[first - 1], np.append(self.a, -1)[last]
        left = (first > self.begin[row]) & (before == low) & np.append(self.post, False)[first - 1]
        right = (last < self.end[row]) & (after == high) & np.append(self.pre, False)[last]
        some = low < high
        return np.where(some, first - left, first), np.where(some, last + right, first)

    def interval(self, row: np.ndarray, low: np.ndarray, high: np.ndarray, duration: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Times of a span; a zero-width span gives the gap between its neighbours."""
        first = np.searchsorted(self.key_a, row * STEP + low, "left")
        last = np.searchsorted(self.key_b, row * STEP + high, "right")
        inside = first < last
        start, end = np.where(inside, self.t0[first], np.nan), np.where(inside, self.t1[last - 1], np.nan)
        left, right = self.neighbours(row, low)
        gap_start, gap_end = np.nan_to_num(self.t1[left], nan=0.0), np.where(np.isnan(self.t0[right]), duration, self.t0[right])
        return np.where(low < high, start, gap_start), np.where(low < high, end, gap_end)

    def neighbours(self, row: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last unit that ends at or before a point of the text and the first that begins there or later; -1: none."""
        left = np.searchsorted(self.key_b, row * STEP + point, "right") - 1
        right = np.searchsorted(self.key_a, row * STEP + point, "left")
        return np.where(left >= self.begin[row], left, -1), np.where(right < self.end[row], right, -1)

    def anchored(self, row: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Both neighbours that exist have a positive length, and at least one exists."""
        sides = self.neighbours(row, point)
        sound = [self.long[i] | np.isnan(self.t0[i]) | np.isnan(self.t1[i]) for i in sides]
        return ((sides[0] >= 0) | (sides[1] >= 0)) & sound[0] & sound[1]


class Edits:
    """Operations or regions of a batch."""

    def __init__(self, lists: pa.ListArray):
        self.begin, self.end = bounds(lists)
        self.row = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        flat = lists.flatten()
        self.kind = _kinds(flat)
        self.at = {name: column(flat, name).astype(np.int64) for name in ("src_start", "src_end", "tgt_start", "tgt_end")}

    def marked(self, side: Side, name: str) -> tuple[np.ndarray, np.ndarray]:
        return side.marked(self.row, self.at[f"{name}_start"], self.at[f"{name}_end"])


def _pairs(owner: np.ndarray, source: tuple, target: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and places of the pairs of two stretches each; -1 where the shorter one has no partner."""
    (s_first, s_last), (t_first, t_last) = source, target
    size = np.maximum(s_last - s_first, t_last - t_first)
    of = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    places = [np.where(first[of] + k < last[of], first[of] + k, -1) for first, last in (source, target)]
    return owner[of], *places


def preserved(ops: Edits, regions: Edits, source: Side, target: Side, scope: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and places of the kept unit pairs, plus those of the orthogonal kind, whose source unit has a length."""
    others, kept = ops.kind != scope, np.flatnonzero((regions.kind == "equal") | (regions.kind == scope))
    stretches, free = [], []
    for side, name in ((source, "src"), (target, "tgt")):
        first, last = ops.marked(side, name)
        change = np.zeros(len(side.row) + 1, np.int64)
        np.add.at(change, first[others], 1)
        np.add.at(change, last[others], -1)
        open_ = np.cumsum(change)[:-1] == 0
        rank = np.concatenate([[0], np.cumsum(open_)])
        stretches.append(tuple(rank[x[kept]] for x in regions.marked(side, name)))
        free.append(np.append(np.flatnonzero(open_), -1))
    row, s, t = _pairs(regions.row[kept], *stretches)
    s, t = (np.where(x < 0, -1, places[x]) for x, places in ((s, free[0]), (t, free[1])))
    # A unit that touches two regions gives its pair once, at the first place.
    _, place = np.unique((s + 1) * (len(target.row) + 1) + t + 1, return_index=True)
    place = np.sort(place)
    place = place[source.long[s[place]]]
    return row[place], s[place], t[place]


def _semitones(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    return 12.0 * (np.log(target / source) / np.log(2.0))


def _known(*sides: Side) -> np.ndarray:
    return np.logical_and.reduce([side.known for side in sides])


def _struct(kind: T.StructType, *columns: pa.Array) -> pa.StructArray:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, to_arrow_type(kind))], fields=list(to_arrow_type(kind)))


@F.arrow_udf(WARPED)
def duration_warp(ops: pa.Array, regions: pa.Array, s_spans: pa.Array, t_spans: pa.Array, s_units: pa.Array, t_units: pa.Array) -> pa.Array:
    """Warping distance of the kept units, and their summed lengths."""
    source, target = Side(s_spans, s_units), Side(t_spans, t_units)
    row, s, t = preserved(Edits(ops), Edits(regions), source, target, "pitch")
    rows = len(ops)
    coded = pa.concat_arrays([source.units.field("word"), target.units.field("word")]).dictionary_encode().indices
    codes = coded.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    s_at, t_at = source.at[s], np.where(t < 0, -1, np.append(target.at, -1)[t])
    s_word = codes[s_at] if len(s) else np.zeros(0, np.int64)
    t_word = np.append(codes, -2)[np.where(t_at < 0, len(codes), len(source.units) + t_at)]
    t_word = np.where(t_word < 0, -2, t_word)
    s_length = source.t1[s] - source.t0[s]
    t_length = np.maximum(0.0, np.nan_to_num(target.t1[t] - target.t0[t], nan=0.0))
    size = np.bincount(row, minlength=rows)
    at = np.cumsum(size) - size
    distance = padded_distances(s_word, s_length, at, size, t_word, t_length, at, size)
    norm = np.bincount(row, s_length, rows) + np.bincount(row, t_length, rows)
    lacking = ~_known(source, target)
    return _struct(WARPED, pa.array(distance), pa.array(norm, mask=lacking))


@F.arrow_udf(PITCHED)
def f0_errors(ops: pa.Array, regions: pa.Array, s_spans: pa.Array, t_spans: pa.Array, s_units: pa.Array, t_units: pa.Array, s_found: pa.Array, t_found: pa.Array) -> pa.Array:
    """Summed semitone errors of the kept units that are voiced in the source; a missing target costs the fixed penalty."""
    source, target = Side(s_spans, s_units), Side(t_spans, t_units)
    row, s, t = preserved(Edits(ops), Edits(regions), source, target, "rate")
    rows, names = len(ops), ("lo", "hi", "mean")
    of_source, of_target = source.statistics(s_found, *names), target.statistics(t_found, *names)
    none = np.bincount(row, minlength=rows) == 0
    voiced = ~np.isnan(of_source[2][s])
    row, s, t = row[voiced], s[voiced], t[voiced]
    missing = ~target.long[t] | np.isnan(of_target[2][t])
    lo, hi, mean = (np.abs(_semitones(y[t], x[s])) for x, y in zip(of_source, of_target))
    error = np.where(missing, MISSING_F0_SEMITONES, (lo + hi + mean) / 3)
    lacking = ~_known(source, target)
    count = np.bincount(row, minlength=rows).astype(float)
    columns = np.bincount(row, error, rows), count, np.bincount(row[missing], minlength=rows) > 0, none
    return _struct(PITCHED, *[pa.array(c, mask=lacking) for c in columns])


@F.arrow_udf(T.ArrayType(OPERATION))
def operation_measures(
    ops: pa.Array, s_spans: pa.Array, t_spans: pa.Array, s_units: pa.Array, t_units: pa.Array, s_found: pa.Array, t_found: pa.Array,
    s_duration: pa.Array, t_duration: pa.Array, whole: pa.Array,
) -> pa.Array:
    """Each operation with its intervals, anchors, pitch shift and the lengths of its units."""
    source, target, edits = Side(s_spans, s_units), Side(t_spans, t_units), Edits(ops)
    row, n, at = edits.row, len(edits.row), edits.at
    textual = np.isin(edits.kind, schemas.TEXT_KINDS)
    s_end, t_end = (_numbers(d)[row] for d in (s_duration, t_duration))
    start, end = source.interval(row, at["src_start"], at["src_end"], s_end)
    t_from, t_to = target.interval(row, at["tgt_start"], at["tgt_end"], t_end)
    entire = np.append(whole.fill_null(False).to_numpy(zero_copy_only=False).astype(bool), False)[row]
    t_from, t_to = np.where(entire, 0.0, t_from), np.where(entire, t_end, t_to)
    valid = (edits.kind == "pause") & target.anchored(row, at["tgt_start"])
    acoustic = np.flatnonzero(np.isin(edits.kind, ACOUSTIC_KINDS))
    stretches = [tuple(x[acoustic] for x in edits.marked(side, name)) for side, name in ((source, "src"), (target, "tgt"))]
    op, s, t = _pairs(acoustic, *stretches)
    (s_median,), (t_median,) = source.statistics(s_found, "median"), target.statistics(t_found, "median")
    voiced = source.long[s] & ~np.isnan(s_median[s])
    heard = target.long[t] & ~np.isnan(t_median[t])
    shifts = np.where(heard, _semitones(t_median[t], s_median[s]), 0.0)
    count = np.bincount(op[voiced], minlength=n)
    shift = np.divide(np.bincount(op[voiced], shifts[voiced], n), count, out=np.full(n, np.nan), where=count > 0)
    silent = np.bincount(op[voiced & ~heard], minlength=n) > 0
    long = np.bincount(op[source.long[s]], minlength=n) > 0
    unknown = ~long & (np.bincount(op[np.isnan(source.t0[s]) | np.isnan(source.t1[s])], minlength=n) > 0)
    lost = np.bincount(op[source.long[s] & ~target.long[t]], minlength=n) > 0
    lacking = ~_known(source, target)[row] | ~np.isin(edits.kind, ACOUSTIC_KINDS)
    spans = [
        pa.StructArray.from_arrays([_nullable(a), _nullable(b)], fields=[pa.field(x, pa.float64()) for x in ("start", "end")], mask=pa.array(textual))
        for a, b in ((start, end), (t_from, t_to))
    ]
    columns = [
        *spans, pa.array(valid), pa.array(count.astype(np.int32), mask=lacking), pa.array(~silent, mask=lacking), _nullable(shift),
        pa.array(long, mask=lacking | unknown), pa.array(~lost, mask=lacking),
    ]
    offsets = np.concatenate([edits.begin, edits.end[-1:]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _struct(OPERATION, *columns))


HELD = schemas.struct(ord=schemas.INT, x=STATISTICS)


def _held(units: pa.ListArray, duration: pa.Array, ranked: pa.ListArray, track: pa.ListArray) -> pa.ListArray:
    """Ordinals and statistics of a recording's units that hold a frame."""
    begin, stop = bounds(units)
    places, ordinals, found = unit_statistics(units, duration, ranked, track)
    rows = pa.StructArray.from_arrays([pa.array(ordinals.astype(np.int32)), found], HELD.names)
    offsets = np.searchsorted(places, np.concatenate([begin, stop[-1:]])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rows, mask=pa.array(~np.array(units.is_valid())))


def _covered(units: pa.ListArray, ops: pa.ListArray, name: str) -> pa.ListArray:
    """Ordinals of the timed units that a pitch operation covers, any number of times."""
    flat, (begin, stop) = units.flatten(), bounds(units)
    offsets = pa.array(np.concatenate([begin, stop[-1:]]).astype(np.int32))
    # Units without characters are at the end of their row.
    places = [pa.array(np.nan_to_num(column(flat, x).astype(float), nan=1 << 31).astype(np.int64)) for x in ("a", "b")]
    touch = [flat.field(x).fill_null(False) for x in ("pre", "post")]
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([*places, *touch], ["start", "end", "pre", "post"]))
    times = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat.field("word"), flat.field("t0"), flat.field("t1")], ["word", "start", "end"]))
    side, edits = Side(spans, times), Edits(ops)
    pitched = np.flatnonzero(edits.kind == "pitch")
    first, last = (x[pitched] for x in edits.marked(side, name))
    of = np.repeat(np.arange(len(pitched)), last - first)
    place = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    row = edits.row[pitched][of]
    counts = np.bincount(row, minlength=len(units))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array((place - begin[row]).astype(np.int32)))


@F.arrow_udf(T.ArrayType(HELD))
def _source_column(units: pa.Array, duration: pa.Array, ops: pa.Array, track: pa.Array) -> pa.Array:
    """Medians for the units of pitch operations."""
    return _held(units, duration, _covered(units, ops, "src"), track)


@F.arrow_udf(T.ArrayType(HELD))
def _target_column(units: pa.Array, duration: pa.Array, ops: pa.Array, track: pa.Array) -> pa.Array:
    return _held(units, duration, _covered(units, ops, "tgt"), track)


@F.arrow_udf(T.ArrayType(HELD))
def _every_column(units: pa.Array, duration: pa.Array, track: pa.Array) -> pa.Array:
    """Medians for all units."""
    return _held(units, duration, pa.nulls(len(units), pa.list_(pa.int32())), track)


# Marked nondeterministic so that a filter on what is derived from them stays above them.
pitched_statistics = {"source": _source_column.asNondeterministic(), "target": _target_column.asNondeterministic()}
every_statistics = _every_column.asNondeterministic()
