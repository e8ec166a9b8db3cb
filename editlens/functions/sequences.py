"""Dynamic programmes over short token sequences, one vectorised pass per Arrow batch.

Rows of similar size are padded into one numpy block, so a batch costs as many
array operations as its longest row has tokens. Rows too large for a block run
alone with memory linear in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from editlens import schemas

BLOCK_CELLS = 4_000_000
HIT, SUBSTITUTION, DELETION = 0, 1, 2
OP_NAMES = np.array(["H", "S", "D", "E"])


def _offsets(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), sizes


def _codes(left: pa.ListArray, right: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    a, b = left.flatten().cast(pa.string()), right.flatten().cast(pa.string())
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[: len(a)], codes[len(a) :]


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, fill) -> np.ndarray:
    """Rows ``flat[first:first+size]`` padded to ``width``."""
    column = np.arange(width)
    inside = column < sizes[:, None]
    out = np.full(inside.shape, fill, dtype=flat.dtype if len(flat) else np.int64)
    out[inside] = flat[(first[:, None] + column)[inside]]
    return out


def _affixes(ref, ref_at, n, hyp, hyp_at, m) -> tuple[np.ndarray, np.ndarray]:
    """Length of the common head and of the common tail that remains after it."""
    head = np.zeros_like(n)
    tail = np.zeros_like(n)
    for size, counts in ((np.minimum(n, m), head), (None, tail)):
        if size is None:
            size = np.minimum(n, m) - head
        active = np.flatnonzero(size > 0)
        while len(active):
            step = counts[active]
            if counts is head:
                same = ref[ref_at[active] + step] == hyp[hyp_at[active] + step]
            else:
                same = ref[ref_at[active] + n[active] - 1 - step] == hyp[hyp_at[active] + m[active] - 1 - step]
            active = active[same]
            counts[active] += 1
            active = active[counts[active] < size[active]]
    return head, tail


def _next_row(previous, ref_token, hyp, ramp):
    best = np.empty_like(previous)
    best[:, 0] = previous[:, 0] + 1
    np.minimum(previous[:, 1:] + 1, previous[:, :-1] + (hyp != ref_token[:, None]), out=best[:, 1:])
    return np.minimum.accumulate(best - ramp, axis=1) + ramp


def _trace_block(ref, n, hyp, m):
    """Edit path of padded rows: op and hypothesis position per token, insertions per gap."""
    rows, width, other = len(n), ref.shape[1], hyp.shape[1]
    ramp = np.arange(other + 1, dtype=np.int32)
    table = np.empty((width + 1, rows, other + 1), dtype=np.int32)
    table[0] = ramp
    for i in range(width):
        table[i + 1] = _next_row(table[i], ref[:, i], hyp, ramp)
    op = np.full((rows, width), DELETION, dtype=np.int8)
    at = np.full((rows, width), -1, dtype=np.int32)
    extra = np.zeros((rows, width + 1), dtype=np.int32)
    i, j = n.astype(np.int64), m.astype(np.int64)
    live = np.flatnonzero((i > 0) & (j > 0))
    # Ties: a deletion first, then an insertion, else the diagonal.
    while len(live):
        a, b = i[live], j[live]
        drop = table[a - 1, live, b] + 1 == table[a, live, b]
        add = ~drop & (b > 1) & (table[a, live, b - 1] == table[a - 1, live, b - 1] - 1)
        diagonal = ~drop & ~add
        extra[live[add], a[add]] += 1
        r, a1, b1 = live[diagonal], a[diagonal] - 1, b[diagonal] - 1
        op[r, a1] = np.where(ref[r, a1] == hyp[r, b1], HIT, SUBSTITUTION)
        at[r, a1] = b1
        i[live] = a - ~add
        j[live] = b - ~drop
        live = live[(i[live] > 0) & (j[live] > 0)]
    extra[:, 0] += j.astype(np.int32)
    return op, at, extra


def _trace_long(ref, hyp):
    """The same path for one long row, keeping every k-th table row only."""
    n, m = len(ref), len(hyp)
    step = max(1, int(np.sqrt(n)))
    ramp = np.arange(m + 1, dtype=np.int32)
    kept, row = {0: ramp[None].copy()}, ramp[None].copy()
    for i in range(n):
        row = _next_row(row, ref[i : i + 1], hyp[None], ramp)
        if (i + 1) % step == 0:
            kept[i + 1] = row
    op, at, extra = np.full(n, DELETION, np.int8), np.full(n, -1, np.int32), np.zeros(n + 1, np.int32)
    i, j, base, block = n, m, -1, None
    while i and j:
        start = (i - 1) // step * step
        if start != base:
            base, block = start, [kept[start]]
            for k in range(start, min(start + step, n)):
                block.append(_next_row(block[-1], ref[k : k + 1], hyp[None], ramp))
        here, above = block[i - base][0], block[i - 1 - base][0]
        if above[j] + 1 == here[j]:
            i -= 1
            continue
        j -= 1
        if j and here[j] == above[j] - 1:
            extra[i] += 1
            continue
        i -= 1
        op[i], at[i] = (HIT if ref[i] == hyp[j] else SUBSTITUTION), j
    extra[0] += j
    return op, at, extra


def _groups(a: np.ndarray, b: np.ndarray):
    """Row groups of similar size whose padded tables fit a block."""
    order = np.argsort(np.maximum(a, b), kind="stable")
    start = 0
    while start < len(order):
        side = max(8, int(max(a[order[start]], b[order[start]])) * 2) + 1
        stop = min(start + max(1, BLOCK_CELLS // (side * side)), len(order))
        sizes = np.maximum(a[order[start:stop]], b[order[start:stop]])
        stop = start + max(1, int(np.searchsorted(sizes, side)))
        yield order[start:stop]
        start = stop


def _paths(ref_lists: pa.ListArray, hyp_lists: pa.ListArray):
    """Edit paths of a batch, flat: row r owns the slots from ``slot[r]`` to ``slot[r + 1]``, the last one for the end.

    Gives the slots, op, hypothesis position and insertions of each slot, and both sizes of each row.
    """
    ref, hyp = _codes(ref_lists, hyp_lists)
    (ref_at, n), (hyp_at, m) = _offsets(ref_lists), _offsets(hyp_lists)
    head, tail = _affixes(ref, ref_at[:-1], n, hyp, hyp_at[:-1], m)
    # The path of all rows, flat; row r owns n[r] + 1 slots.
    slot = np.concatenate([[0], np.cumsum(n + 1)])
    op = np.full(slot[-1], HIT, dtype=np.int8)
    at = np.full(slot[-1], -1, dtype=np.int32)
    extra = np.zeros(slot[-1], dtype=np.int32)
    row_of = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(slot[-1]) - slot[row_of]
    at[:] = np.where(place < head[row_of], place, place + (m - n)[row_of])
    core_n, core_m = n - head - tail, m - head - tail
    for rows in _groups(core_n, core_m):
        a, b = core_n[rows], core_m[rows]
        width, other = int(a.max(initial=0)), int(b.max(initial=0))
        if width == 0 and other == 0:
            continue
        r_at, h_at = ref_at[rows] + head[rows], hyp_at[rows] + head[rows]
        if len(rows) == 1 and width * other > BLOCK_CELLS:
            o, h, e = _trace_long(ref[r_at[0] : r_at[0] + a[0]], hyp[h_at[0] : h_at[0] + b[0]])
            o, h, e = o[None], h[None], e[None]
        else:
            o, h, e = _trace_block(_gather(ref, r_at, a, width, -1), a, _gather(hyp, h_at, b, other, -2), b)
        inside = np.arange(width) < a[:, None]
        target = (slot[rows] + head[rows])[:, None] + np.arange(width + 1)
        op[target[:, :-1][inside]] = o[inside]
        shifted = np.where(h < 0, -1, h + head[rows][:, None].astype(np.int32))
        at[target[:, :-1][inside]] = shifted[inside]
        gaps = np.arange(width + 1) <= a[:, None]
        extra[target[gaps]] += e[gaps]
    at[slot[1:] - 1] = -1
    return slot, op, at, extra, n, m


def _sums(slot: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, slot[:-1]).astype(np.int32) if len(slot) > 1 else np.zeros(0, np.int32)


def _counts(slot, op, extra, n, m) -> list[np.ndarray]:
    """Substitutions, deletions, insertions, hits and both sizes per row."""
    inner = np.ones(len(op), bool)
    inner[slot[1:] - 1] = False
    hits, subs, dels = (_sums(slot, ((op == kind) & inner).astype(np.int32)) for kind in (HIT, SUBSTITUTION, DELETION))
    return [subs, dels, _sums(slot, extra), hits, n.astype(np.int32), m.astype(np.int32)]


def edit_paths(ref_lists: pa.ListArray, hyp_lists: pa.ListArray) -> pa.StructArray:
    slot, op, at, extra, n, m = _paths(ref_lists, hyp_lists)
    names = op.copy()
    names[slot[1:] - 1] = 3
    path = pa.StructArray.from_arrays(
        [pa.array(OP_NAMES[names], pa.string()), pa.array(at), pa.array(extra)], ["op", "hyp", "ins"]
    )
    columns = _counts(slot, op, extra, n, m)
    return pa.StructArray.from_arrays(
        [pa.array(c) for c in columns] + [pa.ListArray.from_arrays(pa.array(slot.astype(np.int32)), path)],
        ["substitutions", "deletions", "insertions", "hits", "ref_length", "hyp_length", "path"],
    )


def _regions(counts: list[np.ndarray], mask: np.ndarray | None = None) -> pa.StructArray:
    """Counts (substitutions, deletions, insertions, hits) as rows of ``schemas.REGION_ERRORS``."""
    s, d, i, h = (c.astype(np.int64) for c in counts)
    rate = np.divide(s + d + i, s + d + h, out=np.zeros(len(s)), where=s + d + h > 0)
    columns = [pa.array(rate)] + [pa.array(c.astype(np.int32)) for c in (s, d, i, h, s + d + h, s + h + i)]
    fields = list(to_arrow_type(schemas.REGION_ERRORS))
    mask = None if mask is None else pa.array(mask)
    return pa.StructArray.from_arrays([*columns, pa.array(["mixed"] * len(s), pa.string())], fields=fields, mask=mask)


def local_counts(paths: tuple, ops: pa.ListArray, lo: pa.ListArray, hi: pa.ListArray, context: int) -> pa.StructArray:
    """Counts near the text edits of a row, away from them, and near each of them.

    ``lo`` and ``hi`` are the token bounds of each operation. Insertions at the end of a text count with its last position, so a
    text splits without remainder. Prefix sums over the positions give the counts of a window at its two ends.
    """
    slot, op, _, extra, n, _ = paths
    rows = len(n)
    inner = np.ones(len(op), bool)
    inner[slot[1:] - 1] = False
    inserted = extra.astype(np.int64)
    some = np.flatnonzero(n > 0)
    inserted[slot[1:][some] - 2] += inserted[slot[1:][some] - 1]
    inserted[slot[1:] - 1] = 0
    marks = [((op == SUBSTITUTION) & inner), ((op == DELETION) & inner), inserted, ((op == HIT) & inner)]
    totals = [np.concatenate([[0], np.cumsum(m, dtype=np.int64)]) for m in marks]
    sizes = ops.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(rows), sizes)
    text = np.isin(np.array(ops.flatten().field("kind").to_pylist(), dtype=object), schemas.TEXT_KINDS)
    low, high = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lo, hi))
    first = slot[row] + np.clip(low - context, 0, n[row])
    last = np.maximum(first, slot[row] + np.clip(high + context, 0, n[row]))
    own = [t[last] - t[first] for t in totals]
    change = np.zeros(len(op) + 1, np.int64)
    np.add.at(change, first[text], 1)
    np.add.at(change, last[text], -1)
    covered = np.cumsum(change)[:-1] > 0
    edit = [_sums(slot, np.where(covered, m, 0).astype(np.int64)) for m in marks]
    other = [_sums(slot, np.where(covered, 0, m).astype(np.int64)) for m in marks]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    bounds = [pa.array(text), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
    places = pa.StructArray.from_arrays(bounds, fields=list(to_arrow_type(schemas.TOKEN_BOUNDS)))
    lists = [pa.ListArray.from_arrays(pa.array(offsets), values) for values in (_regions(own, ~text), places)]
    return pa.StructArray.from_arrays([_regions(edit), _regions(other), *lists], fields=list(to_arrow_type(schemas.LOCAL_ERRORS)))


@F.arrow_udf(schemas.ERROR_COUNTS)
def align_tokens(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Unit-cost alignment of two token arrays: counts and the path per reference token."""
    return edit_paths(ref, hyp)


@F.arrow_udf(schemas.LOCAL_ERRORS)
def align_locally(ref: pa.Array, hyp: pa.Array, ops: pa.Array, lo: pa.Array, hi: pa.Array, context: pa.Array) -> pa.Array:
    """Alignment of two token arrays and its counts around the text edits, see ``local_counts``."""
    return local_counts(_paths(ref, hyp), ops, lo, hi, context[0].as_py() if len(context) else 0)


@F.arrow_udf(schemas.ALL_ERRORS)
def align_both(
    ref: pa.Array, hyp: pa.Array, ops: pa.Array, lo: pa.Array, hi: pa.Array, context: pa.Array, own_ref: pa.Array, own_hyp: pa.Array
) -> pa.Array:
    """``align_locally``, and the counts of the row's own tokens; where these are null they are the first two."""
    paths = _paths(ref, hyp)
    slot, op, _, extra, n, m = paths
    counts = _counts(slot, op, extra, n, m)
    other = np.flatnonzero(np.array(own_ref.is_valid()) | np.array(own_hyp.is_valid()))
    if len(other):
        slot, op, _, extra, n, m = _paths(own_ref.take(pa.array(other)), own_hyp.take(pa.array(other)))
        for column, values in zip(counts, _counts(slot, op, extra, n, m)):
            column[other] = values
    whole = pa.StructArray.from_arrays([pa.array(c) for c in counts], fields=list(to_arrow_type(schemas.COUNTS)))
    local = local_counts(paths, ops, lo, hi, context[0].as_py() if len(context) else 0)
    return pa.StructArray.from_arrays([whole, local], fields=list(to_arrow_type(schemas.ALL_ERRORS)))


def duration_distances(sw: pa.ListArray, sd: pa.ListArray, tw: pa.ListArray, td: pa.ListArray) -> np.ndarray:
    words_s, words_t = _codes(sw, tw)
    (s_at, n), (t_at, m) = _offsets(sw), _offsets(tw)
    dur_s = sd.flatten().to_numpy(zero_copy_only=False)
    dur_t = td.flatten().to_numpy(zero_copy_only=False)
    return padded_distances(words_s, dur_s, s_at[:-1], n, words_t, dur_t, t_at[:-1], m)


def padded_distances(words_s, dur_s, s_at, n, words_t, dur_t, t_at, m) -> np.ndarray:
    """Warping cost of rows that lie end to end: words as codes, durations, first place and size of each row, per side."""
    out = np.zeros(len(n))
    for rows in _groups(n, m):
        a, b = n[rows], m[rows]
        width, other = int(a.max(initial=0)), int(b.max(initial=0))
        ws, ds = _gather(words_s, s_at[rows], a, width, -1), _gather(dur_s, s_at[rows], a, width, 0.0)
        wt, dt = _gather(words_t, t_at[rows], b, other, -2), _gather(dur_t, t_at[rows], b, other, 0.0)
        out[rows] = _warp(ws, ds, a, wt, dt, b)
    return out


def _warp(ws, ds, n, wt, dt, m) -> np.ndarray:
    """Warping cost per padded row, one anti-diagonal at a time."""
    rows, width, other = len(n), ws.shape[1], wt.shape[1]
    result = np.zeros(rows)
    # A side without units costs every unit of the other side as unmatched.
    for size, durations, empty in ((m, dt, n == 0), (n, ds, m == 0)):
        if empty.any() and durations.shape[1]:
            total = np.cumsum(np.where(np.arange(durations.shape[1]) < size[:, None], durations + 1.0, 0.0), axis=1)
            result = np.where(empty, total[:, -1], result)
    before = np.full((rows, width + 1), np.inf)
    before[:, 0] = 0.0
    last = np.full((rows, width + 1), np.inf)
    for d in range(2, width + other + 1):
        lo, hi = max(1, d - other), min(width, d - 1)
        now = np.full((rows, width + 1), np.inf)
        if lo <= hi:
            i = np.arange(lo, hi + 1)
            a, b = ds[:, i - 1], dt[:, d - i - 1]
            cost = np.where(ws[:, i - 1] == wt[:, d - i - 1], np.abs(a - b), a + b + 1.0)
            best = np.minimum(np.minimum(last[:, i - 1], last[:, i]), before[:, i - 1])
            now[:, i] = cost + best
        done = np.flatnonzero((n + m == d) & (n > 0) & (m > 0))
        result[done] = now[done, n[done]]
        before, last = last, now
    return result


@F.arrow_udf(schemas.DOUBLE)
def warp_distance(sw: pa.Array, sd: pa.Array, tw: pa.Array, td: pa.Array) -> pa.Array:
    return pa.array(duration_distances(sw, sd, tw, td))
