"""An adaptive context-mixing range coder for token ids; many blocks are coded side by side, one numpy lane each.

Every block starts from an empty model. An order-2 and an order-1 context each predict one id, with a small count of
how often they were right. Adaptive probabilities, chosen by these counts and by whether the contexts agree, are mixed
into the three shares of one coding step: order-2 prediction, order-1 prediction, neither. An id that neither predicts
is coded by the order-0 frequencies of the block so far (renewed each time the block has doubled), or, if new, after an
escape as 16 plain bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
CONTEXTS = 1 << 12
#: Slots of the order-0 table and the ids it is made from at most.
SLOTS, HISTORY = 1 << 13, 1 << 12
NOTHING = 1 << 16
TOP, BOTTOM = U(1 << 48), U(1 << 32)
ONE = 1 << 16


class Model:
    """The state of all lanes. The same calls in the same order bring coder and decoder to the same state."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.guess = np.full((2, lanes * CONTEXTS), NOTHING, dtype=np.int32)
        self.count = np.zeros((2, lanes * CONTEXTS), dtype=np.uint8)
        self.rate2 = np.full(lanes * 32, ONE // 4, dtype=np.int64)
        self.rate1 = np.full(lanes * 16, ONE // 4, dtype=np.int64)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids predicted by order 2 and 1, and their shares of ONE."""
        base = self.lane * CONTEXTS
        self.at1 = base + ((self.last * 40503 >> 4) & (CONTEXTS - 1))
        self.at2 = base + (((self.last * 40503 + self.before * 60493) >> 5) & (CONTEXTS - 1))
        two, one = self.guess[1].take(self.at2), self.guess[0].take(self.at1)
        self.count1, self.count2 = self.count[0].take(self.at1), self.count[1].take(self.at2)
        self.agree = two == one
        self.by1 = self.lane * 16 + self.count1
        self.by2 = self.lane * 32 + self.count2 * 2 + self.agree
        self.p1, self.p2 = self.rate1.take(self.by1), self.rate2.take(self.by2)
        share2 = np.where(two == NOTHING, 0, np.where(self.agree, (self.p1 + self.p2) >> 1, self.p2))
        share1 = np.where(self.agree | (one == NOTHING), 0, (ONE - share2) * self.p1 >> 16)
        self.two, self.one = two, one
        return two, one, share2, share1

    def learn(self, ids: np.ndarray) -> None:
        hit2, hit1 = self.two == ids, self.one == ids
        self.rate2[self.by2] = self.p2 + (np.where(hit2, ONE - 2048 - self.p2, 64 - self.p2) >> 5)
        tested = ~hit2 | self.agree
        self.rate1[self.by1] = np.where(tested, self.p1 + (np.where(hit1, ONE - 2048 - self.p1, 64 - self.p1) >> 5), self.p1)
        for order, at, hit, count in ((1, self.at2, hit2, self.count2), (0, self.at1, hit1, self.count1)):
            self.count[order][at] = np.where(hit, np.minimum(count + 1, 15), count >> 1)
            fresh = ~hit & (count == 0)
            self.guess[order][at[fresh]] = ids[fresh]
        self.before, self.last = self.last, ids


class Frequencies:
    """Order-0 table of each lane: SLOTS slots shared out by the counts of the ids so far; the rest is the escape."""

    def __init__(self, ids: np.ndarray):
        lanes, n = ids.shape
        flat = (np.arange(lanes)[:, None] * (NOTHING + 1) + np.sort(ids, axis=1)).reshape(-1)
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if n else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(first, len(flat)))
        owner = flat[first] // (NOTHING + 1)
        once = np.bincount(owner[counts == 1], minlength=lanes)
        kinds = np.bincount(owner, minlength=lanes)
        escape = np.clip(SLOTS * once // max(1, 2 * n), 64, SLOTS // 4)
        free = np.maximum(0, SLOTS - escape - kinds)
        sizes = 1 + counts * free[owner] // max(1, n)
        used = np.bincount(owner, weights=sizes, minlength=lanes).astype(np.int64)
        key = np.concatenate((flat[first], np.arange(lanes) * (NOTHING + 1) + NOTHING))
        size = np.concatenate((sizes, SLOTS - used))
        order = np.argsort(key, kind="stable")
        self.key, self.size = key[order], size[order]
        self.start = np.cumsum(self.size) - self.size - self.key // (NOTHING + 1) * SLOTS
        self.lanes = lanes

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and whether known, for ids of shape (lanes, n); an unknown id has those of the escape."""
        wanted = np.arange(self.lanes)[:, None] * (NOTHING + 1) + ids
        at = np.searchsorted(self.key, wanted)
        known = self.key[np.minimum(at, len(self.key) - 1)] == wanted
        at = np.where(known, at, np.searchsorted(self.key, np.arange(self.lanes) * (NOTHING + 1) + NOTHING)[:, None])
        return self.start[at], self.size[at], known

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, start and size by (lane, slot), flat."""
        at = np.repeat(np.arange(len(self.key)), self.size)
        return (self.key % (NOTHING + 1)).astype(np.int32)[at], self.start.astype(np.int32)[at], self.size.astype(np.int32)[at]


def renewals(length: int) -> list[int]:
    """Places in a block at which the order-0 table is made anew."""
    return [0, *[n for n in (1 << k for k in range(6, 13)) if n < length]]


class Coder:
    """Carry-less range coder: 64-bit low and range, words of 16 bits."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.low = np.zeros(lanes, dtype=U)
        self.range = np.full(lanes, (1 << 64) - 1, dtype=U)

    def _due(self) -> np.ndarray:
        same = (self.low ^ (self.low + self.range)) < TOP
        short = self.range < BOTTOM
        due = same | short
        cut = due & ~same
        if cut.any():
            self.range = np.where(cut, (U(0) - self.low) & (BOTTOM - U(1)), self.range)
        return due

    def narrow(self, step: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.low = self.low + step * start.astype(U)
        self.range = step * size.astype(U)


class Writer(Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.words = np.zeros((lanes, room), dtype="<u2")
        self.used = np.zeros(lanes, dtype=np.int64)

    def settle(self, only: np.ndarray | None = None) -> None:
        due = self._due()
        while due.any():
            at = np.flatnonzero(due)
            self.words[at, self.used[at]] = (self.low[at] >> U(48)).astype("<u2")
            self.used[at] += 1
            self.low[at] <<= U(16)
            self.range[at] <<= U(16)
            due = self._due()

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.words[self.lane, self.used] = (self.low >> U(48)).astype("<u2")
            self.used += 1
            self.low = self.low << U(16)
        return [self.words[i, : self.used[i]].tobytes() for i in self.lane]


class Reader(Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        room = max(len(p) for p in payloads) // 2 + 8
        self.words = np.zeros((len(payloads), room), dtype="<u2")
        for i, p in enumerate(payloads):
            self.words[i, : len(p) // 2] = np.frombuffer(p, dtype="<u2")
        self.code = np.zeros(len(payloads), dtype=U)
        self.used = np.full(len(payloads), 4, dtype=np.int64)
        for k in range(4):
            self.code = (self.code << U(16)) | self.words[:, k].astype(U)

    def settle(self) -> None:
        due = self._due()
        while due.any():
            at = np.flatnonzero(due)
            self.code[at] = (self.code[at] << U(16)) | self.words[at, self.used[at]].astype(U)
            self.used[at] += 1
            self.low[at] <<= U(16)
            self.range[at] <<= U(16)
            due = self._due()


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Code ids of shape (blocks, length), all below 2**16; a payload for each block."""
    lanes, length = ids.shape
    ids = ids.astype(np.int64)
    model, out = Model(lanes), Writer(lanes, 3 * length + 16)
    bounds = [*renewals(length), length]
    for begin, end in zip(bounds, bounds[1:], strict=False):
        starts, sizes, knowns = (x.T.copy() for x in Frequencies(ids[:, :begin][:, -HISTORY:]).of(ids[:, begin:end]))
        for i in range(begin, end):
            now = ids[:, i].copy()
            two, one, share2, share1 = model.predict()
            hit2 = (two == now) & (share2 > 0)
            hit1 = (one == now) & ~hit2 & (share1 > 0)
            rest = ~(hit2 | hit1)
            step = out.range >> U(16)
            start = np.where(hit2, 0, np.where(hit1, share2, share2 + share1))
            size = np.where(hit2, share2, np.where(hit1, share1, ONE - share2 - share1))
            out.narrow(step, start, size)
            step = np.where(rest, out.range >> U(13), out.range)
            out.narrow(step, np.where(rest, starts[i - begin], 0), np.where(rest, sizes[i - begin], 1))
            out.settle()
            new = rest & ~knowns[i - begin]
            if new.any():
                step = np.where(new, out.range >> U(16), out.range)
                out.narrow(step, np.where(new, now, 0), np.where(new, 1, 1))
                out.settle()
            model.learn(now)
    return out.finish()


def decode_blocks(payloads: list[bytes], length: int) -> np.ndarray:
    """The ids of blocks of equal length, of shape (blocks, length)."""
    lanes = len(payloads)
    ids = np.zeros((lanes, length), dtype=np.int64)
    model, source = Model(lanes), Reader(payloads)
    bounds = [*renewals(length), length]
    base = np.arange(lanes) * SLOTS
    for begin, end in zip(bounds, bounds[1:], strict=False):
        known, starts, sizes = Frequencies(ids[:, :begin][:, -HISTORY:]).slots()
        for i in range(begin, end):
            two, one, share2, share1 = model.predict()
            step = source.range >> U(16)
            place = np.minimum((source.code - source.low) // step, U(ONE - 1)).astype(np.int64)
            hit2 = place < share2
            hit1 = ~hit2 & (place < share2 + share1)
            rest = ~(hit2 | hit1)
            start = np.where(hit2, 0, np.where(hit1, share2, share2 + share1))
            size = np.where(hit2, share2, np.where(hit1, share1, ONE - share2 - share1))
            source.narrow(step, start, size)
            step = np.where(rest, source.range >> U(13), source.range)
            slot = base + np.minimum((source.code - source.low) // step, U(SLOTS - 1)).astype(np.int64)
            source.narrow(step, np.where(rest, starts.take(slot), 0), np.where(rest, sizes.take(slot), 1))
            source.settle()
            now = np.where(hit2, two, np.where(hit1, one, known.take(slot))).astype(np.int64)
            new = rest & (now == NOTHING)
            if new.any():
                step = np.where(new, source.range >> U(16), source.range)
                plain = np.minimum((source.code - source.low) // step, U(ONE - 1)).astype(np.int64)
                source.narrow(step, np.where(new, plain, 0), np.where(new, 1, 1))
                source.settle()
                now = np.where(new, plain, now)
            model.learn(now)
            ids[:, i] = now
    return ids
