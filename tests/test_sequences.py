import random

import numpy as np
import pyarrow as pa
import pytest

from editlens.functions import sequences


def reference_path(ref, hyp):
    """Alignment by the full table: common ends first, then deletion, insertion, diagonal."""
    head = 0
    while head < min(len(ref), len(hyp)) and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < min(len(ref), len(hyp)) - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    r, h = ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]
    d = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
    ops = ["H"] * head + ["D"] * len(r) + ["H"] * tail
    extra = [0] * (len(ref) + 1)
    i, j = len(r), len(h)
    while i and j:
        if d[i - 1][j] + 1 == d[i][j]:
            i -= 1
            continue
        j -= 1
        if j and d[i][j] == d[i - 1][j] - 1:
            extra[head + i] += 1
            continue
        i -= 1
        ops[head + i] = "H" if r[i] == h[j] else "S"
    extra[head] += j
    return ops, extra, d[-1][-1]


def samples(seed):
    rng = random.Random(seed)
    make = lambda: [rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 8, 12, 30]))]
    return [make() for _ in range(400)], [make() for _ in range(400)]


@pytest.mark.parametrize("cells", [4_000_000, 40])
def test_paths_match_the_full_table(monkeypatch, cells):
    monkeypatch.setattr(sequences, "BLOCK_CELLS", cells)
    refs, hyps = samples(1)
    lists = pa.list_(pa.string())
    for ref, hyp, out in zip(refs, hyps, sequences.edit_paths(pa.array(refs, lists), pa.array(hyps, lists)).to_pylist()):
        ops, extra, distance = reference_path(ref, hyp)
        assert [p["op"] for p in out["path"]] == [*ops, "E"]
        assert [p["ins"] for p in out["path"]] == extra
        assert out["substitutions"] + out["deletions"] + out["insertions"] == distance


def test_warping_matches_the_full_table():
    refs, hyps = samples(2)
    rng = random.Random(3)
    sd, td = [[rng.random() for _ in r] for r in refs], [[rng.random() for _ in h] for h in hyps]
    got = sequences.duration_distances(*(pa.array(x) for x in (refs, sd, hyps, td)))
    for sw, s, tw, t, value in zip(refs, sd, hyps, td, got):
        table = np.full((len(sw) + 1, len(tw) + 1), np.inf)
        table[0, 0] = 0
        for i in range(1, len(sw) + 1):
            for j in range(1, len(tw) + 1):
                cost = abs(s[i - 1] - t[j - 1]) if sw[i - 1] == tw[j - 1] else s[i - 1] + t[j - 1] + 1
                table[i, j] = cost + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
        expected = sum(x + 1 for x in t) if not sw else sum(x + 1 for x in s) if not tw else table[-1, -1]
        assert value == pytest.approx(expected)


def test_known_warp():
    got = sequences.duration_distances(*(pa.array([x]) for x in (["a", "b"], [1.0, 1.0], ["a", "b"], [0.5, 1.5])))
    assert got[0] / 4 == 0.25
