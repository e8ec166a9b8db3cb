"""Lines of large groups against plain comparisons of all with all, and how many of them are compared."""

from __future__ import annotations

import random

from editlens.llm import line_dedup
from editlens.llm.line_dedup import LEAST


def within(a: str, b: str, most: int = 2) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= most


def numbered(spark, lines):
    return spark.createDataFrame([(i, x, i * 7919 % 1009) for i, x in enumerate(lines)], "line long, body string, at long")


def earlier(lines):
    at = [i * 7919 % 1009 for i in range(len(lines))]
    long = [len(x) >= LEAST for x in lines]
    pairs = ((i, j) for i in range(len(lines)) for j in range(len(lines)) if at[i] < at[j] and long[i] and long[j])
    return {j for i, j in pairs if within(lines[i], lines[j])}


def test_near_earlier_finds_all_at_every_group_size(spark):
    rng = random.Random(3)
    lines = {f"entry number {n:03d} of the list" for n in rng.sample(range(1000), 40)}
    for length in (LEAST - 2, 26, 62, 83):
        base = [rng.choice("abcé ") for _ in range(length)]
        for _ in range(30):
            other = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = rng.choice(["", "x", "yy", "word"])
            lines.add("".join(other))
    lines = sorted(lines)
    want = earlier(lines)
    assert want and len(want) < len(lines)
    for few in (2, 64):
        got = [r.line for r in line_dedup.near_earlier(numbered(spark, lines), few=few).collect()]
        assert len(got) == len(set(got)) and set(got) == want, few


def test_large_groups_are_not_compared_all_with_all(spark, monkeypatch):
    """Lines that share a third, but are not near, and lines of one format that all are."""
    rng, met = random.Random(4), []
    base = "".join(rng.choice("abcdefgh ") for _ in range(480))
    lines = {base[:at] + "".join(rng.choice("mnop") for _ in range(4)) + base[at:] for at in (rng.randrange(480) for _ in range(400))}
    lines |= {f"entry number {n:04d} of the long list of entries" for n in range(400)}
    compared = line_dedup._compared
    monkeypatch.setattr(line_dedup, "_compared", lambda pairs, *rest: met.append(pairs.count()) or compared(pairs, *rest))
    assert line_dedup.near_earlier(numbered(spark, sorted(lines)), few=16).count() > 390
    assert 0 < sum(met) < 25_000, met
