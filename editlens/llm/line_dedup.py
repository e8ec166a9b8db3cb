"""Line dedup by a segment-partition edit join, with DataFrame functions only."""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce
from itertools import accumulate, combinations_with_replacement, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.llm.common import stored

#: Edits allowed between two lines, and the least length of a line that may differ; shorter lines must be equal.
THRESHOLD = 2
LEAST = 20
#: Parts of a line that are looked for in the other one before the two are compared.
GLANCE = 12
#: Lines of a key that are compared all with all, and numbers of pieces for the keys of larger groups.
FEW = 64
PIECES = (6, 18)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings, over the threshold if it is larger: bit-parallel in a band of 2t+1 diagonals.

    ``a`` must have more than ``threshold`` characters and lengths may differ by the threshold at most. Bit k of a
    word stands for row j - t + k of the pattern in column j; the words hold where the distance goes up or down by one
    along a column. The score follows the lowest diagonal to the last row and then that row.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    start = F.struct(F.lit(full ^ ((1 << threshold) - 1)).alias("p"), F.lit(0).alias("n"), F.lit(threshold).alias("d"))

    def column(state: Column, j: Column, letters: Column, others: Column) -> Column:
        c = F.get(others, j - 1)
        same = [F.when(F.get(letters, j - 1 - threshold + k) == c, 1 << k).otherwise(0) for k in range(width)]
        return _let(sum(same[1:], same[0]), lambda x: _advance(state, j, x, F.size(letters)))

    def _advance(state: Column, j: Column, x: Column, m: Column) -> Column:
        p, neg = state["p"], state["n"]
        diagonal = ((x.bitwiseAND(p) + p).bitwiseXOR(p)).bitwiseOR(x).bitwiseOR(neg).bitwiseAND(F.lit(full))
        return _let(diagonal, lambda d0: _words(state, j, d0, m))

    def _words(state: Column, j: Column, d0: Column, m: Column) -> Column:
        p, neg = state["p"], state["n"]
        rise = neg.bitwiseOR(d0.bitwiseOR(p).bitwiseXOR(F.lit(full)))
        fall = d0.bitwiseAND(p)
        return _let(F.struct(rise.alias("r"), fall.alias("f"), F.shiftright(d0, 1).alias("s")), lambda w: _next(state, j, d0, w, m))

    def _next(state: Column, j: Column, d0: Column, w: Column, m: Column) -> Column:
        down = F.when(d0.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
        last = [F.call_function("shiftright", w[word], m - j + threshold).bitwiseAND(F.lit(1)) for word in ("r", "f")]
        score = state["d"] + F.when(j <= m - threshold, down).otherwise(last[0] - last[1])
        plus = w["f"].bitwiseOR(w["s"].bitwiseOR(w["r"]).bitwiseXOR(F.lit(full)))
        return F.struct(plus.alias("p"), w["s"].bitwiseAND(w["r"]).alias("n"), score.alias("d"))

    def over(letters: Column, others: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(others))
        return F.aggregate(steps, start, lambda state, j: column(state, j, letters, others), lambda s: s["d"])

    return _let(F.split(a, ""), lambda letters: _let(F.split(b, ""), lambda others: over(letters, others)))


def _let(value: Column, body) -> Column:
    """Compute a value once and use it in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _keys(body: Column, length: Column, threshold: int, least: int) -> Column:
    """Keys under which lines within the threshold meet, and whether a key is the line's own.

    Lines of a range of lengths are cut into threshold + 1 segments by the least length of the range; a line also takes
    part in the ranges of lines up to the threshold shorter. Of two lines within the threshold, a segment i is whole
    with at most i edits before it and at most threshold - i behind it (the multi-match-aware choice). It is looked for
    from the nearer end, where it has moved by no more than that.
    """

    def base(shorter: int) -> Column:
        size = length - shorter
        return F.when(size >= least, size - size % F.when(size < 64, 4).otherwise(16))

    def under(start: Column) -> Column:
        keys = []
        for i in range(threshold + 1):
            begin, end = F.floor(start * i / (threshold + 1)), F.floor(start * (i + 1) / (threshold + 1))
            moved = min(i, threshold - i)
            place = begin if i <= threshold - i else length - (start - begin)
            for shift in range(-moved, moved + 1):
                part = F.substr(body, (place + shift + 1).cast("int"), (end - begin).cast("int"))
                keys.append(F.struct(_key(F.lit(i), start, part).alias("key"), F.lit(shift == 0).alias("own")))
        return F.array(*keys)

    bases = F.array_distinct(F.array_compact(F.array(*[base(k).cast("int") for k in range(threshold + 1)])))
    return F.flatten(F.transform(bases, under))


def _key(*parts: Column) -> Column:
    """48 bits of a hash: a wrong meeting only costs a comparison, and short keys shuffle less."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 16)


def _patterns(pieces: int, threshold: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Ways in which a line and a longer one agree outside of the pieces that edits touch.

    Each is the number of the touched pieces' choice, how much longer the other line is, and the runs of whole pieces:
    first and last bound in pieces, and how far the run has moved in the longer line. Unmoved ones are a line's own.
    """
    found = []
    for number, touched in enumerate(combinations_with_replacement(range(pieces), threshold)):
        edits = sorted(Counter(touched).items())
        bounds = [0, *(x for piece, _ in edits for x in (piece, piece + 1)), pieces]
        for steps in product(*[range(-n, n + 1) for _, n in edits]):
            if sum(steps) >= 0:
                moved = [0, *accumulate(steps)]
                found.append((number, moved[-1], list(zip(bounds[::2], bounds[1::2], moved, strict=True))))
    return found


def _fine_keys(lines: DataFrame, pieces: int, threshold: int) -> DataFrame:
    """``(line, key, own)``: all but the touched pieces of a line are in a key, for every choice of touched pieces.

    Also hashes of the texts of the ``first`` and ``last`` touched piece. Two lines that agree in one of them meet under
    a choice without it as well.
    """
    rows = []
    for number, longer, runs in _patterns(pieces, threshold):
        own = longer == 0 and not any(moved for _, _, moved in runs)
        runs = [*runs, *[(0, 0, 0)] * (threshold + 1 - len(runs)), *runs[-2:]]
        places = {f"r{i}": {"x": x, "y": y, "by": moved} for i, (x, y, moved) in enumerate(runs)}
        rows.append({"number": number, "longer": longer, "own": own, **places})
    kind = ", ".join(f"r{i}: struct<x: int, y: int, by: int>" for i in range(threshold + 3))
    patterns = F.from_json(F.lit(json.dumps(rows)), f"array<struct<number: int, longer: int, own: boolean, {kind}>>")
    every = lines.select("line", "body", "length", F.explode(patterns).alias("p"))
    size = F.col("length") - F.col("p.longer")

    def part(i: int) -> Column:
        x, y = (F.floor(size * F.col(f"p.r{i}.{end}") / pieces) for end in "xy")
        return F.substr("body", (x + F.col(f"p.r{i}.by") + 1).cast("int"), F.greatest(y - x, F.lit(0)).cast("int"))

    def touched(i: int) -> Column:
        y = F.floor(size * F.col(f"p.r{i}.y") / pieces) + F.col(f"p.r{i}.by")
        x = F.floor(size * F.col(f"p.r{i + 1}.x") / pieces) + F.col(f"p.r{i + 1}.by")
        return F.xxhash64(F.substr("body", (y + 1).cast("int"), F.greatest(x - y, F.lit(0)).cast("int")))

    key = _key(F.col("p.number"), size, *[part(i) for i in range(threshold + 1)])
    return every.select("line", key.alias("key"), F.col("p.own").alias("own"), touched(0).alias("first"), touched(threshold + 1).alias("last"))


def _sized(distinct: DataFrame, least: int) -> DataFrame:
    return distinct.withColumn("length", F.char_length("body")).filter(F.col("length") >= least)


def _groups(keys: DataFrame) -> DataFrame:
    """Rows, and their number ``n``, of keys with different lines (and touched pieces), one under its own key."""
    dealt = keys.repartition("key")
    differ = [c for c in keys.columns if c not in ("key", "own")]
    ends = [end(c).alias(f"{name}_{c}") for c in differ for end, name in ((F.min, "low"), (F.max, "high"))]
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any"), *ends)
    shared = sizes.filter(" and ".join(["any", *[f"low_{c} <> high_{c}" for c in differ]])).select("key", "n")
    return stored(dealt.join(shared, "key"))


def _coarse(sized: DataFrame, threshold: int, least: int) -> DataFrame:
    return _groups(sized.select("line", F.inline(_keys(F.col("body"), F.col("length"), threshold, least))).select("line", "key", "own"))


def near_lines(distinct: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """All pairs ``(a, b)`` of ids of different lines within the threshold. ``distinct`` has ``line`` (an id) and ``body``.

    The lines of a pair both have at least ``least`` characters. There may be as many pairs as the square of a group of
    lines that are near each other; ``near_earlier`` does without.
    """
    groups = _coarse(_sized(distinct, least), threshold, least)
    index, probe = groups.filter("own").select(F.col("line").alias("a"), "key"), groups.select(F.col("line").alias("b"), "key")
    met = index.join(probe, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _compared(met, distinct, threshold).select("a", "b")


def _compared(met: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """Those pairs ``(a, b)`` that are within the threshold."""
    left = bodies.select(F.col("line").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("line").alias("b"), F.col("body").alias("body_b"))
    return met.join(left, "a").join(right, "b").filter(_within(F.col("body_a"), F.col("body_b"), threshold))


def near_earlier(distinct: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, few: int = FEW) -> DataFrame:
    """Ids (``line``) of the lines that are within the threshold of a line that comes before them.

    ``distinct`` has ``line`` (an id), ``body`` and ``at``, by which lines are ordered; as in ``near_lines``, both have
    ``least`` characters. Lines that meet under a key are compared if they are few. Those of larger groups meet again
    under keys of finer pieces, which every near pair shares, too. What is still large then differs in the same small
    pieces only; there a line is compared with the first ones of its group, and with more while none is near.
    """
    sized = _sized(distinct, least)
    groups = _coarse(sized, threshold, least)
    lines = stored(sized.join(groups.select("line").distinct(), "line"))
    found = []
    for pieces in PIECES:
        small = _members(groups.filter(F.col("n") <= few), lines)
        found.append(stored(_near(small, small, lines, threshold)))
        large = groups.filter(F.col("n") > few)
        if large.isEmpty():
            break
        groups = _groups(_fine_keys(lines.join(large.select("line").distinct(), "line"), pieces, threshold))
    else:
        by_place = Window.partitionBy("key").orderBy("at", "line")
        placed = stored(_members(groups, lines).withColumn("place", F.row_number().over(by_place)))
        low, high, targets = 0, few, placed
        while not targets.isEmpty():
            found.append(stored(_near(placed.filter(F.col("place").between(low + 1, high)), targets, lines, threshold)))
            low, high = high, 2 * high
            targets = stored(targets.filter(F.col("place") > low).join(found[-1], "line", "left_anti"))
    return reduce(DataFrame.union, found).distinct()


def _members(groups: DataFrame, lines: DataFrame) -> DataFrame:
    return groups.join(lines.select("line", "at"), "line")


def _near(sources: DataFrame, targets: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """Targets that are within the threshold of an earlier source that they share a key with."""
    differ = [c for c in ("line", "first", "last") if c in sources.columns]
    names = [*differ, "at", "own"]
    a, b = (side.select("key", *[F.col(c).alias(f"{c}_{end}") for c in names]) for side, end in ((sources, "a"), (targets, "b")))
    meets = " and ".join([*[f"{c}_a <> {c}_b" for c in differ], "at_a < at_b", "(own_a or own_b)"])
    met = a.join(b, "key").filter(meets).select(F.col("line_a").alias("a"), F.col("line_b").alias("b")).distinct()
    return _compared(met, lines, threshold).select(F.col("b").alias("line")).distinct()


def _within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the distance is within the threshold. First a glance: edits leave all but so many parts of a line whole."""
    length = F.char_length(a)
    whole = []
    for i in range(GLANCE):
        begin, end = (F.floor(length * k / GLANCE).cast("int") for k in (i, i + 1))
        around = F.substr(b, F.greatest(begin - threshold, F.lit(0)) + 1, end - begin + 2 * threshold)
        whole.append(F.contains(around, F.substr(a, begin + 1, end - begin)).cast("int"))
    near = (F.abs(length - F.char_length(b)) <= threshold) & (sum(whole[1:], whole[0]) >= GLANCE - threshold)
    return F.when(near, banded_distance(a, b, threshold) <= threshold).otherwise(False)


def _body(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\x0b"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """Remove lines that occurred before in the table: equal, or within the threshold of an earlier line.

    Adds ``n_lines`` (lines with something in them) and ``n_removed``, and leaves the text without the removed lines;
    other columns stay as they are (those two names are replaced). Lines are compared without white space at their
    ends; blank lines stay while anything else of the text does. Earlier means a smaller id (null first), then a
    smaller hash of the text, then a line further up. A line goes if a line of equal text, or one within the
    threshold, was first seen before its own first place, whether that one stays or not. Lines of less than ``least``
    characters must be equal. A null text stays null, an empty one empty, with no lines. Rows of equal id and text are
    one document and get the same result. An empty table stays empty.
    """
    order = (F.xxhash64(F.col(doc_id), F.col(text)), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    keyed = docs.drop("n_lines", "n_removed").withColumns({"_k1": order[0], "_k2": order[1]})
    exploded = keyed.select(F.col(doc_id).alias("id"), "_k1", "_k2", F.posexplode(F.split(F.col(text), "\n")).alias("no", "raw"))
    lines = exploded.withColumn("body", _body(F.col("raw"))).filter("body <> ''").withColumns({"line": F.xxhash64("body"), "check": F.crc32(F.col("body").cast("binary"))})
    # Lines are equal if both hashes are; near lines are looked up by the first, and compared by their text.
    firsts = stored(lines.groupBy("line", "check").agg(F.min(F.struct("id", "_k1", "_k2", "no")).alias("at"), F.first("body").alias("body")))
    stay = firsts.join(near_earlier(firsts.select("line", "body", "at"), threshold, least), "line", "left_anti").select("at.*")
    kept = stay.groupBy("_k1", "_k2").agg(F.collect_list("no").alias("_kept"))
    return _without(keyed.join(kept, ["_k1", "_k2"], "left"), text).drop("_k1", "_k2", "_kept")


def _without(rows: DataFrame, text: str) -> DataFrame:
    """Put the kept and the blank lines of each text together again."""
    parts = F.split(F.col(text), "\n")
    blank = F.filter(F.transform(parts, lambda x, i: F.when(_body(x) == "", i)), lambda i: i.isNotNull())
    kept = F.coalesce(F.col("_kept"), F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    places = F.when(F.size(kept) + F.size(blank) == F.size(parts), every).otherwise(F.array_intersect(every, F.concat(kept, blank)))
    n_lines = F.coalesce(F.size(parts) - F.size(blank), F.lit(0)).cast("long")
    joined = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    cleaned = F.when(F.col(text).isNull() | (F.size(kept) == n_lines), F.col(text)).when(F.size(kept) == 0, F.lit("")).otherwise(joined)
    n_removed = (n_lines - F.size(kept)).cast("long")
    return rows.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"), "n_removed": F.when(F.col(text).isNull(), 0).otherwise(n_removed).cast("long"), text: cleaned})
