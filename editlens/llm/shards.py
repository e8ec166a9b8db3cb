"""Sharding: cut an ordered list of atomic groups into contiguous shards of the smallest feasible capacity."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.llm.common import numbered, stored, utf8

OVERHEAD = 16
#: Places of possible cuts that the driver holds at a time. More make fewer rounds; results do not depend on it.
SUMMARY = 1 << 16


class Cuts:
    """What is known of the places where a cut may fall: ends of groups, ascending, and whether no end lies between."""

    def __init__(self, ends: list[int], closed: list[bool]):
        self.ends, self.closed = ends, closed  # closed[i]: no group ends between ends[i - 1] and ends[i]

    def furthest(self, limit: int, relaxed: bool) -> int:
        """The last place up to the limit; where ends are not known, relaxed takes the limit itself."""
        i = bisect_right(self.ends, limit)
        at = self.ends[i - 1] if i else 0
        if relaxed and i < len(self.ends) and not self.closed[i]:
            return limit
        return at

    def chain(self, capacity: int, shards: int, relaxed: bool) -> list[int]:
        """Greedy cuts: each shard takes all that fits."""
        at, cuts = 0, []
        for _ in range(shards):
            at = self.furthest(at + capacity, relaxed)
            cuts.append(at)
        return cuts

    def capacity(self, shards: int, low: int, high: int, relaxed: bool) -> int:
        """Binary search for the smallest capacity with which the shards take everything."""
        while low < high:
            middle = (low + high) // 2
            if self.chain(middle, shards, relaxed)[-1] >= self.ends[-1]:
                high = middle
            else:
                low = middle + 1
        return low


def _summary(groups: DataFrame, spans: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Of the groups that end in the spans: last end and number of ends, for about ``parts`` parts of the spans."""
    total = sum(high - low for low, high in spans)
    step = max(1, total // parts)
    part: Column = F.lit(None).cast("long")
    base = 0
    for low, high in spans:
        part = F.when((F.col("end") > low) & (F.col("end") <= high), F.lit(base) + F.floor((F.col("end") - low - 1) / step)).otherwise(part)
        base += -(-(high - low) // step)
    rows = groups.withColumn("part", part).filter("part is not null").groupBy("part").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    return sorted((r["end"], r["n"]) for r in rows.collect())


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Cuts of the contiguous partition with the smallest largest shard.

    ``groups`` has the ``end`` of each group: the sum of the sizes up to and with it, all sizes being above zero. The
    driver holds a summary of the ends, bounded by SUMMARY. Cuts at known ends bound the capacity from above; letting a
    cut fall anywhere between ends that are not all known bounds it from below. Only the stretches between the chains
    of both bounds can hold a cut, so the next round looks at these in finer parts, until all ends there are known. The
    result is exact.
    """
    total = groups.agg(F.max("end")).first()[0]
    if total is None:
        return []
    spans, known, parts = [(0, total)], {}, SUMMARY
    while True:
        fresh = _summary(groups, spans, parts)
        # All ends of the spans are now known, or summed up by parts; outside of them the old knowledge holds.
        known = {end: n for end, n in known.items() if not any(low < end <= high for low, high in spans)} | dict(fresh)
        ends = sorted(known)
        cuts = Cuts(ends, [known[e] == 1 for e in ends])
        low = cuts.capacity(shards, -(-total // shards), total, relaxed=True)
        high = cuts.capacity(shards, low, total, relaxed=False)
        first, last = cuts.chain(low, shards, relaxed=False), cuts.chain(high, shards, relaxed=True)
        looked_at, spans = spans, []
        for a, b in zip(first, last, strict=True):
            i, wide = bisect_right(ends, a), []
            while i < len(ends) and (ends[i - 1] if i else 0) < b:
                if not cuts.closed[i]:
                    wide.append(i)
                i += 1
            if wide:
                begin, end = (ends[wide[0] - 1] if wide[0] else 0), ends[wide[-1]]
                if spans and begin <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((begin, end))
        if low == high and not spans:
            return first
        if 2 * sum(b - a for a, b in spans) > sum(b - a for a, b in looked_at):
            parts *= 4  # too coarse for this many shards


def assign(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Put every row into a shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: shard sizes are as near as whole groups allow. Size is UTF-8 bytes plus OVERHEAD (null: no bytes).
    Rows of equal text (null counts as empty) are one atomic group; groups are ordered by their smallest id, then by
    digest. Groups above a fair share of what is left get a shard each, the last ones; the others are cut into
    contiguous shards by the smallest feasible capacity. ``slot`` numbers the rows of a shard by group, id and row
    from 0. Rows with a null id come first in their group; repeated rows get slots of their own; an empty table gives
    no rows. Other columns are ignored.
    """
    body = utf8(text)
    rows = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), (F.length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")
        )
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first")))
    large = _large(groups, shards)
    least = large[-1][0] if large else None
    single = F.lit(False) if least is None else F.col("bytes") >= least
    placed = numbered(groups.filter(~single), "first", "digest", name="place")
    ends = stored(_running(placed))
    cuts = minimax_cuts(ends, shards - len(large))
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("end") > cut, 1).otherwise(0)
    small = ends.select("digest", F.col("place"), shard.alias("shard"))
    alone = [(d, shards - len(large) + i) for i, (_, d) in enumerate(large)]
    named = groups.sparkSession.createDataFrame(alone, "digest binary, shard int").select("digest", F.lit(0).cast("long").alias("place"), "shard")
    with_shard = rows.join(small.union(named), "digest").select("shard", "place", "doc_id", "row", "size", "text_crc32")
    ordered = numbered(with_shard, "shard", "place", "doc_id", "row", name="at")
    first = F.broadcast(ordered.groupBy("shard").agg(F.min("at").alias("low")))  # a row a shard
    return ordered.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("at") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _large(groups: DataFrame, shards: int) -> list[tuple[int, bytes]]:
    """Size and digest of the groups above a fair share, largest first; there are fewer than shards of them."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).collect()
    found: list[tuple[int, bytes]] = []
    for row in top:
        if row["bytes"] * (shards - len(found)) <= total:
            break
        found.append((row["bytes"], bytes(row["digest"])))
        total -= row["bytes"]
    return found


def _running(placed: DataFrame) -> DataFrame:
    """Add ``end``: the bytes of all groups up to this one in the order of ``place``, by blocks of places."""
    block = F.floor(F.col("place") / F.lit(4096))
    parts = placed.withColumn("_block", block)
    sums = parts.groupBy("_block").agg(F.sum("bytes").alias("_bytes"))
    upper = sums.withColumn("_part", F.floor(F.col("_block") / 4096))
    tops = upper.groupBy("_part").agg(F.sum("_bytes").alias("_top"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_part", F.coalesce(F.sum("_top").over(earlier), F.lit(0)).alias("_before_part"))
    inside = Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = upper.withColumn("_before_block", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(tops, "_part")
    shift = shift.select("_block", (F.col("_before_part") + F.col("_before_block")).alias("_shift"))
    own = F.sum("bytes").over(Window.partitionBy("_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(shift, "_block").select("digest", "place", "bytes", (F.col("_own") + F.col("_shift")).alias("end"))
