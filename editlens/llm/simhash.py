"""Near duplicates by SimHash (blocks that close fingerprints share) and by shingle sets (shingles that close sets share)."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.llm.common import components, stored

SEED = 42
PIECE = 1 << 20
#: Members up to which a bucket's pairs are compared one by one, or of a key's part that a task compares with all of them.
SMALL = 256
#: Members of a key that the others are compared with first.
PIVOTS = 4
#: One text in SAMPLE is looked at for common shingles; the texts of it that have one, and how many of them are kept.
SAMPLE, SAMPLE_HITS, COMMON = 16, 8, 200_000
#: What a product of a similarity and a count may exceed a whole number by.
ROUNDING = 1e-9


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in lists of bounded size."""
    data = text.encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of the space-joined shingles, repeats included; a text of fewer words is one shingle."""
    kept: list[bytes] = []
    hashed = False
    for words in word_lists(text):
        kept += words
        if len(kept) >= width:
            values = [xxhash.xxh64_intdigest(b" ".join(kept[i : i + width]), SEED) for i in range(len(kept) - width + 1)]
            yield np.array(values, dtype=np.uint64)
            hashed = True
            kept = kept[len(kept) - width + 1 :]
    if not hashed and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    parts = list(shingle_hashes(text or "", width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def fingerprint(text: str | None, width: int) -> np.ndarray:
    """The SimHash as one 64-bit word; every occurrence of a shingle has a vote."""
    counts = np.zeros((1, 64), dtype=np.int64)
    total = 0
    for hashes in shingle_hashes(text or "", width):
        for part in np.array_split(hashes, max(1, len(hashes) // 8192)):
            total += len(part)
            counts += bit_counts(part[np.newaxis])
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How often each bit is set along the rows of ``values`` (words, n): three words add up to a sum and a carry word."""
    counts = np.zeros((len(values), 64), dtype=np.int64)
    weight = 1
    while values.shape[1]:
        carries = []
        while (third := values.shape[1] // 3) > 0:
            a, b, c = values[:, :third], values[:, third : 2 * third], values[:, 2 * third : 3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            values = np.concatenate((odd ^ c, values[:, 3 * third :]), axis=1)
        bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1, 8), axis=2, bitorder="little")
        counts += weight * bits.sum(axis=1, dtype=np.int64)
        values = np.concatenate(carries, axis=1) if carries else values[:, :0]
        weight *= 2
    return counts


def simhash(text: Column, width: int) -> Column:
    """The fingerprint as an array of longs. Null and blank texts have all bits zero."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width).view(np.int64).tolist() for t in texts])

    return of(text)


def close_pairs(prints: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of distinct 64-bit fingerprints ``f`` that differ in at most two bits.

    Four blocks of 16 bits: two differing bits touch two blocks at most, so a close pair agrees in some two blocks
    and meets in the bucket of these 32 bits. A pair that meets in several buckets is kept in its first only.
    Buckets of more than SMALL members are linked in another exact way: two fingerprints differ in at most two bits
    exactly if some value differs from each of them in at most one. Every member of a large bucket is listed under
    its 65 such values; at most 65 fingerprints can share a value, so these lists stay short in any data.
    """
    masks = [sum(0xFFFF << (16 * i) for i in kept) for kept in itertools.combinations(range(4), 2)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("f").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    rows = prints.select("f", F.explode(keys).alias("k")).select("f", "k.m", "k.v")
    sizes = rows.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(rows.join(sizes, ["m", "v"]))
    few = shared.filter(F.col("n") <= SMALL)
    a, b = few.alias("a"), few.alias("b")
    met = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.f") < F.col("b.f")))
    xor = F.col("a.f").bitwiseXOR(F.col("b.f"))
    first = functools.reduce(
        lambda then, i: F.when(xor.bitwiseAND(F.lit(masks[i])) == 0, F.lit(i)).otherwise(then), reversed(range(len(masks))), F.lit(-1)
    )
    pairs = met.filter((F.bit_count(xor) <= 2) & (first == F.col("a.m"))).select(F.col("a.f").alias("a"), F.col("b.f").alias("b"))
    many = shared.filter(F.col("n") > SMALL).select("f").distinct()
    flips = F.transform(F.array(*[F.lit(0)] + [F.lit((1 << i) - ((1 << 64) if i == 63 else 0)) for i in range(64)]), lambda x: F.col("f").bitwiseXOR(x))
    balls = many.select("f", F.explode(flips).alias("v"))
    lists = balls.groupBy("v").agg(F.sort_array(F.collect_list("f")).alias("fs")).filter(F.size("fs") > 1)
    near = lists.select(F.explode("fs").alias("a"), "fs").select("a", F.explode("fs").alias("b")).filter("a < b").distinct()
    return pairs.union(near).distinct()


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id, links)`` for every row: 3-word shingles, links at two or fewer bits.

    Rows of equal fingerprint form a class; ``links`` counts the other classes within two bits. ``component_id`` is
    the smallest id reachable over links. Null and blank texts have fingerprint zero and are linked like any other;
    rows with a null id take part and get the id of their component (null if it has none). Repeated rows are kept.
    Other columns of the input are ignored.
    """
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), 3)[0].alias("f")))
    classes = prints.groupBy("f").agg(F.min("doc_id").alias("low"))
    pairs = stored(close_pairs(classes.select("f")))
    links = pairs.select(F.col("a").alias("f")).union(pairs.select("b")).groupBy("f").agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs).select(F.col("node").alias("f"), "root")
    known = classes.join(roots, "f", "left").join(links, "f", "left").select("f", "low", F.coalesce("root", "f").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lows, "root").select("f", "component_id", "links")
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint")
    return prints.join(named, "f").select("doc_id", hexed, "component_id", "links")


def one_per_component(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of ``groups`` stays: the one with the smallest id (null last), whatever ids repeat."""
    marked = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    named = groups(marked.select("_row", text), text, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    ids = marked.select("_row", F.struct(F.col(doc_id).isNull(), doc_id, "_row").alias("_best"))
    best = ids.join(named, "_row").groupBy("component_id").agg(F.min("_best").alias("_best"))
    return marked.join(best.select(F.col("_best._row").alias("_row")), "_row", "left_semi").drop("_row")


def shingles(text: Column, width: int) -> Column:
    """The distinct shingles' hashes as an array of longs."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64).tolist() for t in texts])

    return of(text)


def verified(candidates: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have at least this Jaccard similarity, of ``texts(node, _text)``.

    Two empty sets are equal. Sets are made of the candidates' texts only.
    """
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(texts.join(nodes, "node").select("node", shingles(F.col("_text"), width).alias("s")))
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    pairs = candidates.join(left, "a").join(right, "b").filter(small >= similarity * large - ROUNDING)
    return pairs.filter(common >= similarity * (small + large - common) - ROUNDING).select("a", "b")


def linked(shared: DataFrame, checked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components ``(node, root)`` of the pairs that share a key and that ``checked`` leaves, of ``shared(node, k, n)``.

    First the members of a key are compared with a few of them, which are the same ones for keys of the same members,
    and links make components. Then, whatever the size of a key, all pairs of its members that are in different
    components and were not compared yet are: pairs inside a component cannot change it, so no link that counts is
    lost. Keys of many members are spread over tasks for that.
    """
    slots = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).getField("node") for i in range(PIVOTS)]
    pivots = shared.groupBy("k").agg(F.array_distinct(F.array(*slots)).alias("ps"))
    starred = shared.join(pivots, "k").select(F.col("node").alias("a"), F.explode("ps").alias("b")).filter("a <> b")
    first = stored(starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = checked(first)
    known = shared.join(components(near), "node", "left").select("node", "k", "n", F.coalesce("root", "node").alias("root"))
    mixed = known.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("k")
    rest = stored(known.join(mixed, "k").withColumn("salts", F.ceil(F.col("n") / SMALL).cast("int")))
    a = rest.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("a")
    b = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.salt") == F.col("b.salt"))
    met = a.join(b, same & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")))
    others = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    return components(near.union(checked(others)))


def common_shingles(classes: DataFrame, text: str, width: int) -> np.ndarray:
    """Hashes of shingles that SAMPLE_HITS or more texts of a sample have, at most COMMON of them, in ascending order."""
    some = classes.filter(F.pmod(F.xxhash64("_digest"), F.lit(SAMPLE)) == 0).select(F.explode(shingles(F.col(text), width)).alias("k"))
    often = some.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SAMPLE_HITS)
    return np.sort(np.array([r["k"] for r in often.orderBy(F.desc("n"), "k").limit(COMMON).collect()], dtype=np.int64).view(np.uint64))


def prefix(text: str | None, width: int, similarity: float, common: np.ndarray) -> list[int]:
    """The shingles of which a text shares at least one with any text of this similarity; [0] for a blank text.

    Of n shingles, ceil(similarity n) at least are shared, so in one order of all shingles two such texts share one
    among the first n - ceil(similarity n) + 1 of each. Common shingles come last in that order.
    """
    own = shingle_set(text, width)
    if not len(own):
        return [0]
    if len(common):
        often = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate((own[~often], own[often]))
    return own[: len(own) - math.ceil(similarity * len(own) - ROUNDING) + 1].view(np.int64).tolist()


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id, then the smallest text.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8, without exception:
    a text's keys are a prefix of its shingles (see ``prefix``), which texts that similar share one of, and keys of any
    size are compared in full, less what cannot matter (see ``linked``). Pairs are verified by their sets. Which
    shingles count as common is drawn from a sample and changes the work, not the result. Equal texts are one class
    beforehand, and null and empty texts are equal; blank texts are linked.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marked = stored(docs.withColumns({"_digest": F.sha2(body, 256), "_row": F.monotonically_increasing_id()}))
    common = common_shingles(marked.withColumn("_text", body), "_text", width)

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([prefix(t, width, similarity, common) for t in texts])

    rows = marked.select("_digest", F.struct(F.col(doc_id).isNull(), doc_id, "_row").alias("_best"), keys(body).alias("ks"))
    classes = rows.groupBy("_digest").agg(F.min_by("ks", "_best").alias("ks"), F.min("_best").alias("_best"))
    prints = stored(classes.select(F.xxhash64("_digest").alias("node"), "_best", "ks"))
    keyed = prints.select("node", F.explode("ks").alias("k"))
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, "k"))
    texts = marked.join(prints.select("node", F.col("_best._row").alias("_row")), "_row").select("node", body.alias("_text"))
    roots = linked(shared, lambda candidates: stored(verified(stored(candidates), texts, width, similarity)))
    best = prints.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("_best").alias("_best"))
    kept = best.select(F.col("_best._row").alias("_row"))
    return marked.join(kept, "_row", "left_semi").drop("_digest", "_row")
