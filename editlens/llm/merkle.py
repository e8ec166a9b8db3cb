"""Merkle manifest of a dataset: trees of digests by source below one root, with a proof for each row.

Nodes of a tree are numbered, and the digits of the number in base FANOUT are grouped away one after the other within
blocks of FANOUT^DIGITS nodes: each grouping nests child structs and digests them. A block is one row of bounded size,
so its proofs come out of it by transform and explode. The blocks of a tree are the nodes of the next round; a round
has FANOUT^DIGITS times fewer rows than the one before. Paths of the upper rounds come down by a union and a grouping
of block keys (which also takes null sources), never by a join of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.llm.common import numbered, ranged, stored

FANOUT = 16
DIGITS = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Siblings to the left and to the right of a node in its run, each side as one string of digests.
LEVEL = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """A value as it is digested: its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _ranks(leaves: DataFrame) -> DataFrame:
    """Number the leaves of each source from 0 by id, then digest. A source may reach over many ranges of rows.

    The broadcast has one row a range: how many rows its first source has in earlier ranges.
    """
    placed = ranged(leaves, "source", "doc_id", "leaf", "tampered")
    counts = placed.groupBy("_part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("at"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("carry", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    first = F.broadcast(carried.filter("at = 0").select("_part", F.col("source").alias("_first"), "carry"))
    own = F.row_number().over(Window.partitionBy("_part", "source").orderBy("_pos")) - 1
    carry = F.when(F.col("source").eqNullSafe(F.col("_first")), F.col("carry")).otherwise(F.lit(0))
    joined = placed.withColumn("own", own).join(first, "_part")
    return joined.select("source", (F.col("own") + carry).cast("long").alias("rank"), "doc_id", "leaf", "tampered")


def _blocks(nodes: DataFrame, tree: str, payload: list[str]) -> DataFrame:
    """``tree, rank, digest`` and payload to blocks ``(tree, rank, digest, nest)``; ``rank`` is the block's number.

    A node that is the only one of its level is left as it is; a block other than the first shows that there are more.
    """
    width = FANOUT**DIGITS
    digits = [f"d{i}" for i in range(DIGITS)]
    at = nodes.withColumn("block", F.floor(F.col("rank") / width).cast("long"))
    at = at.withColumns({f"d{i}": F.shiftright("rank", 4 * i).bitwiseAND(F.lit(FANOUT - 1)).cast("int") for i in range(DIGITS)})
    # All groupings below keep to this one deal of rows.
    at = at.select(tree, "block", *digits, "digest", *payload).repartition(tree, "block")
    at = at.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(tree, "block")))
    child: list[str] = payload
    for i in range(DIGITS):
        members = F.sort_array(F.collect_list(F.struct(f"d{i}", "digest", *child)))
        at = at.groupBy(tree, "block", "n", *digits[i + 1 :]).agg(members.alias("nest"))
        several = (F.col("block") > 0) | (F.col("n") > FANOUT**i)
        digests = F.col("nest")["digest"]
        at = at.withColumn("digest", F.when(several, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0]))
        child = ["nest"]
    return at.select(tree, F.col("block").alias("rank"), "digest", "nest", "n")


def _unnested(blocks: DataFrame, tree: str, payload: list[str], keep: list[str]) -> DataFrame:
    """The nodes of the blocks again with their ``path`` (levels from the node up); ``path`` of a block is appended."""

    def level(run: Column, place: Column, several: Column) -> Column:
        digests = F.transform(run, lambda node: node["digest"])
        sides = F.struct(F.array_join(F.slice(digests, F.lit(1), place), "").alias("before"), F.array_join(F.slice(digests, place + 2, F.lit(FANOUT)), "").alias("after"))
        return F.when(several, F.array(sides)).otherwise(F.array().cast(f"array<{LEVEL}>"))

    def nodes(run: Column, depth: int, above: Column) -> Column:
        several = (F.col("rank") > 0) | (F.col("n") > FANOUT**depth)

        def one(node: Column, place: Column) -> Column:
            path = F.concat(level(run, place, several), above)
            if depth:
                return nodes(node["nest"], depth - 1, path)
            return F.struct(node["digest"].alias("digest"), *[node[p].alias(p) for p in payload], path.alias("path"))

        inner = F.transform(run, one)
        return F.flatten(inner) if depth else inner

    all_nodes = nodes(F.col("nest"), DIGITS - 1, F.col("path"))
    # Nodes come out in the order of their numbers without a gap, so the place gives the number back.
    return blocks.select(tree, F.col("rank").alias("block"), *keep, F.posexplode(all_nodes).alias("place", "node")).select(
        tree, (F.col("block") * FANOUT**DIGITS + F.col("place")).alias("rank"), *keep, "node.digest", *[F.col(f"node.{p}").alias(p) for p in payload], "node.path"
    )


def _climb(nodes: DataFrame, tree: str, payload: list[str]) -> list[DataFrame]:
    """Stored blocks of each round, until every tree is one block."""
    rounds = [stored(_blocks(nodes, tree, payload))]
    while rounds[-1].filter("rank > 0").limit(1).count():
        rounds.append(stored(_blocks(rounds[-1].select(tree, "rank", "digest"), tree, [])))
    return rounds


def _descend(rounds: list[DataFrame], top: DataFrame, tree: str, payload: list[str], carried: list[str]) -> DataFrame:
    """Bring the paths of the trees (``tree, path`` and ``carried``) down to the nodes of the first round."""
    above = top.withColumn("rank", F.lit(0).cast("long"))
    for i, blocks in enumerate(reversed(rounds)):
        last = i == len(rounds) - 1
        both = blocks.select(tree, "rank", "nest", "n").unionByName(above.select(tree, "rank", "path", *carried), allowMissingColumns=True)
        held = both.groupBy(tree, "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("nest", "n", "path", *carried)])
        above = _unnested(held.filter("nest is not null"), tree, payload if last else [], carried)
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", source: str = "source", text: str = "text", tampered_when: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, tampered, subroot, root, path``: a row for each row of ``docs``.

    A leaf is the digest of the fields. Leaves of a source ascend by id, then by digest, and every FANOUT nodes next to
    each other become their digest until one remains, the subroot; subroots by source become the root in the same way.
    ``path`` has the siblings of each level from the leaf up to the root. ``tampered`` is the leaf of a row whose text
    was changed where ``tampered_when`` holds (letters A to Z in lower case), null where nothing changed.

    A null field counts as ``-``; a null source is a source of its own and comes first, a null id comes first in its
    source; repeated rows are leaves of their own; long texts are digested whole; an empty table gives no rows; other
    columns are ignored.
    """
    changed = F.lit(False) if tampered_when is None else F.coalesce(tampered_when, F.lit(False))
    own = leaf([F.col(c) for c in fields])
    other = leaf([F.translate(c, UPPER, UPPER.lower()) if c == text else F.col(c) for c in fields])
    leaves = docs.select(
        F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), own.alias("leaf"), F.when(changed & F.col(text).rlike("[A-Z]"), other).alias("tampered")
    )
    payload = ["doc_id", "tampered"]
    ranked = _ranks(leaves).withColumnRenamed("leaf", "digest")
    rounds = _climb(ranked, "source", payload)
    subroots = rounds[-1].select("source", F.col("digest").alias("subroot"))
    top_nodes = numbered(subroots, "source", name="rank").select(F.lit(0).alias("tree"), "rank", F.col("subroot").alias("digest"), "source")
    top_rounds = _climb(top_nodes, "tree", ["source"])
    root = top_rounds[-1].select("tree", F.array().cast(f"array<{LEVEL}>").alias("path"), F.col("digest").alias("root"))
    tops = _descend(top_rounds, root, "tree", ["source"], ["root"]).withColumnRenamed("digest", "subroot")
    found = _descend(rounds, tops.select("source", "path", "subroot", "root"), "source", payload, ["subroot", "root"])
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))
