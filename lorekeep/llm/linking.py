"""From band buckets to connected components, without pairing off whole buckets.

``link`` verifies every member of a bucket against a leader and unites what is similar. The first
leader is the bucket's hub: the member with the most companions over all its buckets, which among
edited copies of a text is the copy nearest to the original. A second leader is chosen by hash.

What is left are buckets that still hold several components. There, members outside the bucket's
largest component meet members of other components, but only pairs that can be similar leave the
join. The test is an exact bound: two sets of sizes m and n and similarity t differ in at most
(1 - t) / (1 + t) * (m + n) elements. Each set has a sketch of SKETCH_BITS bits, in which an element
turns over the bit that its hash names, so each bit in which two sketches differ takes at least one
element in which the sets differ. The sketches are compared by words within the join. In the end two
members of a bucket are in one component, or they were compared, or the bound rules them out: no
similar pair that shares a bucket is missed. A bucket of n copies that resemble each other costs about n comparisons, not
n * n; of copies that are further apart only those near the limit are compared.

``components`` is distributed union-find by alternating large-star and small-star steps. Each step
is a grouped minimum and a join, so a hub of any degree is never gathered in one task. Later rounds
unite whole components by their roots.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import discard, small, stored

SKETCH_BITS = 1024
SKETCH = [f"sketch_{i}" for i in range(SKETCH_BITS // 64)]
#: Columns that ``link`` needs of each node, besides the node and its content.
SKETCHED = "size long, " + ", ".join(f"{c} long" for c in SKETCH)


def sketches(owner: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Sizes of n sets and the words of their sketches; ``hashes`` are distinct within an owner."""
    places = owner * SKETCH_BITS + (hashes % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(places, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return [np.bincount(owner, minlength=n), *np.packbits(odd, axis=1).view(np.int64).T]


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the component's smallest node."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    while _unsettled(edges).head(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that have several parents, or a parent and children: there are none once all edges lead to roots."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    return several.unionByName(edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi"))


def _united(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored components of what ``roots`` (node, root) and stored ``edges`` (a, b) join together."""
    of = small(roots, 16)
    ends = edges.join(of.toDF("a", "root_a"), "a", "left").join(of.toDF("b", "root_b"), "b", "left")
    ends = stored(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct(), "ends")
    if not ends.head(1):
        discard(ends)
        return roots
    top = stored(components(ends), "tops")
    new = top.join(roots.select("node"), "node", "left_anti")
    moved = roots.join(small(top, 16).toDF("root", "above"), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    found = stored(moved.unionByName(new), "roots")
    discard(ends, top)
    return found


def shared_buckets(banded: DataFrame) -> DataFrame:
    """bucket, node: members of buckets with at least two nodes. ``banded`` is a stored table of node, bands."""
    rows = banded.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    shared = stored(shared.select("bucket"), "buckets")
    members = stored(rows.join(small(shared, 32), "bucket").distinct(), "members")
    discard(shared)
    return members


def _pairs(rows: DataFrame) -> DataFrame:
    """a, b with a < b of rows with x, y."""
    return rows.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether the sets of columns prefixed with ``x`` and ``y`` can be similar."""
    differ = reduce(add, (F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in SKETCH))
    return differ <= (F.col(f"{x}size") + F.col(f"{y}size")) * ((1 - similarity) / (1 + similarity) + 1e-9)


def link(members: DataFrame, contents: DataFrame, verify: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Components (node, root) of ``members`` (bucket, node), stored; nodes without a similar one don't appear.

    ``contents`` has a row for each member: node, content, size and SKETCH of its set. ``verify`` gets
    pairs (a, b, content_a, content_b) with a < b and returns (a, b) of those of at least ``similarity``."""

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [contents.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("content", "size", *SKETCH))) for s in ("a", "b")]
        both = pairs.join(sides[1], "b").join(sides[0], "a").filter(_possible("a_", "b_", similarity))
        return stored(verify(both.select("a", "b", F.col("a_content").alias("content_a"), F.col("b_content").alias("content_b"))), "similar")

    def rooted(roots: DataFrame) -> DataFrame:
        return stored(members.join(small(roots, 16), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "rooted")

    def against(rows: DataFrame, rank: Column) -> DataFrame:
        leaders = rows.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "node"))["node"].alias("y"), F.min("root").alias("least"), F.max("root").alias("most"))
        return _pairs(rows.join(leaders.filter("least < most"), "bucket").select(F.col("node").alias("x"), "y"))

    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    hubs = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("company"))
    first = stored(against(members.join(hubs, "node").withColumn("root", F.col("node")), F.col("company")), "pairs")
    similar = verified(first)
    roots = stored(components(similar), "roots")
    discard(similar)

    rows = rooted(roots)
    second = stored(against(rows, F.xxhash64("node", "bucket")).join(first, ["a", "b"], "left_anti"), "pairs")
    similar = verified(second)
    roots = _united(roots, similar)
    discard(similar, rows)

    rows = rooted(roots)
    rest = stored(_remaining(rows, contents, similarity).join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    similar = verified(rest)
    roots = _united(roots, similar)
    discard(similar, rows, first, second, rest)
    return roots


def _remaining(rows: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and that the bound doesn't rule out."""
    counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    heavy = counts.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("heavy"), F.count("*").alias("roots"), F.sum("n").alias("members"))
    heavy = heavy.filter("roots > 1 and members > 2")  # the only pair of a bucket of two was compared with its leader
    open_ = rows.join(heavy.select("bucket", "heavy"), "bucket").join(contents.select("node", "size", *SKETCH), "node")
    x = open_.filter("root <> heavy").select("bucket", *(F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", *SKETCH)))
    y = open_.select("bucket", *(F.col(c).alias(f"y_{c}") for c in ("node", "root", "heavy", "size", *SKETCH)))
    once = (F.col("y_root") == F.col("y_heavy")) | (F.col("x_node") < F.col("y_node"))
    found = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("x_root") != F.col("y_root")) & once & _possible("x_", "y_", similarity))
    return _pairs(found.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")))
