"""Breadth-first search over stored edges, from one end or from both.

The edges are stored once, dealt by the node that a step leaves. A step joins the last frontier with them and writes one table, the
next frontier; what was reached is read from the tables of all steps in one scan. A search between two sets of nodes
steps from the side whose frontier is smaller, until the sides meet, so it reaches about the square root of
what a search from one side does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import stored

#: Rows of a frontier that are broadcast to the edges; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def graph_nodes(edges: DataFrame) -> DataFrame:
    """src, dst of the code graph's edges: an end that resolved is its symbol's id, another one its name after ``name:``."""

    def node(i: Column, name: Column) -> Column:
        return F.when(F.coalesce(i, F.lit("")) != "", i).otherwise(F.concat(F.lit("name:"), name))

    found = edges.select(node(F.col("src_id"), F.col("src_name")).alias("src"), node(F.col("dst_id"), F.col("dst_name")).alias("dst"))
    return found.filter("src <> dst").distinct()


def endpoints(known: DataFrame, name: str) -> DataFrame:
    """The nodes that a name may mean: the symbols of that name, and the name itself where nothing resolved it."""
    own = known.filter(F.col("name") == name).select(F.col("id").alias("node"))
    return own.unionByName(known.sparkSession.createDataFrame([(f"name:{name}",)], "node string")).distinct()


class _Side:
    """What was reached from one end: a stored table (node) for each distance, and edges stored by the node that is left."""

    def __init__(self, edges: DataFrame, leave: str, enter: str, start: DataFrame):
        self.edges = stored(edges.select(F.col(leave).alias("leave"), F.col(enter).alias("enter")).repartition("leave"), "edges")
        self.levels = [stored(start.select("node").distinct(), "level")]
        self.sizes = [self.levels[0].count()]

    def reached(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.levels)

    def step(self) -> DataFrame:
        """The nodes one step beyond the last frontier, as a stored table."""
        last = F.broadcast(self.levels[-1]) if self.sizes[-1] <= BROADCAST_ROWS else self.levels[-1]
        near = self.edges.join(last, F.col("leave") == F.col("node")).select(F.col("enter").alias("node")).distinct()
        self.levels.append(stored(near.join(self.reached(), "node", "left_anti"), "level"))
        self.sizes.append(self.levels[-1].count())
        return self.levels[-1]


def shortest_paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """node, distance, previous: breadth-first distances from ``start`` (node) over ``edges`` (src, dst), up to ``most``.

    Of several predecessors the smallest is kept."""
    kept = stored(edges.select("src", "dst").repartition("src"), "edges")
    none = F.lit(None).cast(start.schema["node"].dataType)
    levels = [stored(start.select("node").distinct().select("node", F.lit(0).alias("distance"), none.alias("previous")), "level")]
    size = levels[0].count()
    for distance in range(1, most + 1):
        last = levels[-1].select(F.col("node").alias("src"))
        near = kept.join(F.broadcast(last) if size <= BROADCAST_ROWS else last, "src").groupBy("dst").agg(F.min("src").alias("previous"))
        near = near.select(F.col("dst").alias("node"), F.lit(distance).alias("distance"), "previous")
        levels.append(stored(near.join(reduce(DataFrame.unionByName, levels).select("node"), "node", "left_anti"), "level"))
        size = levels[-1].count()
        if not size:
            break
    return reduce(DataFrame.unionByName, levels)


def shortest_path(edges: DataFrame, start: DataFrame, goal: DataFrame, most: int = 20) -> DataFrame:
    """step, node of a shortest path from one of ``start`` to one of ``goal`` (node), of at most ``most`` steps; empty if there is none.

    Of all shortest paths it is the one that begins at the smallest node, and goes on to the smallest at each step. The
    path is one plan over the edges that lie on shortest paths, one small join a step."""
    kind = start.schema["node"].dataType.simpleString()
    ahead, back = _Side(edges, "src", "dst", start), _Side(edges, "dst", "src", goal)
    met = stored(ahead.levels[0].join(back.levels[0], "node", "left_semi"), "met")
    steps = 0
    while not (found := met.count()) and steps < most and ahead.sizes[-1] and back.sizes[-1]:
        side, other = (ahead, back) if ahead.sizes[-1] <= back.sizes[-1] else (back, ahead)
        met = stored(side.step().join(other.levels[-1], "node", "left_semi"), "met")  # nearer levels would have met before
        steps += 1
    if not found:
        return start.sparkSession.createDataFrame([], f"step int, node {kind}")
    pairs = [*_before(ahead, met), *_after(back, met)]  # step -> edges (leave, enter) that lie on shortest paths
    first = pairs[0].select(F.col("leave").alias("node")) if pairs else met
    path = first.agg(F.array(F.min("node")).alias("path"))  # one row
    for here in pairs:
        following = here.join(F.broadcast(path), F.col("leave") == F.element_at("path", -1)).groupBy("path").agg(F.min("enter").alias("node"))
        path = following.select(F.concat("path", F.array("node")).alias("path"))
    return path.select(F.posexplode("path").alias("step", "node"))


def _before(side: _Side, met: DataFrame) -> list[DataFrame]:
    """The edges of the way to the meeting, by step: those between successive levels that lead to a node met."""
    found, ends = [], met
    for level in reversed(side.levels[:-1]):
        on = side.edges.join(ends.select(F.col("node").alias("enter")), "enter", "left_semi").join(level.select(F.col("node").alias("leave")), "leave", "left_semi")
        found.append(stored(on.select("leave", "enter").distinct(), "on"))
        ends = found[-1].select(F.col("leave").alias("node")).distinct()
    return found[::-1]


def _after(side: _Side, met: DataFrame) -> list[DataFrame]:
    """The edges of the way from the meeting to the goal, by step; the side's own edges lead the other way."""
    found, ends = [], met
    for level in reversed(side.levels[:-1]):
        on = side.edges.join(ends.select(F.col("node").alias("enter")), "enter", "left_semi").join(level.select(F.col("node").alias("leave")), "leave", "left_semi")
        found.append(stored(on.select(F.col("enter").alias("leave"), F.col("leave").alias("enter")).distinct(), "on"))
        ends = found[-1].select(F.col("enter").alias("node")).distinct()
    return found
