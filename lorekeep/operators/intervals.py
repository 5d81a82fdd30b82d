"""Points in intervals and intervals in intervals, without comparing pairs.

An interval of lines is the union of at most two cells of each size 1, 2, 4, ... (its dyadic cover); a point lies in one cell of
each size. So a point finds all intervals around it by an equi-join on cells, and as each cell keeps only its best
interval, the join makes at most one row for each point and size, however many intervals overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.running import MOST_ROWS, running

#: Cells of 2^SPLIT_LEVEL lines and more are dealt over several tasks, up to MOST_SPLITS.
SPLIT_LEVEL, MOST_SPLITS = 12, 64


def _right(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def cover(start: Column, end: Column) -> Column:
    """The cells (level, cell) whose disjoint union is the interval, both ends included; empty if it ends before it starts.

    At level k the cells wholly inside are l to r - 1; those whose parent isn't wholly inside are the first one, if l is odd,
    and the last one, if r is odd."""
    start, end = start.cast("long"), end.cast("long")
    highest = F.length(F.bin(F.greatest(end - start + 1, F.lit(1)))) - 1

    def at(level: Column) -> Column:
        left = _right(start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        right = _right(end + 1, level)
        first = F.when((left < right) & (left % 2 != 0), F.struct(level.alias("level"), left.alias("cell")))
        last = F.when((left < right) & (right % 2 != 0), F.struct(level.alias("level"), (right - 1).alias("cell")))
        return F.array(first, last)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), highest), at)), lambda c: c.isNotNull())


def _splits(level: Column) -> Column:
    return F.least(F.lit(MOST_SPLITS), F.greatest(F.lit(1), F.call_function("shiftleft", F.lit(1), F.greatest(level - SPLIT_LEVEL, F.lit(0)))))


def best_around(points: DataFrame, intervals: DataFrame, key: str, value: str, rank: list[str], group: str = "file", at: str = "line") -> DataFrame:
    """key, value: of the intervals (group, start, end, ...) of a point's group that hold it, the ``value`` of the least ``rank``.

    Points without an interval have no row. Cells of many lines, into which all points of a large group fall, are dealt over
    up to MOST_SPLITS tasks; they are copied less than once for each 2^SPLIT_LEVEL lines of their interval."""
    order = F.struct(*rank)
    cells = intervals.filter(F.col("start") <= F.col("end")).select(group, order.alias("rank"), F.col(value).alias("value"), F.explode(cover(F.col("start"), F.col("end"))).alias("c"))
    cells = cells.groupBy(group, "c.level", "c.cell").agg(F.min(F.struct("rank", "value")).alias("best"))
    sizes = [r["level"] for r in cells.select("level").distinct().collect()]  # at most 63
    if not sizes:
        return points.limit(0).select(key, F.lit(None).cast(intervals.schema[value].dataType).alias(value))
    dealt = cells.select("*", F.explode(F.sequence(F.lit(0), _splits(F.col("level")) - 1)).alias("split"))
    asked = points.select(key, group, F.col(at).cast("long").alias("at"), F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("level"))
    asked = asked.select(key, group, "level", _right(F.col("at"), F.col("level")).alias("cell"), F.pmod(F.xxhash64(key), _splits(F.col("level"))).cast("int").alias("split"))
    # Spark estimates both sides without what explode adds, and would broadcast cells that the driver can't hold.
    hits = asked.join(dealt.hint("merge"), [group, "level", "cell", "split"])
    return hits.groupBy(key).agg(F.min("best").alias("best")).select(key, F.col("best.value").alias(value))


def holders(spans: DataFrame, group: str = "file", most_rows: int = MOST_ROWS) -> DataFrame:
    """span_id, parent_id: the narrowest other span of the group that holds a whole span; of equal spans the next smaller id.

    Spans must nest, as those of source text do. Starts and ends in order give each span its depth, a running sum;
    its holder is the last span one less deep that starts before it, a running last value. Spans without a holder have no row."""
    opens = spans.select(group, F.col("start").alias("at"), F.lit(0).alias("closes"), (-F.col("end")).alias("wide"), "span_id")
    closes = spans.select(group, F.col("end").alias("at"), F.lit(1).alias("closes"), F.lit(None).cast("long").alias("wide"), "span_id")
    order = ["at", "closes", "wide", "span_id"]
    opened = running(opens.unionByName(closes), [group], order, sums={"depth": 1 - 2 * F.col("closes")}, most_rows=most_rows).filter("closes = 0").drop("closes")
    # At its own depth a span is an offer, one depth up it asks for the last offer before it.
    both = opened.withColumn("asks", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("depth", F.col("depth") - F.col("asks")).filter("depth > 0")
    found = running(both, [group, "depth"], ["at", "wide", "span_id", "asks"], lasts={"parent_id": F.when(F.col("asks") == 0, F.col("span_id"))}, most_rows=most_rows)
    return found.filter("asks = 1 and parent_id is not null").select("span_id", "parent_id")
