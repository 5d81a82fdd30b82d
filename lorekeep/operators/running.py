"""Running sums and last values within keys, of which one may hold a third of all rows.

A window over a key puts its rows into one task. Here the rows of keys that were counted and found large are dealt by range of
(key, order) into many tasks; each range is summed up by itself, and what the earlier ranges of its key hold is added from a
table with a row for each range and key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import stored

#: Rows of a key that one task may get, and keys that are broadcast at most.
MOST_ROWS, MOST_KEYS = 500_000, 100_000


def _same(keys: Sequence[str], other: str) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return found


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """``rows`` with the running sum of each of ``sums`` and the last value that isn't null of each of ``lasts``, up to and
    with the row itself, within its ``keys``, by the columns ``order`` (ascending, null first).

    ``order`` must tell the rows of a key apart, as far as the results depend on it. The rows' columns may not begin with ``__``."""
    sums, lasts = dict(sums or {}), dict(lasts or {})
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most_rows)
    hot = stored(sizes.select([F.col(k).alias(f"__hot_{k}") for k in keys]), "hot")
    many = hot.count()
    ascending = [F.asc_nulls_first(c) for c in order]
    if not many:
        upto = Window.partitionBy(*keys).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for n, c in sums.items()), *(F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in lasts.items()))
    known = F.broadcast(hot) if many <= MOST_KEYS else hot
    cold = running(rows.join(known, _same(keys, "__hot_"), "left_anti"), keys, order, sums, lasts, most_rows=1 << 62)
    return cold.unionByName(_ranged(rows.join(known, _same(keys, "__hot_"), "left_semi"), keys, order, sums, lasts).select(cold.columns))


def _ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], lasts: Mapping[str, Column]) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ascending = [F.asc_nulls_first(c) for c in order]
    dealt = rows.repartitionByRange(tasks, *(F.asc_nulls_first(k) for k in keys), *ascending)
    dealt = dealt.select("*", F.spark_partition_id().alias("__range"), *(c.alias(f"__sum_{n}") for n, c in sums.items()), *(c.alias(f"__last_{n}") for n, c in lasts.items()))
    placed = stored(dealt, "placed")
    place = F.struct(*order)
    totals = placed.groupBy("__range", *keys).agg(*(F.sum(f"__sum_{n}").alias(n) for n in sums), *(F.max_by(f"__last_{n}", F.when(F.col(f"__last_{n}").isNotNull(), place)).alias(n) for n in lasts))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    carried = totals.select(
        F.col("__range").alias("__at___range"),
        *(F.col(k).alias(f"__at_{k}") for k in keys),
        *(F.sum(n).over(before).alias(f"__c_{n}") for n in sums),
        *(F.last(n, ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts),
    )
    upto = Window.partitionBy("__range", *keys).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.select(*rows.columns, "__range", *(F.coalesce(F.sum(f"__sum_{n}").over(upto), F.lit(0)).alias(f"__w_{n}") for n in sums), *(F.last(f"__last_{n}", ignorenulls=True).over(upto).alias(f"__w_{n}") for n in lasts))
    # Keys here are large, so there are fewer than two rows a range in ``carried``.
    met = within.join(F.broadcast(carried), _same(["__range", *keys], "__at_"), "left")
    return met.select(*rows.columns, *((F.col(f"__w_{n}") + F.coalesce(f"__c_{n}", F.lit(0))).alias(n) for n in sums), *(F.coalesce(f"__w_{n}", f"__c_{n}").alias(n) for n in lasts))
