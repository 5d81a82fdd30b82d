"""The store's algebra over tables: scans, pages, upserts, deletes, timelines.

A mutation takes the old table and returns the new one. Writing it is the caller's business (see
sources.tables), so a failed job leaves the old table in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.ids import FULL, matches_ids
from lorekeep.operators.running import MOST_ROWS, running


def _all(conditions: list[Column]) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found


def list_page(observations: DataFrame, project: str | None = None, kind: str | None = None, status: str | None = None, after: int | None = None, limit: int | None = 1000) -> DataFrame:
    """Oldest first; ``after`` is exclusive."""
    wanted = [F.col(c) == v for c, v in (("project", project), ("kind", kind), ("status", status)) if v is not None]
    if after is not None:
        wanted.append(F.col("created_at") > after)
    rows = observations.filter(_all(wanted)).orderBy("created_at", "id")
    return rows if limit is None else rows.limit(limit)


def in_range(created_at: Column, since: int | None = None, until: int | None = None) -> Column:
    """Both ends inclusive."""
    return _all([c for c, v in ((created_at >= F.lit(since), since), (created_at <= F.lit(until), until)) if v is not None])


def get_by_ids(observations: DataFrame, ids: Sequence[str]) -> DataFrame:
    return observations.filter(matches_ids(F.col("id"), list(ids)))


def recent_sessions(sessions: DataFrame, project: str, limit: int) -> DataFrame:
    """The newest sessions of a project that have a summary."""
    return sessions.filter((F.col("project") == project) & F.col("summary").isNotNull()).orderBy(F.desc("started_at"), "id").limit(limit)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the rows of each key the last by ``order``, by an aggregate that combines before the shuffle."""
    payload = F.struct(*rows.columns)
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*keys).agg(F.max_by(payload, rank).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """New rows replace old ones of the same key. Keys of ``new`` must be unique (see ``latest``)."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def coalescing_upsert(old: DataFrame, new: DataFrame, kept: Sequence[str] = ("project", "started_at"), filled: Sequence[str] = ("ended_at", "summary")) -> DataFrame:
    """Sessions: what was first known of ``kept`` stays; ``filled`` take new values unless these are null."""
    a, b = old.alias("a"), new.alias("b")
    columns = [F.coalesce(F.col("a.id"), F.col("b.id")).alias("id")]
    columns += [F.when(F.col("a.id").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in kept]
    columns += [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in filled]
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(*columns)


def clear_summary(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.withColumn("summary", F.when(F.col("id") != session_id, F.col("summary")))


def removal(ids: Sequence[str] | None = None, project: str | None = None, kind: str | None = None, before: int | None = None) -> Column:
    """What a filtered delete removes. An empty list of ids removes nothing; no filter at all, everything."""
    wanted = [matches_ids(F.col("id"), list(ids))] if ids is not None else []
    wanted += [F.col(c) == v for c, v in (("project", project), ("kind", kind)) if v is not None]
    if before is not None:
        wanted.append(F.col("created_at") < before)
    return _all(wanted)


def remove(observations: DataFrame, **filters) -> DataFrame:
    return observations.filter(~F.coalesce(removal(**filters), F.lit(False)))


def close(observations: DataFrame, landed: Column) -> DataFrame:
    """Open work that ``landed`` becomes done; nothing is opened again."""
    return observations.withColumn("status", F.when((F.col("status") == "open") & landed, "done").otherwise(F.col("status")))


def all_clean(files: Column, dirty: Column) -> Column:
    """Whether none of the files is among the dirty ones; true of no files."""
    return F.forall(files, lambda f: ~F.array_contains(dirty, f))


def timeline(observations: DataFrame, anchor: str, before: int, after: int) -> DataFrame:
    """The anchor (an id or a prefix of one), what came before it and after it in its project, in order."""
    start = observations.filter(matches_ids(F.col("id"), [anchor]) if len(anchor) < FULL else F.col("id") == anchor).orderBy("id").limit(1)
    start = F.broadcast(start.select(F.col("project").alias("__project"), F.struct("created_at", "id").alias("__at")))  # one row
    rows = observations.join(start, F.col("project") == F.col("__project"))
    place = F.struct("created_at", "id")
    past = rows.filter(place <= F.col("__at")).orderBy(F.desc("created_at"), F.desc("id")).limit(before + 1)
    later = rows.filter(place > F.col("__at")).orderBy("created_at", "id").limit(after)
    return past.union(later).drop("__project", "__at").orderBy("created_at", "id")


def timeline_all(observations: DataFrame, anchors: Column, before: int, after: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """anchor_id, id, offset: the timeline of every row that ``anchors`` selects. A large project's rows are numbered by many tasks."""
    numbered = running(observations.select("id", "project", "created_at", anchors.alias("is_anchor")), ["project"], ["created_at", "id"], sums={"place": F.lit(1)}, most_rows=most_rows)
    near = numbered.filter("is_anchor").select(F.col("id").alias("anchor_id"), "project", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "place")
    near = near.withColumn("place", F.col("place") + F.col("offset"))
    return near.join(numbered.select("project", "place", "id"), ["project", "place"]).select("anchor_id", "id", "offset")


def changes(known: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, changed or deleted, by comparing values (null equals null)."""
    a, b = known.select(F.col(key).alias("a"), F.col(value).alias("x")), found.select(F.col(key).alias("b"), F.col(value).alias("y"))
    both = a.join(b, F.col("a") == F.col("b"), "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(F.coalesce("a", "b").alias(key), kind.alias("change")).filter("change is not null")


def missing(here: DataFrame, there: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``there`` that ``here`` lacks, by key."""
    return there.join(here.select(key), key, "left_anti")


def two_way_sync(a: DataFrame, b: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Both stores with what the other one had."""
    return a.unionByName(missing(a, b, key)), b.unionByName(missing(b, a, key))


def merge_project(observations: DataFrame, source: str, target: str) -> DataFrame:
    return observations.withColumn("project", F.when(F.col("project") == source, target).otherwise(F.col("project")))


def last_shown(shown: DataFrame, most: int = 300) -> DataFrame:
    """The last ``most`` shown ids of each session. Tasks keep that many of a session before rows are shuffled."""
    order = Window.partitionBy("session_id").orderBy(F.desc("shown_at"), "id")
    return shown.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def not_shown(found: DataFrame, shown: DataFrame) -> DataFrame:
    return found.join(shown.select("id"), "id", "left_anti")


def foreign_tables(spark, own: str = r"^(observations|sessions|symbols|symbol_edges|scanned_files|postings)") -> list[str]:
    """Names of the catalog's tables that aren't the store's own."""
    import re

    return sorted(t.name for t in spark.catalog.listTables() if not re.match(own, t.name))


def ping(spark) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1


def removed_count(observations: DataFrame, **filters) -> DataFrame:
    """One row: how many rows ``remove`` takes away."""
    return observations.agg(F.count_if(removal(**filters)).alias("removed"))


def wiped(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """Every table (with a project column) without what belongs to a project."""
    return {name: rows.filter(~F.col("project").eqNullSafe(F.lit(project))) for name, rows in tables.items()}


def swept(cursors: DataFrame, live: DataFrame, key: str = "session_id") -> DataFrame:
    """Cursors whose transcript still exists."""
    return cursors.join(live.select(key).distinct(), key, "left_semi")


def session_sync(here: DataFrame, there: DataFrame, observations: DataFrame) -> DataFrame:
    """Sessions of ``there`` that ``here`` lacks, of the projects that have observations."""
    return missing(here, there).join(observations.select("project").distinct(), "project", "left_semi")


def stale(observations: DataFrame, embedder: str) -> DataFrame:
    """Rows without a vector, or with one of another embedder."""
    return observations.filter(F.col("embedding").isNull() | ~F.col("embedder").eqNullSafe(F.lit(embedder)))
