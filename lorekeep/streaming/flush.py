"""From a growing log to recorded memory: turns, observations, vectors, summaries and closed work, batch by batch.

One query holds two states for each session: its turns (see streaming.turns), and the titles that its summary is chosen from.
What a batch changes is committed at once in all tables (see sources.versions), together with the batch's number, so a batch that
is repeated after a failure changes nothing. A batch reads its own entries, the state of what they touch, and the open
work; never the log, the observations or the sessions there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorekeep.functions.vectors import embed
from lorekeep.operators.capture import candidates, kind_rank
from lorekeep.operators.store import all_clean
from lorekeep.session import stored
from lorekeep.sources.versions import Tables
from lorekeep.streaming.turns import changed_turns, keyed_state

#: Titles of a summary, and batches after which small segments are merged.
MOST_TITLES, MERGE_EVERY = 3, 16
EMBEDDER = "builtin"


class _Titles(StatefulProcessor):
    """Per session: the rank, time and title of each observation. Rows come out with the session's summary and first time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.titles = handle.getValueState("titles", "by_id string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found, passed = json.loads(self.titles.get()[0]) if self.titles.exists() else {}, []
        for row in rows:
            passed.append(row)
            if row["substantive"]:
                found[row["id"]] = [row["rank"], row["created_at"], row["title"]]
            else:
                found.pop(row["id"], None)
        self.titles.update((json.dumps(found),))
        first: dict[str, tuple] = {}
        for i, (rank, at, title) in found.items():
            first[title] = min(first.get(title, (rank, at, i)), (rank, at, i))
        best = sorted(first, key=first.get)[:MOST_TITLES]
        for row in passed:
            yield Row(**(row.asDict() | {"summary": " | ".join(best) if best else None, "started_at": min((x[1] for x in found.values()), default=None)}))

    def close(self) -> None:
        pass


def _summed(rows: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", summary string, started_at long"
    return rows.groupBy("session_id").transformWithState(_Titles(), schema, "Append", "None")


def flush(entries: DataFrame, store: Tables, checkpoint: str, now: int, project: Column | None = None, dirty: DataFrame | None = None, tasks: int | None = None) -> StreamingQuery:
    """Starts a stream of log entries (see capture.turns) into the tables ``observations``, ``sessions``, ``open_work`` and ``done``
    of ``store``; ends when all there is was read.

    ``project`` is the project of a turn's session (the session itself if None). ``dirty`` (project, files) has the files with
    changes that haven't landed, one row a project: before a batch is recorded, open work none of whose files is dirty is closed;
    nothing is closed if it is None. ``tasks`` are those of its states (see turns.keyed_state)."""

    def record(batch: DataFrame, number: int) -> None:
        after, rows = store.versions.latest(), stored(batch, "flush")  # the states are read, and written, once
        done = store.mark("batch", after)
        if done is not None and done >= number:
            return  # it was committed before the query could note it
        kept, gone = rows.filter("substantive"), rows.filter("not substantive").select("id")
        vectors = kept.drop("substantive", "rank", "summary", "started_at").withColumn("embedding", embed(F.concat_ws("\n", "title", "body"))).withColumn("embedder", F.lit(EMBEDDER))
        sessions = rows.filter("summary is not null").groupBy(F.col("session_id").alias("id")).agg(F.min("project").alias("project"), F.min("started_at").alias("started_at"), F.lit(None).cast("long").alias("ended_at"), F.min("summary").alias("summary"))
        emptied = rows.filter("summary is null").select(F.col("session_id").alias("id"))
        opened, closed = kept.filter("status = 'open'").select("id", "project", "files"), rows.filter("not (substantive and status = 'open')").select("id")
        changes = {"observations": (vectors, gone, ["id"]), "sessions": (sessions, emptied, ["id"]), "open_work": (opened, closed, ["id"])}
        if dirty is not None and "open_work" in store.names(after):
            landed = _landed(store.read("open_work", after), dirty)
            landed = stored(landed.join(opened.select("id"), "id", "left_anti"), "landed")  # what the batch records anew is open
            changes |= {"open_work": (opened, closed.unionByName(landed), ["id"]), "done": (landed, None, ["id"])}
        store.change(changes, after, {"batch": number})
        if number % MERGE_EVERY == MERGE_EVERY - 1:
            store.merge()

    turns = changed_turns(entries)
    made = candidates(turns, F.col("session_id") if project is None else project, now).withColumn("rank", kind_rank(F.col("kind")))
    with keyed_state(entries.sparkSession, tasks):
        return _summed(made).writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _landed(work: DataFrame, dirty: DataFrame) -> DataFrame:
    """Ids of open work (id, project, files) none of whose files is dirty."""
    files = dirty.select(F.col("project").alias("__project"), F.col("files").alias("__dirty"))
    met = work.join(files, F.col("project") == F.col("__project"), "left")
    return met.filter(all_clean(F.col("files"), F.coalesce("__dirty", F.array().cast("array<string>")))).select("id")


def recorded(spark: SparkSession, store: Tables) -> DataFrame:
    """The observations there are, with their present status."""
    rows = store.read("observations")
    if "done" not in store.names():
        return rows
    done = store.read("done").select(F.col("id").alias("__done"))
    return rows.join(done, F.col("id") == F.col("__done"), "left").withColumn("status", F.when(F.col("__done").isNotNull(), "done").otherwise(F.col("status"))).drop("__done")
