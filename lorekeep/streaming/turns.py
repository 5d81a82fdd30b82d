"""Turns from a growing log, by state that is kept for each session.

The state of a session is where its turns begin, and the entries of each turn under its own key. An entry goes to the turn that
begins last at or before it, whenever it comes; a prompt that comes late splits the turn it falls into. So a
batch reads and writes the turns that its entries touch, however long the log has become, and its result is the
touched turns in their present state. An entry that is read again replaces itself.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorekeep.operators.capture import asks
from lorekeep.operators.store import latest

KEYS = ["session_id", "offset"]
TURN = "session_id string, offset long, timestamp long, prompt string, reasoning string, files array<string>, commands array<string>"
#: Stands for the entries before a session's first prompt, which are no turn until a prompt comes that precedes them.
BEFORE = -1
_PROVIDER, _TASKS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
#: Tasks that a stream's state is dealt over at least.
MIN_TASKS = 8


class _Turns(StatefulProcessor):
    """Per session: ``starts``, the offsets of its prompts, and for each of them the entries of its turn, by offset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getValueState("starts", "offsets string")
        self.turns = handle.getMapState("turns", "start long", "entries string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        starts = json.loads(self.starts.get()[0]) if self.starts.exists() else []
        known, touched = len(starts), {}

        def turn(start: int) -> dict[str, list]:
            if start not in touched:
                touched[start] = json.loads(self.turns.getValue((start,))[0]) if self.turns.containsKey((start,)) else {}
            return touched[start]

        for row in rows:
            entry = [row["asks"], row["text"], row["files"], row["commands"], row["timestamp"]]
            at = bisect_right(starts, row["offset"])
            start = starts[at - 1] if at else BEFORE
            if row["asks"] and start != row["offset"]:
                insort(starts, row["offset"])
                split, start = turn(start), row["offset"]
                later = [o for o in split if int(o) > start]
                turn(start).update({o: split.pop(o) for o in later})
            turn(start)[str(row["offset"])] = entry
        if len(starts) > known:
            self.starts.update((json.dumps(starts),))
        for start, entries in touched.items():
            self.turns.updateValue((start,), (json.dumps(entries),))
            if start != BEFORE:
                yield self._row(key[0], start, entries)

    def _row(self, session: str, start: int, entries: dict[str, list]) -> Row:
        """The turn as capture.turns makes it."""
        prompt, answers = entries[str(start)], [e for _, e in sorted(((int(o), e) for o, e in entries.items()), key=lambda x: x[0]) if not e[0]]
        joined = [[x for e in answers for x in e[i] or []] for i in (2, 3)]
        return Row(session_id=session, offset=start, timestamp=prompt[4], prompt=prompt[1], reasoning="\n".join(e[1] for e in answers if e[1]), files=joined[0], commands=joined[1])

    def close(self) -> None:
        pass


def changed_turns(entries: DataFrame) -> DataFrame:
    """The turns that a stream of log entries (see capture.turns) changes, in their present state (TURN)."""
    rows = entries.withColumn("asks", asks()).filter(F.col("asks") | (F.col("role") == "assistant"))
    rows = rows.select("session_id", F.col("offset").cast("long").alias("offset"), "asks", "text", "files", "commands", F.col("timestamp").cast("long").alias("timestamp"))
    return rows.groupBy("session_id").transformWithState(_Turns(), TURN, "Append", "None")


@contextmanager
def keyed_state(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which reads single keys, dealt over ``tasks`` (see state_tasks).

    Each batch opens and commits the state of every task, also of those that it has no rows for."""
    own = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _TASKS: str(tasks or state_tasks(spark))}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def state_tasks(spark: SparkSession) -> int:
    """One task a core, MIN_TASKS at least, but no more than a shuffle has. A stream keeps the number that it first started with."""
    return min(int(spark.conf.get(_TASKS)), max(MIN_TASKS, spark.sparkContext.defaultParallelism))


def ingest(entries: DataFrame, folder: str, tasks: int | None = None) -> StreamingQuery:
    """Starts a stream of log entries into ``folder``, which gets each batch's changed turns; ends when all there is was read.

    A batch that is repeated after a failure overwrites its own folder. ``tasks`` are those of its state (see keyed_state)."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/turns/batch={number}")

    with keyed_state(entries.sparkSession, tasks):
        return changed_turns(entries).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with their numbers within their sessions."""
    return turns.withColumn("turn_no", F.row_number().over(Window.partitionBy("session_id").orderBy("offset")).cast("long"))


def ingested(spark: SparkSession, folder: str, batch: Column | None = None) -> DataFrame:
    """All turns so far in their last state, numbered."""
    rows = spark.read.schema(f"{TURN}, batch long").parquet(f"{folder}/turns")
    return numbered(latest(rows if batch is None else rows.filter(batch), KEYS, [F.col("batch")]).drop("batch"))
