"""Streams with keyed state against the batch functions over the same log."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.vectors import embed
from lorekeep.operators import capture
from lorekeep.plans.captures import entries
from lorekeep.plans.catalog import NOW
from lorekeep.sources.versions import Tables
from lorekeep.streaming.flush import flush, recorded
from lorekeep.streaming.turns import ingest, ingested

SCHEMA = "session_id string, offset long, role string, text string, files array<string>, commands array<string>, timestamp long, compacted boolean"
SAID = [
    "We decided to keep the cache in one place. It failed under load before.",
    "Fixed the bug in the parser. The regression came from the tokenizer change.",
    "Now running the tests.",
    "",
    "The retry loop never gave up, so it was replaced by a bounded one. That works.",
]


def log(seed=0, sessions=5, length=30):
    draw, rows = random.Random(seed), []
    for s in range(sessions):
        for offset in range(length):
            role = draw.choice(["user", "assistant", "assistant", "system"])
            text = draw.choice(["why does the build break?", "use tabs from now on", "ok", "<command-name>x</command-name>", ""]) if role == "user" else draw.choice(SAID)
            files = [f"s{s}/src/{draw.choice('abc')}.py"] if role == "assistant" and draw.random() < 0.3 else []
            commands = ["npm test"] if role == "assistant" and draw.random() < 0.2 else []
            rows.append((f"s{s}", offset, role, text, files, commands, None if role == "assistant" and draw.random() < 0.2 else 1_000 * offset + s, False))
    draw.shuffle(rows)
    return rows


def stream(spark, folder, rows, batches):
    """The rows as a stream of as many micro-batches, in the order given."""
    for i in range(batches):
        part = rows[i::batches]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{folder}/log")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


TURN = ("session_id", "turn_no", "offset", "timestamp", "prompt", "reasoning", "files", "commands")


@pytest.mark.parametrize("seed", range(2))
def test_turns_in_any_order(spark, tmp_path, seed):
    rows = log(seed)
    again = rows + rows[: len(rows) // 4]  # some entries are read twice
    run = ingest(stream(spark, str(tmp_path), again, 10), str(tmp_path))
    run.awaitTermination()
    assert len({p["batchId"] for p in run.recentProgress}) >= 10
    assert rows_of(ingested(spark, str(tmp_path)), *TURN) == rows_of(capture.turns(spark.createDataFrame(rows, SCHEMA)), *TURN)


def test_a_batch_touches_its_own_turns_only(spark, tmp_path):
    """A long session: batches of one size read and update as many rows late as early."""
    rows = [("s", i, "user" if i % 4 == 0 else "assistant", f"question {i}?" if i % 4 == 0 else SAID[i % 5], [], [], i, False) for i in range(400)]
    source = stream(spark, str(tmp_path), [r for i in range(20) for r in rows[i * 20 : i * 20 + 20]], 1)
    for i in range(20):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ordered")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/ordered")
    run = ingest(source, str(tmp_path))
    run.awaitTermination()
    steps = [p for p in run.recentProgress if p["numInputRows"]]
    assert {p["numInputRows"] for p in steps} == {20} and len(steps) == 20
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in steps]
    assert max(updated) <= 8  # five or six turns and the list of starts
    written = [spark.read.parquet(f"{tmp_path}/turns/batch={p['batchId']}").count() for p in steps]
    assert max(written) <= 6


def batch_result(spark, rows):
    found = capture.turns(spark.createDataFrame(rows, SCHEMA))
    made = capture.observations_from_turns(found, F.col("session_id"), NOW)
    return made, capture.session_summaries(made)


OBSERVATION = ("id", "session_id", "project", "kind", "title", "body", "files", "tags", "created_at", "status")


def test_flush_in_any_order(spark, tmp_path):
    rows = log(7, sessions=6, length=40)
    store = Tables(spark, f"{tmp_path}/store")
    run = flush(stream(spark, str(tmp_path), rows, 12), store, f"{tmp_path}/checkpoint", NOW)
    run.awaitTermination()
    assert len({p["batchId"] for p in run.recentProgress}) >= 12
    made, summaries = batch_result(spark, rows)
    assert made.count() > 20
    assert rows_of(store.read("observations"), *OBSERVATION) == rows_of(made, *OBSERVATION)
    assert rows_of(store.read("sessions"), F.col("id").alias("session_id"), "summary") == rows_of(summaries, "session_id", "summary")
    first = made.groupBy("session_id").agg(F.min("created_at").alias("at"))
    assert rows_of(store.read("sessions"), "id", "started_at") == rows_of(first, "session_id", "at")
    vectors = made.select("id", embed(F.concat_ws("\n", "title", "body")).alias("v"))
    assert rows_of(store.read("observations"), "id", "embedding") == rows_of(vectors, "id", "v")
    assert rows_of(store.read("open_work"), "id") == rows_of(made.filter("status = 'open'"), "id")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = log(3)
    store, source = Tables(spark, f"{tmp_path}/store"), stream(spark, str(tmp_path), rows, 4)
    flush(source, store, f"{tmp_path}/checkpoint", NOW).awaitTermination()
    version, before = store.versions.latest(), rows_of(store.read("observations"), *OBSERVATION)
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the query had died between the commit of the tables and its own
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    flush(source, store, f"{tmp_path}/checkpoint", NOW).awaitTermination()
    assert store.versions.latest() == version and rows_of(store.read("observations"), *OBSERVATION) == before


def test_a_batch_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    rows = log(4)
    store, source = Tables(spark, f"{tmp_path}/store"), stream(spark, str(tmp_path), rows, 4)
    commit, count = store.versions.commit, iter(range(99))

    def dying(state, after):
        if next(count) == 2:
            raise RuntimeError("lost")
        return commit(state, after)

    monkeypatch.setattr(store.versions, "commit", dying)
    with pytest.raises(Exception, match="lost"):
        flush(source, store, f"{tmp_path}/checkpoint", NOW).awaitTermination()
    flush(source, store, f"{tmp_path}/checkpoint", NOW).awaitTermination()
    made, summaries = batch_result(spark, rows)
    assert rows_of(store.read("observations"), *OBSERVATION) == rows_of(made, *OBSERVATION)
    assert rows_of(store.read("sessions"), F.col("id").alias("session_id"), "summary") == rows_of(summaries, "session_id", "summary")


def test_landed_work_is_closed(spark, tmp_path):
    """Work that was open before a batch and whose files are clean is closed by it; what the batch records stays open."""
    asked = lambda s, o: (s, o, "user", "why does the build break?", [], [], o, False)
    wrote = lambda s, o, f: (s, o, "assistant", SAID[1], [f"{s}/src/{f}.py"], [], o, False)
    rows = [asked("p", 1), wrote("p", 2, "a"), asked("p", 3), wrote("p", 4, "b")]
    dirty = spark.createDataFrame([("p", ["p/src/b.py"])], "project string, files array<string>")
    store = Tables(spark, f"{tmp_path}/store")
    flush(stream(spark, str(tmp_path), rows, 1), store, f"{tmp_path}/checkpoint", NOW, dirty=dirty).awaitTermination()
    assert {r["status"] for r in recorded(spark, store).collect()} == {"open"}
    flush(stream(spark, str(tmp_path), [asked("p", 5), wrote("p", 6, "c")], 1), store, f"{tmp_path}/checkpoint", NOW, dirty=dirty).awaitTermination()
    status = {r["files"][0]: r["status"] for r in recorded(spark, store).collect()}
    assert status == {"p/src/a.py": "done", "p/src/b.py": "open", "p/src/c.py": "open"}
    assert store.read("open_work").count() == 2


def test_conversations(spark, sf, tmp_path):
    """All conversations of the driver's tables, as the registered query streams them."""
    from lorekeep import plans

    found = plans.QUERIES["streaming_flush"](spark, sf)
    made = capture.observations_from_turns(capture.turns(entries(spark, sf)), F.col("session_id"), NOW)
    columns = ("id", "session_id", "kind", "title", "created_at", "status")
    assert found.count() > 0 and rows_of(found, *columns) == rows_of(made, *columns)
    assert rows_of(found, "session_id", "summary") == rows_of(made.join(capture.session_summaries(made), "session_id"), "session_id", "summary")
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_state_is_dealt_over_cores_not_over_shuffle_partitions(spark, tmp_path):
    """Each batch opens the state of every task, so many empty ones cost time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        ingest(stream(spark, str(tmp_path), log(sessions=2, length=5), 1), str(tmp_path)).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kept = [p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert len(kept) == min(40, max(8, spark.sparkContext.defaultParallelism))
    assert ingested(spark, str(tmp_path)).count() == rows_in_batch(spark)


def rows_in_batch(spark):
    return capture.turns(spark.createDataFrame(log(sessions=2, length=5), SCHEMA)).count()
