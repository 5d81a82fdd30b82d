import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.capture import log_entries, turns
from lorekeep.sources import commits, files, jsonl, tables, transcripts
from lorekeep.streaming.turns import ingest, ingested


def prompt(text):
    return json.dumps({"type": "user", "cwd": "/w", "message": {"content": text}})


def answer(text):
    return json.dumps({"type": "assistant", "message": {"content": text}})


def test_appended_log(spark, tmp_path):
    """A stream over a file that grows, with a torn line, gives what a batch over the whole file gives."""
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    spark.dataSource.register(transcripts.TranscriptSource)
    log = logs / "s1.jsonl"
    log.write_text(prompt("first question") + "\n" + answer("first part") + "\n" + answer("torn")[:10])

    def run():
        lines = spark.readStream.format("transcripts").load(str(logs))
        ingest(log_entries(lines), str(out)).awaitTermination()
        return [tuple(r) for r in ingested(spark, str(out)).orderBy("turn_no").select("turn_no", "prompt", "reasoning").collect()]

    assert run() == [(1, "first question", "first part")]
    log.write_text(prompt("first question") + "\n" + answer("first part") + "\n" + answer("torn") + "\n" + prompt("second") + "\n")
    assert run() == [(1, "first question", "first part\ntorn"), (2, "second", "")]
    whole = turns(log_entries(transcripts.transcripts(spark, str(logs))))
    assert [tuple(r) for r in whole.orderBy("turn_no").select("turn_no", "prompt", "reasoning").collect()] == run()
    assert transcripts.project_of(transcripts.transcripts(spark, str(logs))).head()["project"] == "/w"
    assert transcripts.sessions_on_disk(spark, str(logs)).head()["session_id"] == "s1"


def stream_turns(spark, logs, out):
    spark.dataSource.register(transcripts.TranscriptSource)
    ingest(log_entries(spark.readStream.format("transcripts").load(str(logs))), str(out)).awaitTermination()
    return [tuple(r) for r in ingested(spark, str(out)).orderBy("session_id", "turn_no").select("session_id", "turn_no", "prompt", "reasoning").collect()]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_rotated_log(spark, tmp_path, scheme):
    """A log that is replaced by another one, longer or shorter: the turns of both are kept."""
    logs = tmp_path / "logs"
    logs.mkdir()
    log = logs / "s.jsonl"
    log.write_text(prompt("old question") + "\n" + answer("old answer") + "\n")
    assert stream_turns(spark, f"{scheme}{logs}", tmp_path / "out") == [("s", 1, "old question", "old answer")]
    log.write_text(prompt("new question, which is longer than the old one was") + "\n" + answer("a longer answer than before") + "\n" + prompt("one more") + "\n")
    both = [("s", 1, "old question", "old answer"), ("s", 2, "new question, which is longer than the old one was", "a longer answer than before"), ("s", 3, "one more", "")]
    assert stream_turns(spark, f"{scheme}{logs}", tmp_path / "out") == both
    with log.open("a") as file:
        file.write(answer("and its answer") + "\n")
    both[2] = ("s", 3, "one more", "and its answer")
    assert stream_turns(spark, f"{scheme}{logs}", tmp_path / "out") == both
    log.write_text(prompt("third") + "\n")
    assert stream_turns(spark, f"{scheme}{logs}", tmp_path / "out") == [*both, ("s", 4, "third", "")]
    assert stream_turns(spark, f"{scheme}{logs}", tmp_path / "out") == [*both, ("s", 4, "third", "")]


def test_sessions_are_named_by_path(spark, tmp_path):
    for folder in ("a b", "c+d"):
        (tmp_path / "logs" / folder).mkdir(parents=True)
        (tmp_path / "logs" / folder / "s.jsonl").write_text(prompt(f"in {folder}") + "\r\n" + answer("é東") + "\n" + answer("x") + "\n")
    found = stream_turns(spark, tmp_path / "logs", tmp_path / "out")
    assert found == [("a b/s", 1, "in a b", "é東\nx"), ("c+d/s", 1, "in c+d", "é東\nx")]
    batch = turns(log_entries(transcripts.transcripts(spark, str(tmp_path / "logs"))))
    columns = ("session_id", "offset", "prompt", "reasoning")
    assert sorted(map(tuple, batch.select(*columns).collect())) == sorted(map(tuple, ingested(spark, str(tmp_path / "out")).select(*columns).collect()))
    assert {r["session_id"] for r in transcripts.sessions_on_disk(spark, str(tmp_path / "logs")).collect()} == {"a b/s", "c+d/s"}


def test_pieces_of_a_large_log(tmp_path, monkeypatch):
    """Lines of any length come once each, however the file is cut."""
    monkeypatch.setattr(transcripts, "PIECE", 37)
    monkeypatch.setattr(transcripts, "BLOCK", 16)
    lines = [("x" * (i * 7 % 90)) + str(i) for i in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\ntorn")
    reader = transcripts._Tail(str(tmp_path), f"{tmp_path}/notes")
    end = reader.latestOffset()
    found = [row for piece in reader.partitions({}, end) for row in reader.read(piece)]
    assert [v for _, _, v in found] == lines
    assert [o for _, o, _ in found] == [sum(len(x) + 1 for x in lines[:i]) for i in range(60)]


def test_import_export(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"id": "a", "project": "p", "title": "t", "tags": ["x"]}\n\n{"id": "b"}\n{"torn\n')
    rows = jsonl.import_rows(spark, str(source))
    assert [r["id"] for r in rows.collect()] == ["a"]
    jsonl.export_rows(rows, str(tmp_path / "out"))
    assert [r["tags"] for r in jsonl.import_rows(spark, str(tmp_path / "out")).collect()] == [["x"]]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert tables.read_table(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "ftp://x", "t")


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "a.py")
    git("commit", "-m", "Add a")
    row = commits.commits_of(spark, str(tmp_path), 5).head()
    assert row["subject"] == "Add a" and row["author"] == "Ann" and "a.py" in row["paths"]
    assert commits.commits_of(spark, "/nowhere", 5).count() == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("class A:\n    def f(self):\n        pass\n\n\ndef g():\n    pass\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.py").write_bytes(b"x\x00y")
    found = files.source_files(spark, str(tmp_path))
    assert [r["file"].rsplit("/", 1)[1] for r in found.collect()] == ["a.py"]
    assert {(r["name"], r["kind"]) for r in files.python_symbols(found).collect()} == {("A", "class"), ("f", "method"), ("g", "function")}
    known = found.select(F.col("file").alias("path"), "hash")
    assert files.to_scan(found, known).count() == 0 and files.unchanged(found, known).count() == 1


def test_late_entries(spark, tmp_path):
    """Answers that come after later prompts still find their turn, whatever the order of the files."""
    kind = "session_id string, offset long, role string, text string, files array<string>, commands array<string>, timestamp long, compacted boolean"
    say = lambda at, role, text: ("s", at, role, text, [], [], at, False)
    first = [say(1, "user", "fix the parser of dates"), say(3, "user", "then rename the helper")]
    late = [say(2, "assistant", "the parser is fixed"), say(4, "assistant", "renamed")]
    for rows in (first, late):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    found = {(r["turn_no"], r["offset"], r["reasoning"]) for r in ingested(spark, str(tmp_path / "out")).collect()}
    assert found == {(1, 1, "the parser is fixed"), (2, 3, "renamed")}
