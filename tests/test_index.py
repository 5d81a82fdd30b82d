"""The inverted index under change: the same answers as a scan, at the cost of the change."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import index, search
from lorekeep.sources.versions import Conflict

WORDS = "websocket reconnect storm token refresh virtual list redux editor performance worse backoff".split()
SCHEMA = "id string, project string, title string, body string, tags array<string>, kind string"
TEXT = "websocket performance of the editor"


def row(i, shift=0):
    word = lambda k: WORDS[(i * 7 + k * k + shift) % len(WORDS)]
    return (f"id{i:03}", None if i % 11 == 0 else f"p{i % 3}", word(1), " ".join(word(k) for k in range(i % 17)) if i % 13 else None, [word(5)] if i % 5 else None, "odd" if i % 2 else "even")


def table(spark, ids, shift=0):
    return spark.createDataFrame([row(i, shift) for i in ids], SCHEMA)


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.select("id", "score").collect()}


def same(made, observations):
    assert scores(search.indexed_scores(made, TEXT)) == scores(search.keyword_search(observations, TEXT, None))
    n, total = observations.select(F.count("*"), F.sum(F.size(F.flatten(F.array(*map(index.tokens, index._fields())))))).head()
    assert (made.size, round(made.average_length * made.size)) == (n, total or 0)


def test_batches_replacements_and_deletes(spark, tmp_path):
    made = index.SearchIndex(spark, str(tmp_path))
    for part in range(6):
        made.apply(table(spark, range(part, 120, 6)))
    same(made, table(spark, range(120)))
    assert len(made.state["segments"]) < 6  # merged
    made.apply(table(spark, range(0, 120, 4), shift=3))
    now = table(spark, range(0, 120, 4), shift=3).unionByName(table(spark, [i for i in range(120) if i % 4]))
    same(made, now)
    made.apply(deletes=now.filter("kind = 'odd'"))
    same(made, now.filter("kind = 'even'"))
    made.apply(table(spark, [1, 500]), now.filter("id = 'id002'"))
    same(made, now.filter("kind = 'even' and id <> 'id002'").unionByName(table(spark, [1, 500])))
    same(index.SearchIndex(spark, str(tmp_path)), now.filter("kind = 'even' and id <> 'id002'").unionByName(table(spark, [1, 500])))


def test_a_change_writes_no_more_than_itself(spark, tmp_path):
    made = index.SearchIndex(spark, str(tmp_path))
    made.apply(table(spark, range(200)))
    before = made.state["segments"][0]
    made.apply(table(spark, [3], shift=1))
    old, new = made.state["segments"]
    assert (old["postings"], old["rows"]) == (before["postings"], before["rows"]) and old["n_dead"] == 1
    assert new["n"] == 1


def test_worn_segments_are_written_again(spark, tmp_path):
    made = index.SearchIndex(spark, str(tmp_path))
    made.apply(table(spark, range(30)))
    made.apply(deletes=table(spark, range(20)))
    [only] = made.state["segments"]
    assert (only["n"], only["n_dead"]) == (10, 0)
    made.apply(deletes=table(spark, range(30)))
    assert made.state["segments"] == [] and made.size == 0
    assert search.indexed_scores(made, TEXT).count() == 0


def test_refresh_indexes_what_changed(spark, tmp_path):
    made = index.SearchIndex(spark, str(tmp_path)).refresh(table(spark, range(50)))
    version = made.version
    assert made.refresh(table(spark, range(50))).version == version
    now = table(spark, range(5, 50)).filter("id <> 'id030'").unionByName(table(spark, [30, 70], shift=2))
    same(made.refresh(now), now)
    assert made.state["segments"][-1]["n"] == 2


def test_readers_keep_their_version(spark, tmp_path):
    made = index.SearchIndex(spark, str(tmp_path))
    made.apply(table(spark, range(20)))
    reader = index.SearchIndex(spark, str(tmp_path))
    made.apply(table(spark, range(20, 40)), table(spark, [0]))
    same(reader, table(spark, range(20)))
    same(index.SearchIndex(spark, str(tmp_path), version=1), table(spark, range(20)))
    with pytest.raises(Conflict):
        reader.apply(table(spark, [99]))
    same(index.SearchIndex(spark, str(tmp_path)), table(spark, range(1, 40)))


def test_a_failed_change_leaves_the_old_version(spark, tmp_path, monkeypatch):
    made = index.SearchIndex(spark, str(tmp_path))
    made.apply(table(spark, range(20)))
    monkeypatch.setattr(made, "_bury", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        made.apply(table(spark, [1], shift=5))
    again = index.SearchIndex(spark, str(tmp_path))
    same(again, table(spark, range(20)))
    assert len(again.versions.vacuum()) == 2  # the postings and rows of the broken change
    same(again, table(spark, range(20)))


@pytest.mark.parametrize("given", [{}, {"project": "p1"}, {"where": "kind = 'odd'"}, {"project": "p2", "where": "array_contains(tags, 'redux')"}])
def test_filters(spark, tmp_path, given):
    rows, filters = table(spark, range(90)), {k: F.expr(v) if k == "where" else v for k, v in given.items()}
    made = index.SearchIndex(spark, str(tmp_path)).refresh(rows)
    for limit in (None, 7):
        a, b = (search.keyword_search(rows, TEXT, limit, index=i, **filters) for i in (made, None))
        assert a.columns == b.columns and scores(a) == scores(b)
    assert search.keyword_search(rows, "the of", 5, index=made).count() == 0


def test_folders_are_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FOLDER_ROWS", 10)
    monkeypatch.setattr(index, "FILE_ROWS", 7)
    rows = table(spark, range(100))
    made = index.SearchIndex(spark, str(tmp_path)).refresh(rows)
    assert made.state["segments"][0]["folders"] == 16
    same(made, rows)
    plan = made.matches(["websocket"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan


def test_nothing_to_index(spark, tmp_path):
    made = index.SearchIndex(spark, str(tmp_path))
    made.apply(table(spark, range(3)).limit(0))
    assert made.size == 0 and search.indexed_scores(made, TEXT).count() == 0
    made.apply(deletes=table(spark, [1]))
    same(made.refresh(table(spark, [4])), table(spark, [4]))


@pytest.mark.parametrize("stemmed", [False, True])
def test_long_batches_are_counted_by_runs(monkeypatch, stemmed):
    """What is held at once doesn't grow with the batch; a row that is longer than a run is one by itself."""
    words = [["a", "b", "a"], [], ["c"] * 9, ["b", "a"], ["d"], []]
    lists = {f: pa.array(words[i:] + words[:i], pa.list_(pa.string())) for i, f in enumerate(index.FIELDS)}
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(6)], "project": ["p"] * 6, **lists}).slice(1)
    monkeypatch.setattr(index, "MOST_TOKENS", 1 << 18)
    whole = pa.Table.from_batches(index._count([batch], stemmed)).to_pylist()
    monkeypatch.setattr(index, "MOST_TOKENS", 5)
    runs = list(index._count([batch], stemmed))
    assert len(runs) > 1 and all(len(set(r.column("id").to_pylist())) == 1 or sum(dict(zip(r.column("id").to_pylist(), r.column("length").to_pylist(), strict=True)).values()) <= 5 for r in runs)
    key = lambda r: (r["id"], r["term"])
    assert sorted(pa.Table.from_batches(runs).to_pylist(), key=key) == sorted(whole, key=key)


def test_files_are_in_proportion_to_rows():
    """a segment's folders and the files of each folder both grew with its rows."""
    for n in (10**5, 10**6, 10**7, 10**8):
        folders, files = index._layout(n)
        assert folders * files <= 3 * n / index.FOLDER_ROWS
