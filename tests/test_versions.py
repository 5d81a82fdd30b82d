"""Several tables under one manifest."""

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import versions
from lorekeep.sources.versions import Conflict, Tables, Versions

SYMBOLS, EDGES = "project string, file string, name string", "project string, file string, dst string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def scanned(spark, files, tag):
    return {
        "symbols": (spark.createDataFrame([("p", f, f"{f}-{tag}") for f in files], SYMBOLS), None, ["project", "file"]),
        "edges": (spark.createDataFrame([("p", f, f"{tag}{i}") for f in files for i in (1, 2)], EDGES), None, ["project", "file"]),
    }


def test_a_change_of_several_tables(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    first = store.change(scanned(spark, ["a", "b", None], "v1"))
    second = store.change(scanned(spark, ["b", "c"], "v2"))
    assert rows(store.read("symbols")) == [("p", "a", "a-v1"), ("p", "b", "b-v2"), ("p", "c", "c-v2"), ("p", None, "None-v1")]
    assert rows(store.read("edges").filter("file = 'b'")) == [("p", "b", "v21"), ("p", "b", "v22")]
    assert rows(store.read("symbols", first)) == [("p", "a", "a-v1"), ("p", "b", "b-v1"), ("p", None, "None-v1")]
    store.change({"symbols": (None, spark.createDataFrame([("p", "a")], "project string, file string"), [])})
    assert store.read("symbols").filter("file = 'a'").count() == 0 and store.read("edges").filter("file = 'a'").count() == 2
    before = [rows(store.read(t)) for t in ("symbols", "edges")]
    store.merge(everything=True)
    assert [rows(store.read(t)) for t in ("symbols", "edges")] == before
    assert rows(store.read("symbols", second)) == [("p", "a", "a-v1"), ("p", "b", "b-v2"), ("p", "c", "c-v2"), ("p", None, "None-v1")]


def test_a_key_that_comes_back(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    store.change(scanned(spark, ["a"], "v1"))
    store.change({"symbols": (None, spark.createDataFrame([("p", "a")], "project string, file string"), [])})
    store.change(scanned(spark, ["a"], "v2"))
    assert rows(store.read("symbols")) == [("p", "a", "a-v2")]


def test_many_removed_keys_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "BROADCAST_KEYS", 0)
    test_a_change_of_several_tables(spark, tmp_path)


@pytest.mark.parametrize("written", range(5))
def test_a_job_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, written):
    """Between any two of its writes, and before the commit."""
    store = Tables(spark, str(tmp_path))
    store.change(scanned(spark, ["a", "b"], "v1"))
    before, write, count = [rows(store.read(t)) for t in ("symbols", "edges")], store._write, iter(range(9))

    def dying(df, name):
        if next(count) == written:
            raise RuntimeError("killed")
        return write(df, name)

    monkeypatch.setattr(store, "_write", dying)
    monkeypatch.setattr(store.versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.change(scanned(spark, ["b", "c"], "v2"))
    again = Tables(spark, str(tmp_path))
    assert [rows(again.read(t)) for t in ("symbols", "edges")] == before
    assert len(again.versions.vacuum()) == min(written, 4)
    assert [rows(again.read(t)) for t in ("symbols", "edges")] == before


def test_two_writers(spark, tmp_path):
    a, b = Tables(spark, str(tmp_path)), Tables(spark, str(tmp_path))
    a.change(scanned(spark, ["a"], "v1"))
    pinned = b.versions.latest()
    a.change(scanned(spark, ["b"], "v2"), pinned)
    with pytest.raises(Conflict):
        b.change(scanned(spark, ["c"], "v3"), pinned)
    assert b.read("symbols").count() == 2


def test_a_manifest_is_whole_or_absent(spark, tmp_path):
    made = Versions(spark, f"file://{tmp_path}")
    assert (made.latest(), made.state()) == (0, {})
    assert made.commit({"n": 1}, 0) == 1 and made.state() == {"n": 1}
    with pytest.raises(Conflict):
        made.commit({"n": 2}, 0)
    assert made.state() == {"n": 1}
    (tmp_path / "versions" / ".draft-x").write_text("{")  # of a writer that died
    assert made.latest() == 1


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    for tag in ("v1", "v2", "v3"):
        store.change(scanned(spark, ["a"], tag))
    store.merge(everything=True)
    assert store.versions.vacuum(keep=2) == []  # the version before the last names all segments
    assert len(store.versions.vacuum()) > 0
    assert rows(store.read("symbols")) == [("p", "a", "a-v3")]
    with pytest.raises(Exception, match="versions"):
        store.read("symbols", 1)


def test_merging_keeps_the_list_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FAN", 3)
    store, expected = Tables(spark, str(tmp_path)), {}
    for i in range(14):
        keys = [str(i), str(i // 2), str(i * 5 % 7)]
        gone = [str(i * 3 % 5)] if i > 2 else []
        expected = {k: v for k, v in expected.items() if k not in gone} | {k: f"v{i}" for k in keys}
        new = spark.createDataFrame([(k, f"v{i}") for k in set(keys)], "id string, v string")
        store.change({"t": (new, spark.createDataFrame([(k,) for k in set(gone) - set(keys)], "id string"), ["id"])}, marks={"n": i})
        store.merge()
        assert dict(rows(store.read("t"))) == expected and store.mark("n") == i
    assert len(store.versions.state()["tables"]["t"]["segments"]) <= 6 and store.names() == ["t"]


def test_unknown_tables(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.read("symbols")
    with pytest.raises(KeyError):
        store.change({"symbols": (None, spark.range(1).select(F.lit("x").alias("k")), ["k"])})
