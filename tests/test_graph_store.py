"""The stored graph under change against a rebuild, and commits of several tables."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph
from lorekeep.operators.graph_store import CodeGraph, wipe
from lorekeep.sources.versions import Tables

FILES = "file string, source string"

BASE = {
    "a.py": "def load(path):\n    parse(path)\n    helper(1)\nclass Reader:\n    def read(self):\n        load(self)\n",
    "b.py": "def parse(text):\n    split(text)\ndef split(text):\n    shared(text)\n",
    "c.py": "def shared(x):\n    load(x)\n    unknown(x)\n",
    "d.py": "def main(args):\n    parse(args)\n    shared(args)\n    reader.read(args)\n    split(args)\n",
}
SECOND = BASE | {"b.py": "def parse(text):\n    cut(text)\ndef cut(text):\n    shared(text)\n", "e.py": "def shared(y):\n    pass\ndef helper(n):\n    main(n)\n"}
THIRD = {k: v for k, v in SECOND.items() if k != "c.py"} | {"a.py": BASE["a.py"].replace("helper", "cut")}


def files(spark, sources):
    return spark.createDataFrame(sorted(sources.items()), FILES).withColumn("hash", F.sha2("source", 256))


def tables(graph):
    return {name: sorted(map(tuple, graph.read(name).collect()), key=str) for name in ("files", "symbols", "edges")}


def test_refresh_equals_a_rebuild(spark, tmp_path):
    store = Tables(spark, f"{tmp_path}/kept")
    kept = CodeGraph(spark, store, "p")
    other = CodeGraph(spark, store, "q")
    other.refresh(files(spark, BASE))
    untouched, counts = tables(other), []
    for i, sources in enumerate((BASE, SECOND, THIRD)):
        counts.append(kept.refresh(files(spark, sources)))
        fresh = CodeGraph(spark, Tables(spark, f"{tmp_path}/fresh{i}"), "p")
        fresh.refresh(files(spark, sources))
        assert tables(kept) == tables(fresh)
        assert len(tables(fresh)["edges"]) > 5
    assert tables(other) == untouched
    assert counts[0]["read"] == 4 and counts[1]["read"] == 2 and counts[1]["dropped"] == 0
    assert counts[2]["read"] == 1 and counts[2]["dropped"] == 1
    assert counts[1]["resolved"] < counts[0]["resolved"]


def test_nothing_changed(spark, tmp_path):
    graph = CodeGraph(spark, Tables(spark, str(tmp_path)), "p")
    graph.refresh(files(spark, BASE))
    version = graph.store.versions.latest()
    assert graph.refresh(files(spark, BASE)) == {"read": 0, "dropped": 0, "resolved": 0} and graph.store.versions.latest() == version


def test_only_touched_references_are_resolved(spark, tmp_path):
    """A hundred files of which one changes: its own calls, and those of the name it takes away."""
    many = {f"f{i:03}.py": f"def name{i}(x):\n    name{(i + 1) % 100}(x)\n    name{(i + 2) % 100}(x)\n" for i in range(100)}
    graph = CodeGraph(spark, Tables(spark, str(tmp_path)), "p")
    assert graph.refresh(files(spark, many))["resolved"] == 200
    assert graph.refresh(files(spark, many | {"f050.py": "def renamed(x):\n    name51(x)\n"})) == {"read": 1, "dropped": 0, "resolved": 3}
    fresh = CodeGraph(spark, Tables(spark, f"{tmp_path}-fresh"), "p")
    fresh.refresh(files(spark, many | {"f050.py": "def renamed(x):\n    name51(x)\n"}))
    assert tables(graph) == tables(fresh)


def test_a_refresh_that_dies(spark, tmp_path, monkeypatch):
    store = Tables(spark, str(tmp_path))
    graph = CodeGraph(spark, store, "p")
    graph.refresh(files(spark, BASE))
    before = tables(graph)
    monkeypatch.setattr(store.versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        graph.refresh(files(spark, SECOND))
    assert tables(CodeGraph(spark, Tables(spark, str(tmp_path)), "p")) == before


def test_removal_and_wipe(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    p, q = (CodeGraph(spark, store, x) for x in "pq")
    p.refresh(files(spark, BASE))
    q.refresh(files(spark, BASE))
    assert p.remove(spark.createDataFrame([("b.py",)], "file string")) == 2
    assert p.read("edges").filter("file = 'b.py'").count() == 0 and p.read("symbols").count() == 5
    assert q.read("symbols").count() == 7
    store.change({"cursors": (spark.createDataFrame([("s", 1)], "id string, at long"), None, ["id"])})
    wipe(store, "q")
    assert q.read("symbols").count() == q.read("files").count() == 0 and p.read("symbols").count() == 5 and store.read("cursors").count() == 1
    wipe(store)
    assert all(store.read(name).count() == 0 for name in store.names())


def test_removed_files_are_joined_once(spark):
    """Many rows may name one file; each row of the graph that isn't removed would meet them all."""
    rows = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "q", "a"), (4, "p", None), (5, None, "a")], "id int, project string, file string")
    left = graph.without_files(rows, "p", spark.createDataFrame([("a",)] * 50 + [(None,)], "file string"))
    assert sorted(r["id"] for r in left.collect()) == [2, 3, 4, 5]
    assert "Aggregate" in left._jdf.queryExecution().executedPlan().toString()
