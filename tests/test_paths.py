"""Paths against a plain breadth-first search."""

import random
from collections import defaultdict, deque

import pytest

from lorekeep.operators import graph, paths


def distances(edges, start):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    found, queue = {n: 0 for n in start}, deque(start)
    while queue:
        for b in after[node := queue.popleft()]:
            if b not in found:
                found[b] = found[node] + 1
                queue.append(b)
    return found


def canonical(edges, start, goal, most):
    """The path that begins at the smallest node and goes on to the smallest that is one step nearer."""
    near = distances([(b, a) for a, b in edges], goal)
    length = min((near[n] for n in start if n in near), default=None)
    if length is None or length > most:
        return []
    path = [min(n for n in start if near.get(n) == length)]
    while near[path[-1]]:
        path.append(min(b for a, b in edges if a == path[-1] and near.get(b) == near[path[-1]] - 1))
    return path


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.fixture(scope="module")
def maze(spark):
    draw = random.Random(4)
    edges = {(f"n{draw.randrange(120)}", f"n{draw.randrange(120)}") for _ in range(190)} | {(f"t{i}", f"t{i + 1}") for i in range(9)} | {("n3", "t0"), ("n3", "n3")}
    return sorted(edges), table(spark, sorted(edges)).cache()


def walk(df):
    return [r["node"] for r in df.orderBy("step").collect()]


@pytest.mark.parametrize(("start", "goal"), [(["n1"], ["n77"]), (["n3"], ["t9"]), (["n1", "n2", "n5"], ["n40", "n41", "n42"]), (["n9"], ["n9", "n4"]), (["t9"], ["n1"])])
def test_both_sides(spark, maze, start, goal):
    edges, df = maze
    expected = canonical(edges, start, goal, 20)
    assert walk(paths.shortest_path(df, nodes(spark, start), nodes(spark, goal))) == expected
    if len(expected) > 2:
        assert walk(paths.shortest_path(df, nodes(spark, start), nodes(spark, goal), most=len(expected) - 2)) == []
        assert walk(paths.shortest_path(df, nodes(spark, start), nodes(spark, goal), most=len(expected) - 1)) == expected


def test_distances(spark, maze):
    edges, df = maze
    found = {r["node"]: (r["distance"], r["previous"]) for r in paths.shortest_paths(df, nodes(spark, ["n3", "n8"]), 6).collect()}
    expected = {n: d for n, d in distances(edges, ["n3", "n8"]).items() if d <= 6}
    assert {n: d for n, (d, _) in found.items()} == expected
    for n, (d, previous) in found.items():
        assert previous == (min(a for a, b in edges if b == n and expected.get(a) == d - 1) if d else None)


def test_a_large_frontier_is_joined_by_a_shuffle(spark, maze, monkeypatch):
    monkeypatch.setattr(paths, "BROADCAST_ROWS", 0)
    edges, df = maze
    assert walk(paths.shortest_path(df, nodes(spark, ["n1"]), nodes(spark, ["n77"]))) == canonical(edges, ["n1"], ["n77"], 20)


def test_nodes_of_names(spark):
    """Ends that didn't resolve are nodes by name, and may lie on a path."""
    edges = spark.createDataFrame([("1", "load", "2", "parse"), ("2", "parse", None, "split"), ("", "split", "3", "save"), ("3", "save", "3", "save")], "src_id string, src_name string, dst_id string, dst_name string")
    known = spark.createDataFrame([("1", "load"), ("2", "parse"), ("3", "save")], "id string, name string")
    found = paths.shortest_path(paths.graph_nodes(edges), paths.endpoints(known, "load"), paths.endpoints(known, "save"))
    assert walk(found) == ["1", "2", "name:split", "3"]
    assert [r["label"] for r in graph.labelled(found, known).orderBy("step").collect()] == ["load", "parse", "name:split", "save"]


def test_no_path(spark, maze):
    _, df = maze
    assert paths.shortest_path(df, nodes(spark, ["none"]), nodes(spark, ["n1"])).count() == 0
    assert paths.shortest_path(df.limit(0), nodes(spark, ["a"]), nodes(spark, ["b"])).count() == 0
    assert walk(paths.shortest_path(df.limit(0), nodes(spark, ["a"]), nodes(spark, ["a"]))) == ["a"]
