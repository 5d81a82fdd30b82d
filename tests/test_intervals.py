"""Running values and interval joins against plain loops, with a file that holds most rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.operators import graph, intervals, store
from lorekeep.operators.running import running


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def hot_rows(n=3000):
    draw = random.Random(5)
    return [(i, "hot" if draw.random() < 0.6 else draw.choice(["a", "b", None]), draw.randrange(50), draw.choice([None, draw.randrange(9)])) for i in range(n)]


@pytest.mark.parametrize("most_rows", [1, 200, 10_000])
def test_running(spark, most_rows):
    made = hot_rows()
    df = spark.createDataFrame(made, "id long, key string, at int, value int").repartition(5)
    found = running(df, ["key"], ["at", "id"], {"total": F.col("value"), "place": F.lit(1)}, {"last": F.col("value")}, most_rows)
    expected, state = [], {}
    for i, key, at, value in sorted(made, key=lambda r: (str(r[1]), r[2], r[0])):
        total, place, last = state.get(key, (0, 0, None))
        state[key] = total, place, last = total + (value or 0), place + 1, last if value is None else value
        expected.append((i, key, at, value, total, place, last))
    assert rows(found) == sorted(expected, key=str)


def test_running_without_rows(spark):
    df = spark.createDataFrame([], "id long, key string, at int, value int")
    assert running(df, ["key"], ["at"], {"total": F.col("value")}).count() == 0


@settings(deadline=None, max_examples=25)
@given(st.lists(st.tuples(st.integers(-300, 5000), st.integers(-3, 3000)), min_size=1, max_size=30))
def test_cover_is_the_interval_once(spark, pairs):
    df = spark.createDataFrame([(a, a + w) for a, w in pairs], "a long, b long")
    for a, b, cells in df.select("a", "b", intervals.cover(F.col("a"), F.col("b"))).collect():
        lines = [x for c in cells for x in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"])]
        assert sorted(lines) == list(range(a, b + 1))
        assert len(cells) <= 2 * max(1, (b - a + 1).bit_length())


def test_enclosing_in_a_hot_file(spark):
    draw = random.Random(1)
    file = lambda: "hot" if draw.random() < 0.7 else f"f{draw.randrange(5)}"
    spans = [(file(), a := draw.randrange(20_000), a + draw.choice([-1, 0, 3, 50, 900, 15_000]), i, draw.random() < 0.5) for i in range(800)]
    points = [(i, file(), draw.randrange(30_000)) for i in range(1500)] + [(9001, None, 5), (9002, "none", 5)]
    found = graph.enclosing(spark.createDataFrame(points, "ref_id long, file string, line int"), spark.createDataFrame(spans, "file string, start long, end long, span_id long, callable boolean"))
    expected = []
    for ref, name, line in points:
        around = [(not c, b - a, i) for f, a, b, i, c in spans if f == name and a <= line <= b]
        if around:
            expected.append((ref, min(around)[2]))
    assert rows(found) == sorted(expected, key=str)


def test_join_output_is_linear_in_points(spark):
    """All spans of one file overlap: a pair join would make points x spans rows."""
    spans = spark.range(2000).select(F.lit("hot").alias("file"), F.lit(0).alias("start"), (F.col("id") + 5000).alias("end"), F.col("id").alias("span_id"), F.lit(True).alias("callable"))
    points = spark.range(2000).select(F.col("id").alias("ref_id"), F.lit("hot").alias("file"), F.col("id").alias("line"))
    found = graph.enclosing(points, spans)
    assert found.agg(F.count("*"), F.min("span_id"), F.max("span_id")).head()[:] == (2000, 0, 0)
    cells = spans.select(F.explode(intervals.cover(F.col("start"), F.col("end"))).alias("c")).select("c.*").distinct()
    assert cells.count() < 4100 and cells.select("level").distinct().count() <= 13


def nested(draw, file, low, high, depth, out):
    while low < high and depth < 9:
        a = draw.randrange(low, high)
        b = draw.randrange(a, high)
        out.append((file, a, b, len(out)))
        if draw.random() < 0.2:
            out.append((file, a, b, len(out)))  # of one extent
        nested(draw, file, a, b + 1, depth + 3, out)
        low = b + 1


@pytest.mark.parametrize("most_rows", [10, 10_000])
def test_holders_in_a_hot_file(spark, most_rows):
    draw, spans = random.Random(3), []
    for i in range(40):
        nested(draw, "hot", 100 * i, 100 * i + 100, 0, spans)
    for i in range(20):
        nested(draw, f"f{i}", 0, 60, 0, spans)
    assert sum(s[0] == "hot" for s in spans) > len(spans) / 3 and len(spans) > 100
    found = graph.contained(spark.createDataFrame(spans, "file string, start long, end long, span_id long"), most_rows)
    expected = []
    for f, a, b, i in spans:
        over = [(d - c, -j) for g, c, d, j in spans if g == f and j != i and c <= a and d >= b and (d - c > b - a or j < i)]
        if over:
            expected.append((i, -min(over)[1]))
    assert rows(found) == sorted(expected, key=str)


@pytest.mark.parametrize("most_rows", [20, 10_000])
def test_hot_files_and_projects(spark, most_rows):
    """The same rows, whether a large file's or project's rows go to one task or to many."""
    made = hot_rows(800)
    references = spark.createDataFrame([(i, key, at) for i, key, at, _ in made], "ref_id long, file string, line int")
    spans = spark.createDataFrame([(key, at, i, f"n{i}") for i, key, at, _ in made if i % 9 == 0], "file string, line int, id long, name string")
    found = graph.nearest_above(references, spans, most_rows)
    expected = []
    for i, key, at, _ in made:
        above = [(l, j) for j, k, l, _ in made if j % 9 == 0 and k == key and l <= at]
        expected.append((i, key, at, *((max(above)[1], f"n{max(above)[1]}") if above else (None, None))))
    assert rows(found) == sorted(expected, key=str)
    seen = spark.createDataFrame([(str(i), key, at, i % 50 == 0) for i, key, at, _ in made], "id string, project string, created_at int, anchor boolean")
    lines = {}
    for i, key, at, _ in sorted(made, key=lambda r: (r[2], str(r[0]))):
        lines.setdefault(key, []).append(str(i))
    near = [(a, ids[p + o], o) for key, ids in lines.items() if key is not None for p, a in enumerate(ids) if int(a) % 50 == 0 for o in (-1, 0, 1) if 0 <= p + o < len(ids)]
    assert rows(store.timeline_all(seen, F.col("anchor"), 1, 1, most_rows).select("anchor_id", "id", "offset")) == sorted(near, key=str)


def test_cells_are_not_broadcast_by_the_size_of_their_intervals(spark):
    """A small table of wide intervals has many cells; Spark doesn't count what explode adds."""
    spans = spark.range(50).select(F.lit("f").alias("file"), F.col("id").alias("start"), (F.col("id") + 400).alias("end"), F.col("id").alias("span_id"))
    points = spark.range(50).select(F.col("id").alias("ref_id"), F.lit("f").alias("file"), F.col("id").alias("line"))
    found = intervals.best_around(points, spans, "ref_id", "span_id", ["span_id"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["ref_id"], r["span_id"]) for r in found.collect()} == {(i, 0) for i in range(50)}
