"""The inverted file against a search of all vectors."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import cells, search
from lorekeep.operators.cells import VectorIndex

SCHEMA = "id string, kind string, embedding array<float>"


def table(spark, n=600, width=8, seed=2):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(f"v{i:04}", f"k{i % 3}", [m + draw.gauss(0, 0.3) for m in middles[i % 9]]) for i in range(n)]
    rows += [(f"same{i:03}", "k", rows[0][2]) for i in range(n // 3)]  # a third of all rows is one vector
    return spark.createDataFrame([*rows, ("none", "k", None), ("empty", "k", [])], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = table(spark).cache()
    return rows, VectorIndex(spark, str(tmp_path_factory.mktemp("cells"))).build(rows, cells=16)


def best(df):
    return [(r["id"], round(r["score"], 5)) for r in df.collect()]


def queries(rows, n=12):
    return [list(r["embedding"]) for r in rows.filter("size(embedding) > 0").orderBy(F.xxhash64("id")).limit(n).collect()] + [[0.0] * 8, [5.0] + [0.0] * 7]


def test_without_a_limit_of_cells_it_is_exact(built):
    rows, index = built
    rows = rows.filter("size(embedding) > 0")
    for query in queries(rows):
        assert best(index.search(query, 20, exact=True)) == best(search.vector_search(rows, query, 20))
        assert best(index.search(query, 5, exact=True, floor=3.0)) == best(search.vector_search(rows, query, 5, floor=3.0))


def test_few_cells_find_most(built):
    rows, index = built
    found = [len({i for i, _ in best(index.search(q, 20))} & {i for i, _ in best(search.vector_search(rows, q, 20))}) for q in queries(rows)[:12]]
    assert sum(found) >= 0.9 * 20 * len(found)


def test_only_the_cells_asked_for_are_read(spark, built):
    _, index = built
    found = index._of([3, 5])
    assert {f.split("cell=")[1].split("/")[0] for f in found.inputFiles()} <= {str(i) for i in range(16)}
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell") or "PartitionFilters: [isnotnull(cell" in plan


def test_columns_pass_through(built):
    rows, index = built
    found = index.search(queries(rows)[0], 3)
    assert found.columns == ["id", "kind", "embedding", "score"] and found.head()["kind"] is not None


def test_many_queries_at_once(built):
    rows, index = built
    asked = rows.filter("id like '%7'").select(F.col("id").alias("query_id"), "embedding")
    found = index.neighbours(asked, 5, probes=16)
    expected = {}
    for r in asked.collect():
        expected[r["query_id"]] = best(search.vector_search(rows.filter("size(embedding) > 0"), list(r["embedding"]), 5))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 5)))
    assert got == expected


def test_recall_over_all_given_vectors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    index = VectorIndex(spark, str(tmp_path)).build(rows)
    asked = rows.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    near, exact = (index.neighbours(asked, 20, probes).select("query_id", "id") for probes in (None, 1000))
    share = near.join(exact, ["query_id", "id"], "left_semi").count() / exact.count()
    assert exact.count() == 20 * asked.count() and share >= 0.9
    assert index.state["probes"] < len(index.bounds([1.0] * 64))


def test_odd_tables(spark, tmp_path):
    empty = VectorIndex(spark, f"{tmp_path}/a").build(table(spark).filter("embedding is null"))
    assert empty.search([1.0] * 8, 3).count() == 0
    one = VectorIndex(spark, f"{tmp_path}/b").build(table(spark).filter("id = 'v0001'"))
    assert one.search([1.0] * 8, 3, exact=True).count() == 1
    with pytest.raises(ValueError, match="components"):
        one.search([1.0], 3)
    with pytest.raises(ValueError, match="components"):
        VectorIndex(spark, f"{tmp_path}/c").build(table(spark).unionByName(spark.createDataFrame([("x", "k", [1.0])], SCHEMA)))
    same = VectorIndex(spark, f"{tmp_path}/d").build(table(spark).filter("id like 'same%'"), cells=4)
    assert same.search([1.0] * 8, 500, exact=True).count() == 200


def test_neighbours_of_copies_by_block(spark, tmp_path, monkeypatch):
    """Equal vectors have equal scores in whatever block they lie, so that the smaller id wins; no side is broadcast by its estimate."""
    monkeypatch.setattr(cells, "VECTORS", 7)
    monkeypatch.setattr(cells, "QUERIES", 3)
    draw = random.Random(3)
    kinds = [[struct.unpack("f", struct.pack("f", draw.gauss(0, 1)))[0] for _ in range(8)] for _ in range(4)]
    rows = spark.createDataFrame([(f"v{i:03d}", "k", kinds[i % 4]) for i in range(120)], SCHEMA)
    index = VectorIndex(spark, str(tmp_path)).build(rows, cells=2)
    found = index.neighbours(rows.select(F.col("id").alias("query_id"), "embedding"), 9, probes=2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for i in range(120):
        expected = search.vector_search(rows, kinds[i % 4], 9).select("id", "score") if i < 4 else got[f"v{i % 4:03d}"]
        assert got[f"v{i:03d}"] == (expected if i >= 4 else [tuple(r) for r in expected.collect()])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_are_not_copied_to_cells(spark, tmp_path, monkeypatch, kind):
    """each query was shuffled to each of its cells, and each block of a cell gave ``limit`` rows a query."""
    monkeypatch.setattr(cells, "VECTORS", 7)
    monkeypatch.setattr(cells, "QUERIES", 5)
    monkeypatch.setattr(cells, "TASK_VECTORS", 100, raising=False)  # several ranges of vectors
    rows = table(spark, 300, seed=5).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).cache()
    index = VectorIndex(spark, str(tmp_path)).build(rows, cells=8)
    rows = rows.filter("size(embedding) > 0")
    found = index.neighbours(rows.select(F.col("id").alias("query_id"), "embedding"), 6, probes=8)
    assert "hashpartitioning(cell" not in found._jdf.queryExecution().executedPlan().toString()
    got, vectors = {}, [(r["id"], list(r["embedding"])) for r in rows.collect()]
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for query_id, asked in vectors:
        scores = []
        for i, v in vectors:
            score = 0.0
            for a, b in zip(asked, v, strict=True):
                score += a * b
            scores.append((i, score))
        assert got[query_id] == sorted(scores, key=lambda s: (-s[1], s[0]))[:6]
