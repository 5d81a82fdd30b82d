import math

import numpy as np
import pytest

from lorekeep.llm import topk
from lorekeep.llm.queries import op7_norm_sorted_topk

from .conftest import rows_of


def brute(vectors, k=20, divisor=20):
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i % divisor == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(fine) if a != b)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, vectors, **options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumnsRenamed({}).selectExpr("*", "1 AS norm", "'x' AS vector", "2 AS row").repartition(3)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(topk.top_inner_products(df, **options)))


def made(seed, n, dims):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in draw.normal(0, draw.uniform(0.1, 3), dims)]) for i in range(n)]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("STRIPE_ROWS", 40), ("GROUP_ROWS", 4), ("BLOCK_ROWS", 8)):
            monkeypatch.setattr(topk, name, value)
    vectors = made(1, 300, 12) + [(1000 + i, [1.0] * 12) for i in range(60)]  # many equal vectors
    assert run(spark, vectors) == brute(vectors)


def test_odd_vectors(spark):
    vectors = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (80, None), (100, []), (1, [0.5]), (2, [-1.0, 4.0, 9.0]), (0, [1.0, 2.0]), (0, [3.0, 3.0])]
    assert run(spark, vectors) == brute(vectors)


def test_small(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], k=5) == [(0, 1, 1, 64 * 128)]


def test_table(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(op7_norm_sorted_topk(spark, sf))) == brute(vectors)
