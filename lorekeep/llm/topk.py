"""Exact top-k inner products over vectors sorted by norm.

Vectors are ordered by descending length and cut into stripes. The longest stripe is searched
first; its k-th best score is each query's threshold. A pair of (stripe, group of queries) is then
formed only if the longest query times the longest vector can reach the smallest threshold. Inside a
pair, vectors are taken in blocks by descending length. In coordinates rotated by an SVD, the inner
product over the leading dimensions plus the product of the residual lengths (Cauchy-Schwarz)
bounds the score; only what passes is scored in full, in integers, and only scores that reach the
query's threshold leave the pair. Queries are grouped by length too, so that short ones skip stripes.

The pairs form a grid of blocks: each holds at most STRIPE_ROWS vectors and GROUP_ROWS queries, so
memory doesn't depend on the table. A vector repeated by a third of all rows is spread over stripes,
as vec_id breaks ties of length.

Defined results: vectors that are null, or hold null, NaN or infinite components, take no part; an
empty vector has score 0 with any other. Vectors of different lengths meet over their common
leading components. Rows that share a vec_id are different vectors: a query excludes its own row
only. A query without candidates gives no rows. Scores are exact while they are below 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import stored

STRIPE_ROWS, GROUP_ROWS, BLOCK_ROWS = 8192, 1024, 1024
#: Rows from which the rotation is fitted. Any rotation gives exact results; a good one prunes more.
SAMPLE_ROWS, LEADING = 4096, 16

_FOUND = "query_row long, query_id long, vec_id long, score long"


def _packed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = pa.compute.list_value_length(lists).to_numpy()
            full = np.zeros((batch.num_rows, dims))
            full[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "stripe", "norm")), pa.array([v.tobytes() for v in full], pa.binary())], names=["row", "vec_id", "stripe", "norm", "vector"])

    return run


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), dims)


def _search(dims: int, k: int, rotation: np.ndarray):
    """A function from one group of queries and one stripe to each query's best k in that stripe."""
    lead = min(LEADING, dims)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x @ rotation
        return turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in _FOUND.split(", ")})
        if not len(queries) or not len(vectors):
            return empty
        vectors = vectors.sort_values(["norm", "vec_id"], ascending=[False, True])
        q, norms = _matrix(queries["vector"], dims), queries["norm"].to_numpy()
        q_lead, q_rest = split(q)
        floor = queries["threshold"].to_numpy().astype(float)
        rows, ids = vectors["row"].to_numpy(), vectors["vec_id"].to_numpy()
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for start in range(0, len(vectors), BLOCK_ROWS):
            part = vectors.iloc[start : start + BLOCK_ROWS]
            longest = part["norm"].iloc[0]
            alive = np.flatnonzero(norms * longest * (1 + 1e-9) + 1e-6 >= floor)
            if not len(alive):
                break  # all that follow are shorter
            x = _matrix(part["vector"], dims)
            x_lead, x_rest = split(x)
            slack = 1e-6 + 1e-9 * norms[alive] * longest
            bound = q_lead[alive] @ x_lead.T + q_rest[alive][:, None] * x_rest[None, :] + slack[:, None]
            for i, passed in zip(alive, bound >= floor[alive][:, None], strict=True):
                at = np.flatnonzero(passed)
                at = at[rows[start + at] != queries["row"].iat[i]]
                scores = x[at] @ q[i]
                reached = scores >= floor[i]
                if reached.any():
                    scores = np.concatenate([best[i][0], scores[reached]])
                    found = np.concatenate([best[i][1], ids[start + at[reached]]])
                    top = np.lexsort((found, -scores))[:k]
                    best[i] = scores[top], found[top]
                    if len(top) == k:
                        floor[i] = max(floor[i], scores[top[-1]])
        counts = [len(b[0]) for b in best]
        if not sum(counts):
            return empty
        return pd.DataFrame({"query_row": np.repeat(queries["row"].to_numpy(), counts), "query_id": np.repeat(queries["vec_id"].to_numpy(), counts), "vec_id": np.concatenate([b[1] for b in best]), "score": np.rint(np.concatenate([b[0] for b in best])).astype(np.int64)})

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(64 * x) of each component x, without vectors that take no part."""
    v = F.col("vector")
    scaled = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return scaled.filter(fine).withColumn("vector", F.transform(v, lambda x: F.floor(x * 64).cast("double")))


def top_inner_products(vectors: DataFrame, k: int = 20, query_divisor: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id ``query_divisor`` divides."""
    rows = integer_vectors(vectors)
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = max(1, dims or 1)
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    seen = np.zeros((len(sample) + 1, dims))
    for i, v in enumerate(sample):
        seen[i, : len(v)] = v
    rotation = np.linalg.svd(seen, full_matrices=True)[2].T

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    ordered = rows.withColumn("norm", norm).repartitionByRange(max(1, math.ceil(n / STRIPE_ROWS)), F.desc("norm"), "vec_id", F.xxhash64("vector"))
    ordered = ordered.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.spark_partition_id().alias("stripe"), "norm", "vector")
    base = stored(ordered.mapInArrow(_packed(dims), "row long, vec_id long, stripe int, norm double, vector binary"), "vectors")

    queries = base.filter(F.col("vec_id") % query_divisor == 0)
    n_groups = max(1, math.ceil(queries.count() / GROUP_ROWS))
    queries = stored(queries.repartitionByRange(n_groups, F.desc("norm"), "row").select("row", "vec_id", "norm", "vector", F.spark_partition_id().alias("group")), "asking")
    search = _search(dims, k, rotation)

    def over(asked: DataFrame, cells: DataFrame) -> DataFrame:
        """Searches the (group, stripe) cells given."""
        left = asked.join(cells, "group").select("row", "vec_id", "norm", "vector", "threshold", "group", "stripe")
        right = base.join(cells, "stripe").select(*(F.col(c).alias(f"x_{c}") for c in ("row", "vec_id", "norm", "vector", "group", "stripe")))
        return left.groupBy("group", "stripe").cogroup(right.groupBy("x_group", "x_stripe")).applyInPandas(lambda a, b: search(a, b.rename(columns=lambda c: c[2:])), _FOUND)

    stripes = stored(base.groupBy("stripe").agg(F.max("norm").alias("longest")), "stripes")
    head = stripes.agg(F.min("stripe")).first()[0] or 0
    groups = queries.groupBy("group").agg(F.max("norm").alias("reach"))
    first = stored(over(queries.withColumn("threshold", F.lit(-math.inf)), groups.select("group", F.lit(head).alias("stripe"))), "head")
    floors = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    asked = queries.join(floors, queries["row"] == floors["query_row"], "left").withColumn("threshold", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(-math.inf))).select("row", "vec_id", "norm", "vector", "group", "threshold")
    asked = stored(asked, "queries")
    needs = asked.groupBy("group").agg(F.max("norm").alias("reach"), F.min("threshold").alias("need"))
    cells = needs.join(stripes.filter(F.col("stripe") != head), F.col("reach") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("group", "stripe")
    found = first.unionByName(over(asked, stored(cells, "cells")))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
