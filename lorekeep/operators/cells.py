"""Nearest vectors by an inverted file: vectors stored by cell, of which a search reads the promising ones.

Cells are those of a distributed k-means over a sample of documented size; every vector is stored in the folder of its nearest
centre. A cell's centre c and radius r bound the inner product of its vectors x with a query q: q.x <= q.c + |q| r. A search reads the
``probes`` cells of greatest q.c. How many that takes is measured when the index is built: enough for a share RECALL of the
nearest vectors of a sample. An exact search reads these first and then all cells whose bound reaches the
k-th best score so far, which gives what a search of all vectors gives.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.vectors import dot
from lorekeep.session import stored
from lorekeep.sources.versions import Versions, ddl

#: Vectors of the sample for each cell, steps of k-means, and cells at most.
SAMPLE, STEPS, MOST_CELLS = 128, 8, 1 << 14
#: The share of a vector's NEAREST that its first cells shall hold, and vectors that this is measured for.
RECALL, NEAREST, MEASURED = 0.95, 20, 128
#: Products of vectors and centres that are held at once.
BLOCK = 1 << 21
#: Queries and vectors that are compared at once; queries of a task, and vectors that it reads.
QUERIES, VECTORS, TASK_QUERIES, TASK_VECTORS = 2048, 1024, 1 << 13, 1 << 19
#: Found rows whose scores are summed at once.
SUMMED = 1 << 15
#: Seeds the choice of the sample and of the first centres.
SEED = 17


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each vector, and the distance."""
    own, rows = (centres**2).sum(1), max(1, BLOCK // len(centres))
    best = np.concatenate([(own - 2 * vectors[i : i + rows] @ centres.T).argmin(1) for i in range(0, max(1, len(vectors)), rows)])
    return best, np.linalg.norm(vectors - centres[best], axis=1)


def _sums(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each cell that a task's vectors fall into: their number and sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), np.zeros_like(centres)
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), centres.shape[1])
            cell, _ = _nearest(vectors, centres)
            n += np.bincount(cell, minlength=len(centres))
            np.add.at(total, cell, vectors)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(list(total[full]), pa.list_(pa.float64()))], ["cell", "n", "total"])

    return run


def _ranks(asked: np.ndarray, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each vector asked for the best scores among a task's vectors, with the place of their cell in its order."""
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), centres.shape[1])
            cell, _ = _nearest(vectors, centres)
            scores = asked @ vectors.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, : NEAREST + 1]
            own = np.repeat(np.arange(len(asked)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(scores[own, best.ravel()]), pa.array(place[own, cell[best.ravel()]])], ["asked", "score", "place"])

    return run


def _probes(sample: DataFrame, centres: np.ndarray) -> int:
    """Cells that hold a share RECALL of the nearest vectors of MEASURED ones, within the sample. In all vectors the nearest lie
    nearer, so that this errs on the side of more cells."""
    asked = _matrix(sample.orderBy("__h", "id").limit(MEASURED).select("embedding").toArrow()["embedding"].combine_chunks(), centres.shape[1])
    found = sample.select("embedding").mapInArrow(_ranks(asked, centres), "asked long, score double, place long")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "place")
    near = found.withColumn("n", F.row_number().over(best)).filter(F.col("n").between(2, NEAREST + 1))  # the first is the vector itself
    share = near.agg(F.percentile("place", F.lit(RECALL)).alias("p")).head()["p"]
    return min(len(centres), math.ceil(share or 0) + 1)


def centres_of(vectors: DataFrame, width: int, cells: int, sample: int = SAMPLE, steps: int = STEPS) -> tuple[np.ndarray, int]:
    """The centres of k-means over at most about ``sample`` vectors a cell, chosen by a hash of their id, and how many cells a search needs."""
    count = vectors.count()
    share = min(1.0, sample * cells / max(1, count))
    chosen = vectors.withColumn("__h", F.xxhash64(F.lit(SEED), "id"))
    if share < 1:
        chosen = chosen.filter(F.pmod("__h", F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = stored(chosen, "sample")
    first = chosen.orderBy("__h", "id").limit(cells).select("embedding").toArrow()
    centres = _matrix(first["embedding"].combine_chunks(), width)
    for _ in range(steps):
        sums = chosen.select("embedding").mapInArrow(_sums(centres), "cell int, n long, total array<double>")
        # Sums of a cell: as many as the bounded sample has partitions.
        add = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), width), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        for row in sums.groupBy("cell").agg(F.sum("n").alias("n"), add.alias("total")).collect():  # a row a cell
            centres[row["cell"]] = np.array(row["total"]) / row["n"]
    return centres, _probes(chosen, centres)


def _packed(batch: pa.RecordBatch) -> bytes:
    """Rows as one value, which Spark passes on without looking at their components."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (query_id, embedding) as blocks of at most QUERIES."""
    for batch in batches:
        n = -(-batch.num_rows // QUERIES)
        for i in range(n):
            start, end = batch.num_rows * i // n, batch.num_rows * (i + 1) // n
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([_packed(batch.slice(start, end - start))], pa.binary())], ["block", "asked"])


def _first_copies(vectors: np.ndarray, limit: int) -> np.ndarray:
    """Places of the first ``limit`` of equal vectors. Equal vectors have equal scores, so that of those in the order of
    their ids no later one can be among the ``limit`` best of any query."""
    rows = np.ascontiguousarray(vectors)
    _, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    return np.sort(order[np.arange(len(order)) - np.searchsorted(same[order], same[order]) < limit])


def _held(width: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stored vectors (id, embedding, cell) as blocks of at most VECTORS of one cell, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1)) if len(cells) else []
            for start, end in zip(starts, [*starts[1:], len(cells)], strict=True):
                rows = batch.slice(start, end - start).select(["id", "embedding"])
                rows = rows.take(pc.sort_indices(rows.column("id")))
                rows = rows.take(pa.array(_first_copies(_matrix(rows.column("embedding"), width), limit)))
                for at in range(0, rows.num_rows, VECTORS):
                    yield pa.RecordBatch.from_arrays([pa.array(cells[start : start + 1]), pa.array([_packed(rows.slice(at, VECTORS))], pa.binary())], ["cell", "held"])

    return run


class _Found:
    """The best rows so far of a block of queries, of the cells that each of them reads."""

    def __init__(self, asked: pa.RecordBatch, centres: np.ndarray, probes: int, limit: int):
        self.ids, self.limit, self.vectors = asked.column("query_id"), limit, _matrix(asked.column("embedding"), centres.shape[1])
        self.single = pa.types.is_float32(asked.column("embedding").type.value_type)
        self.length, self.least = np.linalg.norm(self.vectors, axis=1), np.full(len(self.vectors), -np.inf)
        self.reads = np.zeros((len(centres), len(self.vectors)), bool)
        rows = max(1, BLOCK // len(centres))
        for i in range(0, len(self.vectors), rows):
            first = np.argsort(-(self.vectors[i : i + rows] @ centres.T), axis=1, kind="stable")[:, :probes]
            self.reads[first.ravel(), np.repeat(np.arange(i, i + len(first)), first.shape[1])] = True
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = self.settled = 0

    def meet(self, cell: int, held: pa.RecordBatch) -> None:
        """A matrix product finds all rows of a block that may be among the best, by the least score that was among them so far. Their
        scores are summed in the order of components, so that equal vectors have equal scores wherever they lie."""
        own = np.flatnonzero(self.reads[cell])
        if not len(own) or not held.num_rows:
            return
        v = _matrix(held.column("embedding"), self.vectors.shape[1])
        reach = np.linalg.norm(v, axis=1).max() * self.length[own]
        # Half the digits do where both sides have them and no product leaves their range: ``error`` bounds what the product is off by.
        single = self.single and pa.types.is_float32(held.column("embedding").type.value_type) and reach.max() < 1e30
        kind = np.float32 if single else np.float64
        near = self.vectors[own].astype(kind) @ v.astype(kind).T
        error = (6e-7 if single else 1e-15) * v.shape[1] * reach + (1e-30 if single else 0.0)
        least = self.least[own]
        fresh = np.flatnonzero(np.isneginf(least))
        if len(fresh) and len(v) >= self.limit:
            least[fresh] = np.partition(near[fresh], len(v) - self.limit, axis=1)[:, len(v) - self.limit] - 2 * error[fresh]
            self.least[own] = least
        bound = np.nextafter((least - 2 * error).astype(kind), kind(-np.inf))
        at = np.flatnonzero((near >= bound[:, None]).ravel())
        for hits in (at[i : i + SUMMED] for i in range(0, len(at), SUMMED)):
            query, other = np.divmod(hits, len(v))
            query = own[query]
            score = np.zeros(len(hits))
            for product in np.ascontiguousarray((self.vectors[query] * v[other]).T):
                score += product
            self.parts.append((query, score, held.column("id").take(pa.array(other))))
            self.waiting += len(hits)
            if self.waiting > self.settled + self.limit * len(self.vectors):
                self.cut()

    def cut(self) -> None:
        """Keeps the best rows of each query; of equal scores those of the smaller ids."""
        query, score = (np.concatenate([part[i] for part in self.parts]) for i in range(2))
        ids = pa.concat_arrays([part[2] for part in self.parts])
        order = np.lexsort((-score, query))
        start = np.searchsorted(query[order], query[order])
        place = np.arange(len(order)) - start
        last = order[np.minimum(start + self.limit - 1, len(order) - 1)]  # the row at the limit, or one of another query if there are fewer
        cut = place >= self.limit
        keep = np.ones(len(order), bool)
        keep[cut] = score[order[cut]] >= score[last[cut]]
        if (keep & cut).any():  # the ids decide among equal scores
            rows = order[keep]
            table = pa.table({"query": query[rows], "score": score[rows], "id": ids.take(pa.array(rows))})
            order = rows[pc.sort_indices(table, [("query", "ascending"), ("score", "descending"), ("id", "ascending")]).to_numpy()]
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            keep = place < self.limit
        order, place = order[keep], place[keep]
        full = order[place == self.limit - 1]
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        self.parts = [(query[order], score[order], ids.take(pa.array(order)))]
        self.waiting = self.settled = len(order)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.cut()
            query, score, ids = self.parts[0]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(query)), ids, pa.array(score)], ["query_id", "id", "score"])


def _best_of(centres: np.ndarray, places: dict[int, int], probes: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For pairs of a block of queries and a block of vectors, by query block: the ``limit`` best vectors of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (own := batch.column("block")[i].as_py()) != block:
                    if found:
                        yield from found.rows()
                    block, found = own, _Found(_unpacked(batch.column("asked")[i]), centres, probes, limit)
                found.meet(places[batch.column("cell")[i].as_py()], _unpacked(batch.column("held")[i]))
        if found:
            yield from found.rows()

    return run


class VectorIndex:
    """The stored cells of a table of vectors (id, embedding, and others that pass through)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)
        self.state: dict[str, Any] = self.versions.state()

    def build(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """Stores all ``vectors`` that have an embedding by cell; some sqrt(n) cells if None. All must be of one width."""
        kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        shape = kept.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).head()
        if shape["n"] == 0:
            self.state = {"cells": None, "schema": ddl(vectors)}
        else:
            if shape["least"] != shape["most"]:
                raise ValueError(f"vectors of {shape['least']} and {shape['most']} components")
            width = shape["least"]
            cells = min(MOST_CELLS, cells or max(1, round(math.sqrt(shape["n"]))))
            centres, probes = centres_of(kept.select("id", "embedding"), width, cells)
            folder, summary = self.versions.new_folder("cells"), self.versions.new_folder("centres")
            names = kept.columns

            def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    cell, away = _nearest(_matrix(batch.column("embedding"), width), centres)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell.astype(np.int32))], [*names, "__away", "cell"])

            placed = kept.mapInArrow(assign, f"{ddl(kept)}, `__away` double, cell int")
            placed.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(self.versions.path(folder))
            self.state = {"cells": folder, "centres": summary, "schema": ddl(kept), "width": width, "probes": probes}
            radii = self._stored().groupBy("cell").agg(F.max("__away").alias("radius"), F.count("*").alias("n"))
            own = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")  # as many rows as cells
            own.join(radii, "cell").coalesce(1).write.parquet(self.versions.path(summary))
        self.versions.commit(self.state, self.versions.latest())
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.state['schema']}, `__away` double, cell int").parquet(self.versions.path(self.state["cells"]))

    def bounds(self, query: Sequence[float]) -> list[tuple[int, float]]:
        """Cells with what their vectors can score at most, in the order of their centres' nearness. A row for each cell."""
        if not self.state.get("cells"):
            return []
        length = math.sqrt(sum(x * x for x in query))
        near = dot(F.col("centre"), F.array(*(F.lit(float(x)) for x in query)))
        rows = self.spark.read.parquet(self.versions.path(self.state["centres"])).select("cell", near.alias("near"), (near + F.lit(length) * F.col("radius")).alias("bound"))
        return [(r["cell"], r["bound"]) for r in rows.orderBy(F.desc("near"), "cell").collect()]

    def _of(self, cells: list[int]) -> DataFrame:
        return self._stored().filter(F.col("cell").isin(cells)).drop("__away", "cell")

    def search(self, query: Sequence[float], limit: int, probes: int | None = None, floor: float | None = None, exact: bool = False) -> DataFrame:
        """The rows nearest to ``query`` by inner product, best first, of the ``probes`` first cells (those measured for RECALL if None).

        An ``exact`` search goes on to all cells that can hold a row as good as the last one found."""
        if len(query) != self.state.get("width", len(query)):
            raise ValueError(f"a query of {len(query)} components for vectors of {self.state['width']}")
        order = self.bounds(query)
        first = probes or self.state.get("probes", 1)
        chosen = [c for c, _ in order[:first]]
        if exact and len(order) > first:
            near = self._best(chosen, query, limit, floor).select("score").collect()  # at most ``limit`` rows
            least = near[-1]["score"] if len(near) == limit else -math.inf if floor is None else floor
            chosen = [c for c, b in order if b >= least - 1e-9 * (1 + abs(least))] if least > -math.inf else [c for c, _ in order]  # sums are rounded
        return self._best(chosen, query, limit, floor)

    def _best(self, cells: list[int], query: Sequence[float], limit: int, floor: float | None) -> DataFrame:
        if not cells:
            return self.spark.createDataFrame([], self.state["schema"]).withColumn("score", F.lit(0.0))
        found = self._of(cells).withColumn("score", dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
        if floor is not None:
            found = found.filter(F.col("score") >= floor)
        return found.orderBy(F.desc("score"), "id").limit(limit)

    def neighbours(self, queries: DataFrame, limit: int, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank of the ``limit`` nearest of each query (query_id, embedding) among its first cells.

        Queries are dealt over tasks once, as blocks. A task reads the blocks of up to TASK_VECTORS vectors from where they are stored, so
        that no vector is shuffled and no query copied to its cells; ``limit`` rows a query leave it."""
        width, probes = self.state["width"], probes or self.state["probes"]
        rows = self.spark.read.parquet(self.versions.path(self.state["centres"])).select("cell", "centre", "n").toArrow()  # a row for each cell
        places = {c: i for i, c in enumerate(rows["cell"].to_pylist())}
        centres, n = _matrix(rows["centre"].combine_chunks(), width), sum(rows["n"].to_pylist())
        own = queries.filter(F.size("embedding") == width).select("query_id", "embedding")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-own.count() // TASK_QUERIES))
        asked = own.repartition(tasks, "query_id").mapInArrow(_asked, "block string, asked binary")
        held = self._stored().select("id", "embedding", "cell")
        kind, id_type = own.schema["query_id"].dataType.simpleString(), held.schema["id"].dataType.simpleString()
        held = stored(held.mapInArrow(_held(width, limit), "cell int, held binary"), "held").coalesce(max(1, -(-n // TASK_VECTORS)))
        # A product deals each pair of partitions to a task, by query block, and shuffles nothing.
        met = asked.crossJoin(held.hint("shuffle_replicate_nl"))
        scored = met.mapInArrow(_best_of(centres, places, probes, limit), f"query_id {kind}, id {id_type}, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
