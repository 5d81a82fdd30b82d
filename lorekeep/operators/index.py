"""The inverted index of observations, kept up by segments.

A change writes one new segment with the postings of its rows, and tombstones for the rows that it replaces or removes;
nothing else is written. Segments of like size are merged when there are FAN of them, and one whose rows are mostly dead is
written again, so that there are some FAN log(n) segments. A segment knows how many rows and tokens it and its
tombstones hold: the corpus' size and average length are sums over segments, without reading any. A term's postings lie in one
folder of each segment, so a search reads those folders only; the number of a term's rows is counted
among the live ones it reads.

All of it is named by one manifest (sources.versions): a change becomes visible at once, and readers pin a version.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.stem import stem
from lorekeep.functions.text import tokens
from lorekeep.operators.store import changes
from lorekeep.sources.versions import Conflict, Versions

#: Segments of one size class that are merged, and how classes follow each other.
FAN = 4
#: Rows whose postings share a folder of a segment, folders at most, and rows whose postings share a file of a folder: folders
#: get more files only when there are no more folders, so that a segment's files are in proportion to its rows.
FOLDER_ROWS, MOST_FOLDERS, FILE_ROWS = 500, 4096, 500 * 4096
#: Tokens that are counted at once.
MOST_TOKENS = 1 << 18
#: Batches of so few rows, which may come in one file, are spread over all cores; so many rows to a task.
SPREAD_ROWS, TASK_ROWS = 200_000, 250
#: Tombstones of a segment are broadcast up to this number, which their writer counted.
BROADCAST_ROWS = 500_000
POSTINGS = "id string, project string, term string, tf_title long, tf_body long, tf_tags long, length long"
ROWS = "id string, project string, length long, hash long"
FIELDS = ("title", "body", "tags")


def _fields() -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("body"), F.array_join("tags", " "))]


def _length() -> Column:
    """How many tokens a row has, without making them."""
    return sum((F.regexp_count(F.lower(c), F.lit(r"[\p{L}\p{N}_]+")) for c in _fields()), F.lit(0)).cast("long")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where its rows' tokens reach another MOST_TOKENS, so that a long batch needs no more memory than a short one."""
    upto = sum((batch.column(f).value_lengths().fill_null(0).to_numpy().cumsum(dtype=np.int64) for f in FIELDS), np.zeros(batch.num_rows, np.int64))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + MOST_TOKENS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _count(batches: Iterator[pa.RecordBatch], stemmed: bool = False) -> Iterator[pa.RecordBatch]:
    """Postings of rows with their tokens by field: equal tokens of a row are counted where the row is.

    Stems are worked out once for each word of a batch. Rows are counted by runs of at most MOST_TOKENS, or one by one."""
    for batch in (part for whole in batches for part in _runs(whole)):
        lists = [batch.column(f) for f in FIELDS]
        sizes = [np.diff(x.offsets.to_numpy()) for x in lists]  # of a slice, the offsets of its rows
        flat = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
        if stemmed:
            stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string()).dictionary_encode()
            flat = pa.DictionaryArray.from_arrays(stems.indices.take(flat.indices), stems.dictionary)
        row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
        field = np.repeat(np.arange(len(FIELDS)), [int(n.sum()) for n in sizes])
        width = max(1, len(flat.dictionary))
        pairs, place = np.unique(row * width + flat.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        counts = np.bincount(place * len(FIELDS) + field, minlength=len(pairs) * len(FIELDS)).reshape(-1, len(FIELDS))
        at, code = np.divmod(pairs, width)
        own = pa.array(at)
        columns = [batch.column("id").take(own), batch.column("project").take(own), flat.dictionary.take(pa.array(code)), *(pa.array(counts[:, i].astype(np.int64)) for i in range(len(FIELDS))), pa.array(sum(sizes)[at].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTINGS.split(", ")])


def postings(observations: DataFrame, stemmed: bool = False) -> DataFrame:
    """id, project, term, occurrences in title, body and tags, and the row's number of tokens. Nothing is shuffled."""
    texts = [tokens(c).alias(f) for f, c in zip(FIELDS, _fields(), strict=True)]
    return observations.select(F.col("id").cast("string").alias("id"), F.col("project").cast("string").alias("project"), *texts).mapInArrow(lambda batches: _count(batches, stemmed), POSTINGS)


def content_hash() -> Column:
    """What tells whether a row must be indexed again."""
    return F.xxhash64("project", "title", "body", "tags")


def _layout(n: int) -> tuple[int, int]:
    """Folders of a segment of ``n`` rows, and files of a folder: a frequent term's postings fill as many files as it takes."""
    return min(MOST_FOLDERS, 1 << max(0, math.ceil(math.log2(max(1, n) / FOLDER_ROWS)))), 1 + n // FILE_ROWS


class SearchIndex:
    """The index in a folder. ``state`` is the pinned version; ``apply`` and ``refresh`` move on to the next.

    A ``stemmed`` index holds the stems of English words and finds by them; that is settled by its first version."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None, stemmed: bool = False):
        self.spark, self.versions = spark, Versions(spark, folder)
        self.version = self.versions.latest() if version is None else version
        self.state = self.versions.state(self.version) or {"segments": [], "stemmed": stemmed}

    # Reading

    def _read(self, folders: list[str] | str, schema: str) -> DataFrame:
        paths = [folders] if isinstance(folders, str) else folders
        return self.spark.read.schema(schema).parquet(*map(self.versions.path, paths))

    def _alive(self, segment: dict[str, Any], rows: DataFrame) -> DataFrame:
        """Rows of a segment without those that its tombstones name."""
        if not segment["dead"]:
            return rows
        dead = self._read(segment["dead"], "id string, length long").select("id")
        return rows.join(F.broadcast(dead) if segment["n_dead"] <= BROADCAST_ROWS else dead, "id", "left_anti")

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """id, project, length, hash of all indexed rows."""
        return self._union([self._alive(s, self._read(s["rows"], ROWS)) for s in self.state["segments"]], ROWS)

    @property
    def size(self) -> int:
        return sum(s["n"] - s["n_dead"] for s in self.state["segments"])

    @property
    def average_length(self) -> float:
        return sum(s["length"] - s["length_dead"] for s in self.state["segments"]) / max(1, self.size)

    def matches(self, terms: list[str]) -> DataFrame:
        """The live postings of some terms (or their stems), from the folders that hold them."""
        parts = []
        if self.state.get("stemmed"):
            terms = list(dict.fromkeys(map(stem, terms)))
        for s in self.state["segments"]:
            own = sorted({zlib.crc32(t.encode()) % s["folders"] for t in terms})
            there = set(self.versions.files.names(s["postings"]))  # no other folder is listed
            if paths := [self.versions.path(f"{s['postings']}/folder={f}") for f in own if f"folder={f}" in there]:
                found = self.spark.read.schema(f"{POSTINGS}, folder int").option("basePath", self.versions.path(s["postings"])).parquet(*paths)
                parts.append(self._alive(s, found.filter(F.col("folder").isin(own) & F.col("term").isin(terms)).drop("folder")))
        return self._union(parts, POSTINGS)

    # Writing

    def _segment(self, name: str, found: DataFrame, rows: DataFrame, n: int) -> dict[str, Any]:
        """Writes a segment of postings and rows; ``n`` sets how many folders it gets."""
        folders, parts = _layout(n)
        segment = {"postings": self.versions.new_folder("postings"), "rows": self.versions.new_folder("rows"), "folders": folders, "dead": [], "n_dead": 0, "length_dead": 0, "name": name}
        dealt = found.withColumn("folder", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(folders)).cast("int"))
        dealt = dealt.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(parts)))  # the write sorts by folder, and no order within one is needed
        dealt.write.partitionBy("folder").parquet(self.versions.path(segment["postings"]))
        rows.write.parquet(self.versions.path(segment["rows"]))
        count, length = self._read(segment["rows"], ROWS).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
        return segment | {"n": count, "length": length}

    def _bury(self, segments: list[dict[str, Any]], ids: DataFrame) -> list[dict[str, Any]]:
        """The segments with tombstones for their live rows among ``ids`` (id, distinct)."""
        parts = [self._alive(s, self._read(s["rows"], ROWS)).select(F.lit(i).alias("segment"), "id", "length") for i, s in enumerate(segments)]
        if not parts:
            return segments
        folder = self.versions.new_folder("dead")
        self._union(parts, "").join(ids, "id", "left_semi").repartition("segment").write.partitionBy("segment").parquet(self.versions.path(folder))
        dead = self.spark.read.schema("id string, length long, segment int").parquet(self.versions.path(folder))
        hit = {r["segment"]: r for r in dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()}  # a row a segment
        return [s if i not in hit else s | {"dead": [*s["dead"], f"{folder}/segment={i}"], "n_dead": s["n_dead"] + hit[i]["n"], "length_dead": s["length_dead"] + hit[i]["length"]} for i, s in enumerate(segments)]

    def _merged(self, segments: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """The segments with those of one size class merged, where there are FAN of them or one is mostly dead."""
        live = lambda s: s["n"] - s["n_dead"]
        segments = [s for s in segments if live(s)]
        classes: dict[int, list[dict[str, Any]]] = {}
        for s in segments:
            classes.setdefault(int(math.log(live(s), FAN)), []).append(s)
        for group in classes.values():
            worn = [s for s in group if s["n_dead"] > live(s)]
            chosen = group if len(group) >= FAN else worn
            if chosen:
                found = self._union([self._alive(s, self._read(s["postings"], POSTINGS)) for s in chosen], POSTINGS)
                rows = self._union([self._alive(s, self._read(s["rows"], ROWS)) for s in chosen], ROWS)
                merged = self._segment("merge", found, rows, sum(map(live, chosen)))
                return self._merged([*(s for s in segments if s not in chosen), merged])
        return segments

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Indexes ``upserts`` (observations, one row an id), which replace rows of their ids, and removes ``deletes`` (id)."""
        segments, new = list(self.state["segments"]), None
        ids = [x.select(F.col("id").cast("string").alias("id")) for x in (upserts, deletes) if x is not None]
        if upserts is not None:
            n = upserts.count()
            if n <= SPREAD_ROWS:
                upserts = upserts.repartition(min(self.spark.sparkContext.defaultParallelism, 1 + n // TASK_ROWS))
            rows = upserts.select(F.col("id").cast("string").alias("id"), F.col("project").cast("string").alias("project"), _length().alias("length"), content_hash().alias("hash"))
            new = self._segment("batch", postings(upserts, self.state.get("stemmed", False)), rows, n)
        if ids and segments:
            segments = self._bury(segments, reduce(DataFrame.unionByName, ids).distinct())
        state = self.state | {"segments": self._merged([*segments, new] if new else segments)}
        self.version = self.versions.commit(state, self.version)
        self.state = state
        return self.version

    def refresh(self, observations: DataFrame) -> SearchIndex:
        """Brings the index up to ``observations``: only rows that were added, changed or removed are indexed."""
        for _ in range(3):
            try:
                if not self.version:
                    self.apply(observations)
                    return self
                found = observations.select(F.col("id").cast("string").alias("id"), content_hash().alias("hash"))
                known = changes(self.rows(), found, "id", "hash")
                kinds = {r["change"] for r in known.select("change").distinct().collect()}  # three values
                if kinds:
                    fresh = observations.join(known.filter("change <> 'deleted'").select("id"), "id", "left_semi")
                    self.apply(fresh if kinds != {"deleted"} else None, known.filter("change = 'deleted'").select("id") if "deleted" in kinds else None)
                return self
            except Conflict:  # another session was faster: go on from what it made
                self.version = self.versions.latest()
                self.state = self.versions.state(self.version)
        raise Conflict(f"{self.versions.folder} changes faster than it is read")
