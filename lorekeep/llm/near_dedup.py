"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its shingles of five words, weighted by how often they occur (a text
of fewer words is one shingle). Similarity is weighted Jaccard, the sum of smaller weights over the
sum of larger ones; documents of SIMILARITY or more are linked.

Every element owns a half-plane of (weight, rank). Hashed darts fall on it with DENSITY darts per
unit of area: each cell of unit weight and 1 / DENSITY ranks has a Poisson number of darts that only
the element and the cell decide. A document of total weight w looks at the darts under its elements'
weights whose rank is below theta / w, about theta * DENSITY of them whatever its size. A hash sends
each dart to one coordinate of the signature, which keeps its earliest dart. If a coordinate stays
empty, theta grows. Two documents agree in a coordinate with the probability of their similarity.

Signatures are joined in bands; candidates are verified exactly, and linked documents form classes
(see linking.py, where the n-th occurrence of a shingle is an element of its own). Texts with the same
words in the same order are one node from the start, so large groups of copies cost no comparisons.
Only documents that repeat or resemble others are looked at again when classes are formed. BANDS bands of ROWS coordinates miss a pair of similarity 0.8
with probability 3e-5, and fewer above.

Defined results: words are runs of letters, digits and underscores, in lower case. Documents without
words (null or empty texts) are in a class of their own each. class_id is the smallest doc_id of the
class; the row with it stays, and of several a hash of all their columns decides. A null doc_id ranks
above all others. An empty table gives no rows. Only doc_id and text are read; ``near_deduplicated``
returns all columns, which may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lorekeep.llm.common import discard, mix64, row_numbers, row_tie, slices, small, stored, text_of, tidy
from lorekeep.llm.linking import SKETCH, SKETCHED, link, shared_buckets, sketches

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
COORDINATES = BANDS * ROWS
DENSITY = 512  # about COORDINATES * (log(COORDINATES) + 2)
#: Word hashes that a worker remembers; strips of elements handled at once.
MEMORY_WORDS, STRIPS_AT_ONCE = 250_000, 1 << 17

_WORD = re.compile(r"\w+")
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 16)])])
_UNIT = 2.0**-32


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY_WORDS:
            self[word] = value
        return value


_hashes = _WordHashes()


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of non-empty ``words`` as hashes, ascending, and how often each occurs."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n, total = max(1, len(h) - WORDS + 1), np.uint64(len(h) if len(h) < WORDS else WORDS)
        mixed = np.full(n, total, np.uint64)
        for i in range(min(WORDS, len(h))):
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(mixed, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def dart_minhash(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The earliest dart of each coordinate, for distinct ``elements`` with positive ``weights``."""
    total, theta = float(weights.sum()), 1.0
    strips = np.ceil(weights).astype(np.int64)
    ends = np.cumsum(strips)
    while True:
        limit = theta / total
        cells = int(np.ceil(limit * DENSITY))
        best, earliest = np.zeros(COORDINATES, np.uint64), np.full(COORDINATES, np.inf)
        step = max(1, STRIPS_AT_ONCE // cells)
        for low in range(0, int(ends[-1]), step):
            strip = np.arange(low, min(low + step, int(ends[-1])))
            owner = np.searchsorted(ends, strip, side="right")
            bottom = (strip - ends[owner] + strips[owner]).astype(np.uint64)
            dart, rank = _darts(elements[owner], bottom, weights[owner], cells, limit)
            late = np.argsort(-rank, kind="stable")
            dart, rank = dart[late], rank[late]
            place = (mix64(dart ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(COORDINATES)).astype(np.int64)
            first, when = np.zeros(COORDINATES, np.uint64), np.full(COORDINATES, np.inf)
            first[place], when[place] = dart, rank  # the last written is the earliest
            sooner = when < earliest
            best[sooner], earliest[sooner] = first[sooner], when[sooner]
        if np.isfinite(earliest).all():
            return best
        theta += 0.5


def _darts(element: np.ndarray, bottom: np.ndarray, weight: np.ndarray, cells: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Names and ranks of the darts in the first ``cells`` cells of each strip, under the weight and the limit."""
    with np.errstate(over="ignore"):
        cell = np.arange(cells, dtype=np.uint64)
        key = mix64(element + bottom * np.uint64(0xA0761D6478BD642F))
        key = mix64(key[:, None] + (cell + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        count = np.searchsorted(_POISSON, (key >> np.uint64(11)).ravel() * 2.0**-53)
        thrown = np.repeat(np.arange(key.size), count)
        nth = np.arange(len(thrown)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix64(key.ravel()[thrown] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))
    strip, at = thrown // cells, thrown % cells
    rank = (at + (dart >> np.uint64(32)) * _UNIT) / DENSITY
    hit = (rank < limit) & (bottom[strip] + (dart & np.uint64(0xFFFFFFFF)) * _UNIT < weight[strip])
    return dart[hit], rank[hit]


def bands(signature: np.ndarray) -> np.ndarray:
    """Band keys: equal bands of two signatures give equal keys."""
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in signature.reshape(BANDS, ROWS).T:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = row_numbers()
    for batch in slices(batches, limit=1 << 20):
        nodes, checks, keys = [], [], []
        for text in batch.column("text").to_pylist():
            words = _WORD.findall(text.lower())
            if not words:
                nodes.append(None), checks.append(None), keys.append(None)
                continue
            digest = xxhash.xxh3_128_digest(" ".join(words))
            nodes.append(int.from_bytes(digest[:8], "little", signed=True))
            checks.append(int.from_bytes(digest[8:], "little", signed=True))
            keys.append(bands(dart_minhash(*shingles(words))))
        rows = pa.array([next(number) for _ in nodes], pa.int64())
        arrays = [*(batch.column(c) for c in ("doc", "doc_id", "tie")), rows, pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "doc_id", "tie", "row", "node", "check", "bands"])
    _hashes.clear()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and counts of each text, packed, with sizes and sketches."""
    for batch in slices(batches, limit=1 << 20):
        sets = [shingles(_WORD.findall(t.lower())) for t in batch.column("text").to_pylist()]
        packed = pa.array([values.tobytes() + counts.astype(np.uint32).tobytes() for values, counts in sets], pa.binary())
        sketched: list[list[np.ndarray]] = [[] for _ in range(1 + len(SKETCH))]
        for start in range(0, len(sets), 1000):
            part = sets[start : start + 1000]
            values, counts = (np.concatenate([x[k] for x in part]) for k in (0, 1))
            owner = np.repeat(np.arange(len(part)), [len(x[0]) for x in part])
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                elements = mix64(np.repeat(values, counts) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for column, found in zip(sketched, sketches(np.repeat(owner, counts), elements, len(part)), strict=True):
                column.append(found)
        if sets:
            yield pa.RecordBatch.from_arrays([batch.column("node"), packed, *(pa.array(np.concatenate(c), pa.int64()) for c in sketched)], names=["node", "content", "size", *SKETCH])
    _hashes.clear()


def _unpacked(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(content) // 12
    return np.frombuffer(content, np.uint64, n), np.frombuffer(content, np.uint32, n, 8 * n).astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("content_a"), batch.column("content_b"), strict=True)
        kept = pa.array([similarity(_unpacked(a.as_py()), _unpacked(b.as_py())) >= SIMILARITY for a, b in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(kept)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row of ``docs`` (doc, doc_id, row) as it was stored; row, key of rows that aren't alone in
    their class; and key, first (a place with doc_id and row), class_size of those classes."""
    given = docs.select(F.struct("*").alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), row_tie(docs).alias("tie"), text_of(docs).alias("text"))
    schema = StructType([StructField("doc", given.schema["doc"].dataType), *(StructField(c, LongType()) for c in ("doc_id", "tie", "row", "node", "check")), StructField("bands", ArrayType(LongType()))])
    read = stored(given.mapInArrow(tidy(_read), schema), "signatures")
    worded = read.filter("node is not null")
    members = shared_buckets(worded.select("node", "bands"))
    needed = stored(members.select("node").distinct(), "nodes")
    chosen = small(stored(worded.join(small(needed, 16), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "chosen"), 32)
    texts = worded.select("row", "check", F.col("doc.text").cast("string").alias("text")).join(chosen, "row").select("node", "check", "text")
    contents = stored(texts.select("node", "text").mapInArrow(tidy(_contents), f"node long, content binary, {SKETCHED}"), "contents")
    roots = link(members, contents, lambda pairs: pairs.mapInArrow(tidy(_verified), "a long, b long"), SIMILARITY)

    # A second hash parts different texts that share the first one.
    linked = worded.select("row", "node", "check").join(chosen, ["row", "node"], "left_semi").join(small(roots, 16), "node").select("node", "check", "root")
    repeated = worded.groupBy("node", "check").agg(F.count("*").alias("n")).filter("n > 1").select("node", "check")
    keys = repeated.join(linked, ["node", "check"], "full_outer")
    keys = keys.select("node", "check", F.struct(F.coalesce("root", "node").alias("node"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("check")).alias("key"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "row")
    seen = stored(worded.join(small(stored(keys, "keys"), 48), ["node", "check"]).select("row", "key", place.alias("place")), "together")
    groups = stored(seen.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("class_size")), "classes")
    discard(members, needed, contents, roots)
    return read.select("doc", "doc_id", "row"), seen.select("row", "key"), groups


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row of ``docs``."""
    rows, seen, groups = _classes(docs)
    found = stored(seen.join(small(groups, 64), "key").select("row", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")), "decided")
    alone = F.col("class_size").isNull()
    joined = rows.select("row", "doc_id").join(small(found, 40), "row", "left")
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("kept", F.lit(True)).alias("kept"))


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with all columns."""
    rows, seen, groups = _classes(docs)
    gone = stored(seen.select("row").join(groups.select("first.row"), "row", "left_anti"), "gone")
    return rows.join(small(gone, 16), "row", "left_anti").select("doc.*")
