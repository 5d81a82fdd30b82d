"""Fuzzy line deduplication across documents.

Lines that aren't blank (without white space at the ends) are sets of GRAM-character shingles in lower
case; a shorter line is one shingle, so it resembles only what equals it but for case. A one-permutation MinHash puts each shingle into one of COORDINATES bins
and keeps each bin's smallest hash; empty bins copy from bins that a hash names. Bands of ROWS bins
give candidate pairs, which are verified by exact Jaccard similarity of their shingles. Lines of
SIMILARITY or more are linked, a distributed union-find makes components (see linking.py), and of
each component only the first occurrence stays: that with the smallest doc_id, then line number.
BANDS bands miss a pair of similarity 0.8 with probability 0.002, of 0.85 with 0.0002.

Texts are read once: a table is stored in which every row has a number and the hashes of its lines.
Equal lines are one node, so a line repeated by a third of all documents costs no comparisons. Only
lines that repeat or resemble others are looked at again: the first of them is a grouped minimum, the
others go by their own places, never gathered.

Defined results: null text counts as empty. Blank lines are never removed. A document
that had text and loses all its lines that aren't blank is dropped by ``deduplicated``. Of rows with
the same doc_id, a hash of all their columns decides which is first; rows that repeat lose all lines
that aren't blank but for the first of them. A null doc_id ranks above all others. An empty table
gives no rows. Only doc_id and text are read; ``deduplicated`` returns all columns, which may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lorekeep.llm.common import BROADCAST_BYTES, discard, mix64, row_numbers, row_tie, slices, small, stored, text_of, tidy
from lorekeep.llm.linking import SKETCH, SKETCHED, link, shared_buckets, sketches

GRAM, SIMILARITY, BANDS, ROWS, LEAST_CHARS = 8, 0.8, 12, 4, 1
COORDINATES = BANDS * ROWS
BLANK = " \t\r\f\v"
#: Characters of lines that are signed at once.
SIGNED_AT_ONCE = 1 << 18
_EMPTY = np.uint32(2**32 - 1)


def signatures(lines: list[str]) -> np.ndarray:
    """A row of COORDINATES bins for each line: the least hash of the shingles that fall in a bin."""
    low = [s.lower() for s in lines]
    low = [s if len(s) >= GRAM else s.ljust(GRAM, "\0") for s in low]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    h = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    for width, odd in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
        wider = h[:-width] * np.uint32(odd)
        wider += h[width:]
        h = wider
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(odd)
    h ^= h >> np.uint32(16)
    full = np.full(lengths.sum(), _EMPTY, np.uint32)
    full[: len(h)] = h
    full[(np.cumsum(lengths)[:, None] - np.arange(1, GRAM)).ravel()] = _EMPTY  # these would reach into the next line
    place = np.repeat(np.arange(len(low)) * COORDINATES, lengths)
    place += (full >> np.uint32(16)) * np.uint32(COORDINATES) >> np.uint32(16)
    bins = np.full(len(low) * COORDINATES, _EMPTY, np.uint32)
    np.minimum.at(bins, place, np.minimum(full, _EMPTY - np.uint32(1), out=full, where=full != _EMPTY))
    return _filled(bins.reshape(-1, COORDINATES))


def _filled(bins: np.ndarray) -> np.ndarray:
    """Empty bins copy from bins that a hash of their number names."""
    single = np.flatnonzero((bins != _EMPTY).sum(1) == 1)  # all copies come from the only bin
    bins[single] = bins[single].min(1, keepdims=True)
    filled, turn = bins.copy(), 0
    row, column = np.nonzero(bins == _EMPTY)
    while len(row):
        turn += 1
        donor = (mix64(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(turn * 1000)) % np.uint64(COORDINATES)).astype(np.int64)
        found = bins[row, (donor if turn < 1000 else np.roll(np.arange(COORDINATES), turn))[column]]
        filled[row, column] = found
        left = found == _EMPTY
        row, column = row[left], column[left]
    return filled


def band_keys(bins: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
        for column in np.moveaxis(bins.reshape(-1, BANDS, ROWS).astype(np.uint64), 2, 0):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def grams(line: str) -> set[str]:
    """The shingles of a line."""
    line = line.lower()
    return {line} if len(line) < GRAM else {line[i : i + GRAM] for i in range(len(line) - GRAM + 1)}


def _hashed_sets(lines: list[str]) -> list[np.ndarray]:
    """Of each line the distinct 64-bit hashes of its shingles, ascending."""
    if not lines:
        return []
    low = [s.lower().ljust(GRAM, "\0") for s in lines]
    stops = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    h = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        for width, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xA0761D6478BD642F), (4, 0xE7037ED1A0B428DB)):
            h = h[:-width] * np.uint64(odd) + h[width:]
    h = mix64(h)
    found = []
    for start, stop in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
        own = np.sort(h[start : stop - GRAM + 1])
        found.append(own[np.append(True, own[1:] != own[:-1])])
    return found


def _with_text(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Batches with the documents' field of that place as their text, null as empty."""
    for batch in batches:
        yield batch.append_column("text", pc.fill_null(pc.struct_field(batch.column("doc"), [place]), ""))


def _read(batches: Iterator[pa.RecordBatch], place: int | None = None) -> Iterator[pa.RecordBatch]:
    """A numbered row for each document, with hashes of its lines (null for blank ones), and a row for
    each of a slice's distinct lines, with its bands. The text is the document's field at ``place``, or a column by itself (None)."""
    number = row_numbers()
    for batch in slices(batches if place is None else _with_text(batches, place), "text", 1 << 20):
        index: dict[str, int] = {}
        given = [[index.setdefault(x, len(index)) if (x := line.strip(BLANK)) else -1 for line in t.split("\n")] for t in batch.column("text").to_pylist()]
        lines = list(index)
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)
        digest = np.concatenate([digest, np.zeros((1, 2), np.int64)])  # the last one stands for blank lines
        flat = np.fromiter((i for own in given for i in own), np.int64)
        ends = pa.array(np.cumsum([0, *map(len, given)]), pa.int32())
        hashes = [pa.ListArray.from_arrays(ends, pa.array(digest[flat, k], mask=flat < 0)) for k in (0, 1)]
        n = batch.num_rows
        rows = pa.array([next(number) for _ in range(n)], pa.int64())
        yield _table(n, doc=batch.column("doc"), doc_id=batch.column("doc_id"), tie=batch.column("tie"), row=rows, nodes=hashes[0], checks=hashes[1])
        start = 0
        while start < len(lines):
            stop, held = start, 0
            while stop < len(lines) and held < SIGNED_AT_ONCE:
                held += len(lines[stop])
                stop += 1
            part = lines[start:stop]
            keys, short = band_keys(signatures(part)), np.fromiter((len(s.lower()) < GRAM for s in part), bool, len(part))
            used = ~short[:, None] | (np.arange(BANDS) == 0)  # sets of one shingle need one band
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, used.sum(1).cumsum()), pa.int32()), pa.array(keys[used]))
            yield _table(len(part), doc=pa.nulls(len(part), batch.column("doc").type), node=pa.array(digest[start:stop, 0]), bands=bands)
            start = stop


def _table(n: int, **columns: pa.Array) -> pa.RecordBatch:
    lists, plain = pa.list_(pa.int64()), pa.int64()
    kinds = {"doc": None, "doc_id": plain, "tie": plain, "row": plain, "nodes": lists, "checks": lists, "node": plain, "bands": lists}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines asked for, with the sizes and sketches of their sets."""
    for batch in slices(batches, "text", 1 << 20):
        nodes, checks, found = [], [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = text.split("\n")
            for w in wanted:
                nodes.append(w["node"]), checks.append(w["check"]), found.append(lines[w["line_no"]].strip(BLANK))
        for start in range(0, len(found), 1000):
            part = found[start : start + 1000]
            sets = _hashed_sets(part)
            owner = np.repeat(np.arange(len(part)), [len(x) for x in sets])
            sketched = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in sketches(owner, np.concatenate(sets), len(part))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[start : start + 1000], pa.int64()), pa.array(checks[start : start + 1000], pa.int64()), pa.array(part), *sketched], names=["node", "check", "content", "size", *SKETCH])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "content_a", 1 << 19), "content_b", 1 << 19):
        first, second = (batch.column(c).to_pylist() for c in ("content_a", "content_b"))
        lines = list(dict.fromkeys(first + second))
        sets = dict(zip(lines, _hashed_sets(lines), strict=True))
        kept = np.zeros(len(first), bool)
        for i, (a, b) in enumerate(zip(first, second, strict=True)):
            x, y = sorted((sets[a], sets[b]), key=len)
            common = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
            kept[i] = common >= SIMILARITY * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept))


def _decided(docs: DataFrame) -> DataFrame:
    """doc (all columns), n_lines, n_removed, kept_text of every row of ``docs``."""
    given = docs.select(F.struct("*").alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), row_tie(docs).alias("tie"), text_of(docs).alias("text"))
    kinds = {"doc_id": LongType(), "tie": LongType(), "row": LongType(), "nodes": ArrayType(LongType()), "checks": ArrayType(LongType()), "node": LongType(), "bands": ArrayType(LongType())}
    schema = StructType([StructField("doc", given.schema["doc"].dataType), *(StructField(c, k) for c, k in kinds.items())])
    # Python gets each text once: as a field of its document, if it is a string there.
    place = next((i for i, f in enumerate(docs.schema.fields) if f.name.lower() == "text" and f.dataType == StringType()), None)
    given = given if place is None else given.drop("text")
    read = stored(given.mapInArrow(tidy(lambda batches: _read(batches, place)), schema), "lines")
    whole = read.filter("row is not null")
    lines = whole.select("row", "doc_id", "tie", F.posexplode(F.arrays_zip("nodes", "checks")).alias("line_no", "hashes"))
    lines = lines.select("row", "doc_id", "tie", "line_no", F.col("hashes.nodes").alias("node"), F.col("hashes.checks").alias("check")).filter("node is not null")

    members = shared_buckets(read.filter("node is not null").select("node", "bands"))
    needed = stored(members.select("node").distinct(), "nodes")
    chosen = lines.join(small(needed, 16), "node", "left_semi").groupBy("node").agg(F.min(F.struct("row", "line_no", "check")).alias("at"))
    wanted = stored(chosen.groupBy("at.row").agg(F.collect_list(F.struct("node", "at.check", "at.line_no")).alias("wanted")), "wanted")
    if needed.count() * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    texts = whole.select("row", text.alias("text"))
    contents = stored(texts.join(wanted, "row").select("text", "wanted").mapInArrow(tidy(_contents), f"node long, check long, content string, {SKETCHED}"), "contents")
    roots = link(members, contents, lambda pairs: pairs.mapInArrow(tidy(_verified), "a long, b long"), SIMILARITY)

    # A second hash parts different lines that share the first one. Of the lines that are left to look at
    # there is a row for each node, and then places, which are of one line each: no task gets a frequent line's occurrences.
    linked = contents.select("node", "check").join(small(roots, 16), "node")
    repeated = lines.groupBy("node", "check").agg(F.count("*").alias("n")).filter("n > 1").select("node", "check")
    keys = repeated.join(linked, ["node", "check"], "full_outer").select("node", "check", F.coalesce("root", "node").alias("key"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("key_check"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "row", "line_no")
    seen = stored(lines.join(small(stored(keys, "keys"), 48), ["node", "check"]).select("key", "key_check", place.alias("place")), "occurrences")
    kept = seen.groupBy("key", "key_check").agg(F.min("place").alias("place"))
    gone = seen.select("place.row", "place.line_no").join(kept.select("place.row", "place.line_no"), ["row", "line_no"], "left_anti")
    removed = stored(gone.groupBy("row").agg(F.collect_list("line_no").alias("removed")), "removed")  # of one document
    discard(members, needed, contents, roots)
    if gone.count() * 16 <= BROADCAST_BYTES:
        removed = F.broadcast(removed)

    def without(split: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "removed"), lambda i: F.get(split, i)), "\n")

    # The text is split once, as an argument. Documents that keep all their lines, the most, are not put together again.
    left = F.element_at(F.transform(F.array(F.split(text, "\n")), without), 1)
    found = whole.join(removed, "row", "left")
    return found.select("doc", F.size("nodes").alias("n_lines"), F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("n_removed"), F.when(F.col("removed").isNull(), text).otherwise(left).alias("kept_text"))


def line_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every row of ``docs``."""
    return _decided(docs).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "kept_text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay. Documents that lose all their text are dropped."""
    kept = _decided(docs).filter((F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(BLANK + "\n")) != ""))
    changed = F.col("doc").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(F.when(F.col("n_removed") == 0, F.col("doc")).otherwise(changed).alias("doc")).select("doc.*")
