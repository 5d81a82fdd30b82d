"""Packing documents into sequences along a space-filling curve.

A document's token counts are hashed to a vector, projected to three dimensions and numbered along
a Hilbert curve, so that documents that follow each other resemble each other. Documents are laid
end to end in that order and cut every ``length`` tokens: only the last sequence can need padding.

The order is total and reruns agree: Hilbert key, then a hash of the row. The curve is divided into
buckets of bounded token counts from a histogram over its 4096 coarsest cells; cells that hold more
are counted again by further bits of the key, and what one whole key holds (a third of all rows may
share it) is split by ranges of the hash. The order depends on nothing but the rows. Each bucket learns its first
position from a prefix sum over buckets. Tasks get consecutive buckets, as many of them as there are
buckets for, so no task sees more than a bounded number of tokens.

Encoding goes chunk by chunk, where blanks and newlines separate chunks. The tokenizer drops white
space and never lets a token span it, so the ids are those of the whole text.

Defined results: null text counts as empty; an empty text is its end token alone. Repeated rows are
packed as often as they occur. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import mix64, shuffle_partitions, slices, small, stored, text_of, tidy

LENGTH, END_ID = 4096, 2
VECTOR_DIMS, CURVE_DIMS, CURVE_BITS, CELL_BITS, FINER_BITS, SEED = 256, 3, 10, 12, 6, 11
#: Chunks a Python worker remembers, and the longest that it does.
MEMORY_CHUNKS, MEMORY_CHARS = 300_000, 48
LEAST_BUCKET, MOST_BUCKET, BUCKETS_A_TASK = 1 << 16, 1 << 23, 4

_TAIL = "".join(c for c in string.punctuation if c != "'")


class ChunkEncoder:
    """Ids of whole texts as little-endian uint32 bytes, remembered by chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _each(self, chunks: list[str]) -> None:
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.known[chunk] = np.array(found.ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Words with at most a tail of marks are encoded many at once, as the ends of words part them again."""
        plain, words, other = [], [], []
        for chunk in chunks:
            core = chunk.rstrip(_TAIL)
            if core.isalpha() and "İ" not in core and unicodedata.is_normalized("NFC", core):
                plain.append(chunk)
                words.append(1 + (len(core) < len(chunk)))
            else:
                other.append(chunk)
        self._each(other)
        groups = range(0, len(plain), 500)
        joined = self.tokenizer.encode_batch_fast([" ".join(plain[i : i + 500]) for i in groups], add_special_tokens=False)
        for i, found in zip(groups, joined, strict=True):
            ids, group = np.array(found.ids, "<u4"), plain[i : i + 500]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            last = np.cumsum(words[i : i + 500])
            if len(ends) != last[-1]:
                self._each(group)
                continue
            data, start = ids.tobytes(), 0
            for chunk, stop in zip(group, (ends[last - 1] * 4).tolist(), strict=True):
                self.known[chunk] = data[start:stop]
                start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*parts) - self.known.keys())
        self._learn(new)
        get = self.known.__getitem__
        found = [b"".join(map(get, p)) for p in parts]
        full = len(self.known) > MEMORY_CHUNKS
        for chunk in new:
            if full or len(chunk) > MEMORY_CHARS:
                del self.known[chunk]
        return found


@cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer ``points`` (n, dims) below 2**bits, by Skilling's transform."""
    x, dims = [c.astype(np.int64) for c in points.T], points.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            set_, low = (x[i] & q) != 0, q - 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


@cache
def _hashing(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id its vector component and sign; and the projection of vectors to the curve's dimensions."""
    h = mix64(np.arange(size, dtype=np.uint64) + np.uint64(SEED))
    draw = np.random.default_rng(SEED).normal(0, 1, (VECTOR_DIMS, CURVE_DIMS))
    return (h % np.uint64(VECTOR_DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), draw


def curve_keys(ids: list[np.ndarray], size: int) -> np.ndarray:
    component, sign, projection = _hashing(size)
    vectors = np.stack([np.bincount(component[i], weights=sign[i], minlength=VECTOR_DIMS) for i in ids]) if ids else np.zeros((0, VECTOR_DIMS))
    norms = np.sqrt((vectors**2).sum(1, keepdims=True))
    x = 0.5 + 0.5 * np.tanh(0.8 * (vectors / np.maximum(norms, 1e-12)) @ projection)
    return hilbert_keys(np.minimum((x * (1 << CURVE_BITS)).astype(np.int64), (1 << CURVE_BITS) - 1), CURVE_BITS)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, limit=1 << 20):
            ids = [np.frombuffer(b + end, "<u4") for b in encoder.encode(batch.column("text").to_pylist())]
            keys = curve_keys(ids, len(encoder.ends_word))
            width = "<u2" if len(encoder.ends_word) <= 1 << 16 else "<u4"
            packed = pa.array([i.astype(width).tobytes() for i in ids], pa.binary())
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array(keys, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "key", "tokens", "ids"])

    return run


def _cut(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, position = None, 0
        for batch in slices(batches, "ids", 1 << 20):
            rows = []
            for doc_id, own, base, tokens, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "base", "tokens", "ids")), strict=True):
                if own != bucket:
                    bucket, position = own, base
                ids = np.frombuffer(packed, f"<u{len(packed) // tokens}").astype("<u4")
                data, n, start = memoryview(ids.tobytes()), len(ids), 0
                while start < n:
                    sequence, offset = divmod(position, length)
                    size = min(length - offset, n - start)
                    rows.append((doc_id, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, sequence, offset, ids[start : start + size] if with_ids else None))
                    start, position = start + size, position + size
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=_PIECES[: len(kinds)])

    return run


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _cell(bits: int) -> Column:
    """The first ``bits`` bits of the key."""
    return F.shiftright("key", CURVE_DIMS * CURVE_BITS - bits)


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    spark = docs.sparkSession
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(docs["doc_id"], text).alias("tie"))
    tokens = stored(rows.mapInArrow(tidy(_tokenise(path)), "doc_id long, tie long, key long, tokens long, ids binary"), "tokens")
    tasks = shuffle_partitions(spark)
    key_bits, leaves, part, most = CURVE_DIMS * CURVE_BITS, [], tokens, None
    for bits in range(CELL_BITS, key_bits + 1, FINER_BITS):
        # At most 2**CELL_BITS rows, then 2**FINER_BITS for each heavy cell, of which there are fewer than 4 * tasks.
        counted = part.groupBy(_cell(bits).alias("cell")).agg(F.sum("tokens")).collect()
        if most is None:
            most = min(MOST_BUCKET, max(LEAST_BUCKET, math.ceil(sum(n for _, n in counted) / (4 * tasks))))
        heavy = [(c,) for c, n in counted if n > most and bits < key_bits]
        leaves += [(c << key_bits - bits, bits, c, n) for c, n in counted if n <= most or bits == key_bits]
        if not heavy:
            break
        part = tokens.join(F.broadcast(spark.createDataFrame(heavy, "heavy long")), _cell(bits) == F.col("heavy"), "left_semi")
    plan, bucket, filled = {}, 0, 0
    for _, bits, c, n in sorted(leaves):
        if filled and filled + n > most:
            bucket, filled = bucket + 1, 0
        parts = max(1, math.ceil(n / most))
        plan.setdefault(bits, []).append((c, bucket, parts))
        bucket, filled = bucket + parts - 1, filled + n if parts == 1 else most
    dealt = tokens.select("*", F.lit(None).cast("int").alias("bucket"), F.lit(1).alias("parts"))
    for bits, cells in plan.items():
        found = F.broadcast(spark.createDataFrame(cells, "cell long, own int, own_parts int"))
        dealt = dealt.join(found, _cell(bits) == F.col("cell"), "left")
        dealt = dealt.withColumn("bucket", F.coalesce("own", "bucket")).withColumn("parts", F.coalesce("own_parts", "parts")).drop("cell", "own", "own_parts")
    range_ = F.least(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1)
    dealt = dealt.withColumn("bucket", F.col("bucket") + range_.cast("int")).drop("parts")
    sums = dealt.groupBy("bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sums.select("bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")), "bases")  # one row for each bucket
    parts = max(tasks, math.ceil((bucket + 1) / BUCKETS_A_TASK))
    placed = dealt.join(small(bases, 24), "bucket").repartitionById(parts, F.floor(F.col("bucket").cast("long") * parts / (bucket + 1)).cast("int"))
    kinds = ["long"] * 7 + ["array<int>"] * with_ids
    schema = ", ".join(f"{n} {k}" for n, k in zip(_PIECES, kinds, strict=False))
    return placed.sortWithinPartitions("bucket", "key", "tie", "doc_id").select("doc_id", "bucket", "base", "tokens", "ids").mapInArrow(tidy(_cut(length, with_ids)), schema)
