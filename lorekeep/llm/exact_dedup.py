"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each scan partition (a sender) hashes its normalised texts once. It sorts the distinct
   fingerprints, splits them by owner (a range of fingerprints) and sends every owner one
   Golomb-Rice coded list.
2. An owner decodes its lists and answers each sender with a bitmap: which of its fingerprints
   other senders hold as well.
3. The sender's ledger turns bitmaps and its own repeats into suspect documents. Only suspects'
   texts are shuffled, and they are grouped by their bytes, so a fingerprint that two texts share
   costs time but no correctness.
4. Rows find their group by the text's SHA-256, which the byte groups have shown to stand for one
   text; should two texts ever have one digest, the job fails and names that.

Skew: a text repeated by a third of all rows is one fingerprint for each sender and, as its bytes
are combined before the shuffle, one row of each scan task. Groups that hold more than 1 / HOT_GROUPS of
the suspect rows are fewer than HOT_GROUPS and go to their rows by broadcast, so rows of one text
don't meet.

Defined results: null text counts as empty, and empty texts equal each other. Only A-Z are
lower-cased. Of rows with the same text and the same largest doc_id, one stays. A null doc_id ranks
below all others. An empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import shuffle_partitions, small, stored, text_of

#: Bits of the exchanged fingerprints. Fewer bits make shorter messages and more false suspects.
FINGERPRINT_BITS = 40
#: Fingerprints for one owner, about.
OWNER_ROWS = 4_000_000
#: Groups of more than this share of the suspect rows (1 / HOT_GROUPS) are joined by broadcast.
HOT_GROUPS = 1000
#: Stands for a null doc_id in packed ledgers; a real id of this value is suspected along with it.
NO_ID = -(2**63)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FIRST = "kind int, sender int, owner int, doc_id long, sha binary, parameter int, code binary, counts binary, ids binary"


def rice_encode(values: np.ndarray, universe: int) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct ``values`` below ``universe``: the parameter, and the
    unary quotients of the gaps followed by their binary remainders."""
    n = len(values)
    k = max(0, int(np.log2(max(1.0, universe / max(1, n)))))
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotients, rest = gaps >> k, gaps & ((1 << k) - 1)
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    bits = ((rest[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, np.uint32(n).tobytes() + np.packbits(np.concatenate([unary, bits.ravel()])).tobytes()


def rice_decode(k: int, code: bytes) -> np.ndarray:
    """The values that rice_encode was given."""
    n = int(np.frombuffer(code[:4], np.uint32)[0])
    bits = np.unpackbits(np.frombuffer(code[4:], np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1 if n else 0
    rest = bits[start : start + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum((quotients << k) + rest + 1) - 1


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        prints, ids = [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            normal = [t.translate(_LOWER) for t in texts]
            prints.append(np.fromiter((xxhash.xxh3_64_intdigest(t) for t in normal), np.uint64, len(normal)))
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
            yield _rows(len(normal), kind=0, sender=sender, doc_id=batch.column("doc_id"), sha=[hashlib.sha256(t).digest() for t in normal])
        if prints:
            prints, ids = np.concatenate(prints) >> np.uint64(64 - FINGERPRINT_BITS), np.concatenate(ids)
            order = np.argsort(prints, kind="stable")
            values, counts = np.unique(prints, return_counts=True)
            ids, ends = ids[order], np.cumsum(counts)
            owner = (values * np.uint64(owners) >> np.uint64(FINGERPRINT_BITS)).astype(np.int64)
            for o in np.unique(owner):
                a, b = np.searchsorted(owner, [o, o + 1])
                k, code = rice_encode(values[a:b], 1 << FINGERPRINT_BITS)
                packed = ids[ends[a] - counts[a] : ends[b - 1]]
                yield _rows(1, kind=1, sender=sender, owner=int(o), parameter=k, code=[code], counts=[counts[a:b].astype(np.int32).tobytes()], ids=[packed.tobytes()])

    return run


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "sender": pa.int32(), "owner": pa.int32(), "doc_id": pa.int64(), "sha": pa.binary(), "parameter": pa.int32(), "code": pa.binary(), "counts": pa.binary(), "ids": pa.binary()}
    arrays = []
    for name, kind in kinds.items():
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else pa.array([value] * n, kind) if isinstance(value, int) else pa.array(value, kind) if isinstance(value, list) else value.cast(kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps for one owner's messages: fingerprints that at least two senders hold."""
    lists = [rice_decode(k, c) for k, c in zip(messages["parameter"], messages["code"], strict=True)]
    values, held = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[held > 1]
    maps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": messages["sender"], "owner": messages["owner"], "bitmap": maps})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.int32)
            shared = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8), count=len(counts)).astype(bool)
            found.append(np.frombuffer(row["ids"], np.int64)[np.repeat(shared | (counts > 1), counts)])
        ids = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        plain = pa.array(ids, pa.int64())
        if len(ids) and ids[0] == NO_ID:
            plain = pa.concat_arrays([plain, pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([plain], names=["suspect"])


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        normal = [t.translate(_LOWER) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(normal, pa.binary()), pa.array([hashlib.sha256(t).digest() for t in normal], pa.binary())], names=["doc_id", "normal", "sha"])


def _owners(docs: DataFrame, rows: int) -> int:
    """Owners that get about OWNER_ROWS fingerprints each, and no fewer than shuffle partitions."""
    return max(shuffle_partitions(docs.sparkSession), -(-rows // OWNER_ROWS))


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    owners = owners or _owners(docs, docs.count())
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    first = stored(rows.mapInArrow(_send(owners), _FIRST), "fingerprints")
    messages = first.filter("kind = 1")
    bitmaps = messages.select("sender", "owner", "parameter", "code").groupBy("owner").applyInPandas(_answer, "sender int, owner int, bitmap binary")
    ledger = messages.select("sender", "owner", "counts", "ids")
    suspects = stored(ledger.join(bitmaps, ["sender", "owner"]).select("counts", "ids", "bitmap").mapInArrow(_suspects, "suspect long").distinct(), "suspects")
    marked = small(suspects, 16)

    texts = rows.join(marked, rows["doc_id"].eqNullSafe(marked["suspect"]), "left_semi").mapInArrow(_normalise, "doc_id long, normal binary, sha binary")
    by_text = texts.groupBy("sha", "normal").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = by_text.groupBy("sha").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    groups = stored(groups.select("sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256"))).alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0

    digests = first.filter("kind = 0").select("doc_id", "sha")
    copies = digests.join(marked, digests["doc_id"].eqNullSafe(marked["suspect"]), "left_semi").groupBy("sha", "doc_id").agg(F.count("*").alias("copies"))
    hot = F.col("group_size") * HOT_GROUPS > total
    # Fewer than HOT_GROUPS groups can each hold that share of the rows.
    large = F.broadcast(groups.filter(hot).withColumnRenamed("sha", "large"))
    in_large = copies.join(large, copies["sha"] == large["large"]).drop("large")
    in_small = copies.join(large, copies["sha"] == large["large"], "left_anti").join(small(groups.filter(~hot), 64), "sha")
    verified = in_large.unionByName(in_small).select("doc_id", "keep_id", "group_size", "sha", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    unique = digests.join(marked, digests["doc_id"].eqNullSafe(marked["suspect"]), "left_anti")
    unique = unique.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha", F.lit(1).cast("long").alias("copy"))
    return verified.unionByName(unique).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
