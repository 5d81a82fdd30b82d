"""Mixing sources to target weights, by blocks of tokens.

Each source's documents form one stream of tokens (words here), in an order that a hash decides.
The stream is cut into blocks of BLOCK words, of the same length for all sources. A source's quota is
the number of blocks that makes its target. Output shards of SHARD_SLOTS slots draw how many of their
slots each source gets: multinomial draws under the condition that all shards together meet the
quotas, which are multivariate hypergeometric. The range of shards is halved again and again; a
generator seeded by the range draws what goes to its left half, so every task draws the shards it
makes, and no draw is left out. The slots a source gets are numbered; a pseudorandom permutation of
the source's block numbers (a Feistel network, another one for each pass over the source) maps slots
to blocks. Slots and documents' blocks are then joined by block number.

A target is at most twice its source, so the slots of a source are at most two passes, and no
document is taken more than twice. Everything depends on ids, texts and the seed only: reruns agree.

Skew: positions within a source are two-level prefix sums over chunks of bounded size, so one source
may hold any share of the rows, and repeated rows are one row until they have their positions; slots
and blocks are joined by (source, block). The driver and each task hold 24 bytes for each source.

Defined results: null text has size 0. The null source is a source, the last one. A document of size
0 takes 0. Rows that repeat are documents of their own. An empty table gives no rows. Other columns
are not read by ``mix``; ``mixed_documents`` returns them as they are, under any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import mix64, row_tie, shuffle_partitions, slices, stored, text_of, tidy

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words in a block, slots in a shard.
BLOCK, SHARD_SLOTS, SEED = 32, 4096, 5
CHUNK_ROWS = 50_000
#: The most slots that numpy's hypergeometric draws take.
MOST_DRAWN = 10**9 - 1

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def running_total(df: DataFrame, key: str, chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same key before each row; ``chunk`` ascends with ``order``."""
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, chunk, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(bases, [key, chunk]).withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__base")


def targets(sizes: DataFrame) -> DataFrame:
    """sid, source, source_size, target of each source: a share by weight, at most MOST times the source.

    Water level: a source is full if, at the level at which it fills, the sum of all does not exceed
    the total. One row for each source."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1).cast("double")
    rows = rows.withColumn("sid", place).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    everything = Window.partitionBy()
    rows = rows.withColumn("level", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything) * SHARE)
    upto = Window.orderBy("level", "sid").rowsBetween(Window.unboundedPreceding, 0)
    at_level = F.sum("cap").over(upto) + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(upto))
    rows = rows.withColumn("full", at_level <= F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return rows.select("sid", "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * left / open_)).alias("target"))


def permuted(t: np.ndarray, blocks: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Block of slot t: within each pass over a source, a permutation of its block numbers."""
    with np.errstate(over="ignore"):
        key = mix64(source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64((t // blocks).astype(np.uint64) + np.uint64(SEED)))
        bits = np.array([max(1, (int(b - 1).bit_length() + 1) // 2) for b in blocks.tolist()], np.uint64)
        mask, x = (np.uint64(1) << bits) - np.uint64(1), (t % blocks).astype(np.uint64)
        todo = np.arange(len(t))
        while len(todo):  # cycle walking: until the number falls among the blocks again
            left, right = x[todo] >> bits[todo], x[todo] & mask[todo]
            for turn in range(4):
                left, right = right, left ^ (mix64(right + key[todo] + np.uint64(turn)) & mask[todo])
            x[todo] = (left << bits[todo]) | right
            todo = todo[x[todo] >= blocks[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _left_half(quotas: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many of ``n`` slots, drawn from sum(quotas) without replacement, each source gets."""
    draw, total = np.random.default_rng(seed), int(quotas.sum())
    if total <= MOST_DRAWN:
        return draw.multivariate_hypergeometric(quotas, n, method="marginals")
    # Of so many slots a draw strays from its mean by less than 1e-4 of it: systematic sampling strays by one slot.
    marks = np.floor(np.cumsum(quotas) * (n / total) + draw.random()).astype(np.int64)
    marks[-1] = n
    return np.minimum(np.diff(marks, prepend=0), quotas)


def shard_counts(quotas: np.ndarray, low: int, high: int, slots: int = SHARD_SLOTS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of shards low to high - 1: the shard, places of the sources that it takes, their first slot numbers, how many slots."""
    total = int(quotas.sum())

    def descend(a: int, b: int, at: np.ndarray, left: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, at, first, left
            return
        middle = (a + b) // 2
        own = _left_half(left, min(middle * slots, total) - a * slots, [SEED, a, b])
        for x, y, n, start in ((a, middle, own, first), (middle, b, left - own, first + own)):
            some = n > 0
            yield from descend(x, y, at[some], n[some], start[some])

    at = np.flatnonzero(quotas > 0)
    yield from descend(0, math.ceil(total / slots), at, quotas[at], np.zeros(len(at), np.int64))


def _slots(sids: np.ndarray, quotas: np.ndarray, blocks: np.ndarray):
    """From shard numbers to the blocks of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("id").to_numpy()
            for start in range(0, len(shards), 64):
                part = shards[start : start + 64]
                for shard, at, first, n in shard_counts(quotas, int(part[0]), int(part[-1]) + 1):
                    which = np.repeat(at, n)
                    slot = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                    block = permuted(slot, blocks[which], sids[which])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard)), pa.array(sids[which], pa.int32()), pa.array(slot), pa.array(block)], names=["shard", "sid", "slot", "block"])

    return run


def mapped_slots(sources: DataFrame) -> DataFrame:
    """shard, sid, slot, block of every slot. ``sources`` has sid, quota and blocks, a row for each source."""
    spark = sources.sparkSession
    given = sources.filter("quota > 0").select("sid", "quota", "blocks").orderBy("sid").collect()
    sids, quotas, blocks = (np.array([r[k] for r in given], np.int64) for k in range(3))
    shards = math.ceil(int(quotas.sum()) / SHARD_SLOTS)
    tasks = max(1, min(shards, max(shuffle_partitions(spark), shards // 4096)))
    return spark.range(0, shards, 1, tasks).mapInArrow(_slots(sids, quotas, blocks), "shard long, sid int, slot long, block long")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source, tie, size) with source figures and their positions in the source's
    stream, repeated ones with a number; slots with their blocks."""
    rows = docs.groupBy("doc_id", "source", "tie", "size").agg(F.count("*").alias("copies"))
    rows = stored(rows, "sizes")
    sources = targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    quota = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * MOST).cast("long")
    sources = stored(sources.withColumn("quota", F.when(F.col("source_size") > 0, quota).otherwise(0)), "sources")

    bits = max(0, math.ceil(math.log2(max(1, rows.count() / CHUNK_ROWS))))
    spread = F.xxhash64(F.lit(SEED), "doc_id", "tie")
    named = rows.join(sources.drop("quota", "blocks"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    named = named.withColumn("spread", spread).withColumn("chunk", F.shiftright("spread", 64 - bits) if bits else F.lit(0).cast("long"))
    placed = running_total(named, "sid", "chunk", [F.col("spread"), F.col("doc_id"), F.col("tie")], F.col("size") * F.col("copies"), "at")
    placed = placed.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).withColumn("at", F.col("at") + (F.col("copy") - 1) * F.col("size"))
    return placed.select("doc_id", "source", "tie", "copy", "size", "sid", "source_size", "target", "at"), mapped_slots(sources)


def _taken(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed documents, and which of their blocks' words are taken how often."""
    placed, mapped = _placed(docs)
    placed = stored(placed, "placed")
    # Stored, so that joins are planned by its size: of what Python makes of a range of shards Spark knows nothing.
    times = stored(mapped.groupBy("sid", "block").agg(F.count("*").alias("times")), "times")
    blocks = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK))))
    low = F.greatest(F.col("block") * BLOCK, F.col("at")) - F.col("at")
    high = F.least((F.col("block") + 1) * BLOCK, F.col("at") + F.col("size")) - F.col("at")
    parts = blocks.select("sid", "at", "block", low.alias("low"), high.alias("high")).join(times, ["sid", "block"])
    return placed, parts


def _sized(docs: DataFrame, tie: Column) -> list[Column]:
    text = text_of(docs)
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), tie.alias("tie"), size.alias("size")]


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    placed, parts = _taken(docs.select(*_sized(docs, row_tie(docs.select("doc_id", "text", "source")))))
    sums = parts.groupBy("sid", "at").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    kept = placed.filter("size > 0").join(sums, ["sid", "at"], "left").unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return kept.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of ``ranges`` (ascending, disjoint), with the white space between neighbours."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges)


def _merged(parts: list[dict], least: int) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for p in sorted(parts, key=lambda p: p["low"]):
        if p["times"] >= least:
            if found and found[-1][1] == p["low"]:
                found[-1] = (found[-1][0], p["high"])
            else:
                found.append((p["low"], p["high"]))
    return found


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, with those words as
    its text and the columns of ``docs``. A document whose words are all taken keeps its text."""
    sized = docs.select(F.struct("*").alias("doc"), *_sized(docs, row_tie(docs)))
    placed, parts = _taken(sized.drop("doc"))
    lists = parts.groupBy("sid", "at").agg(F.collect_list(F.struct("low", "high", "times")).alias("parts"))  # at most one document's blocks
    chosen = placed.filter("size > 0").join(lists, ["sid", "at"])
    key = ["tie", "id", "no_id", "copy"]  # rows that share a tie are alike in all columns that can be told apart
    chosen = chosen.select("tie", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("copy").cast("long").alias("copy"), "size", "parts")
    whole = sized.select("doc", "tie", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy(*key[:3]).orderBy("tie")).cast("long"))
    joined = whole.join(chosen, key).select("doc", "size", "parts")
    names = docs.columns
    at, lengths = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            flat = pa.RecordBatch.from_arrays([*whole.column("doc").flatten(), whole.column("size"), whole.column("parts")], names=[*map(str, range(len(names))), "size", "parts"])
            for batch in slices(iter([flat]), str(at), 1 << 20):
                rows, texts = [], []
                for i, (text, size, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (str(at), "size", "parts")), strict=True)):
                    for least in (1, 2):
                        if ranges := _merged(found, least):
                            rows.append(i)
                            texts.append(text if ranges == [(0, size)] else cut_words(text, ranges))
                kept = batch.take(pa.array(rows, pa.int64()))
                columns = [kept.column(str(i)) for i in range(len(names))]
                columns[at] = pa.array(texts, pa.string())
                if lengths is not None:
                    columns[lengths] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[lengths].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(tidy(run), docs.schema)
