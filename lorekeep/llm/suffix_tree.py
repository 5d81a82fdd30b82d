"""Language-model scores by a probabilistic suffix tree over words.

A text is its words (maximal runs without blanks, A-Z lower-cased) and one end. The tree's root is the
smoothed frequency of the training words. A context of d words is tested if the training texts hold it
``least_context`` times, its last d - 1 words are a state and its first d - 1 words were tested; it becomes a state if its
next words differ from those of the context without its first word: the likelihood-ratio statistic T * KL(own || shorter), over the words seen ``least_pair`` times
after it and the rest as one class, must reach k ln(N) / 2 for k such words and N training tokens (the Bayesian
information criterion). With T occurrences, of which B go to the k words, a state gives
P(w | state) = (n(w) + (T - B + k) P(w | shorter)) / (T + k), which sums to one whenever the shorter one does. A word is
scored by the longest state that ends where it begins.

That log probability is a sum: the root's, plus for each state on the way to the longest one the log of
(T - B + k) / (T + k), plus, where the word was seen after it, what that adds. So the model is one table of key and value,
and a text's score the sum of the values of its keys; no context has to be looked up before another one.

Counting is one pass over the training texts a level: tasks count the pairs of the slices of their texts together, as many as
``HELD_PAIRS`` allow, which are dealt by context (by word for the at most 1024 contexts that hold 1/1024 of all tokens) into
parts of bounded size, in rows of arrays that name a word once, and added; the first levels, which have most pairs, in ``SHARES``
of the parts. Every pass skips
what an earlier level ruled out, contexts and next words alike, by bitmaps of fixed size whose false hits are removed by
exact joins: a word that follows a context often follows the shorter one often.
Scoring looks up the at most ``HOT`` most frequent keys in a broadcast array; of the others those that the bitmap may
hold meet the rest of the model, which is dealt by the keys' first bits into parts of some ``PART_KEYS`` keys. A slice of texts asks
a part in one row of arrays, is answered in one, with a sum for each text, and adds its answers up. The bitmap and the array don't
grow with the data; counts and the model are never sent whole. What is asked does grow, up to seven keys a token, so texts are
scored in ``ROUNDS`` shares by a hash, and shuffle files go when a share is done: disk holds one share's keys at a time.

Words, contexts and pairs are known by 64-bit hashes; with 10^9 of them some 0.03 are expected to share one.

Defined cases: a null text is an empty one, which holds its end alone; without training texts all probabilities are 1
(log 0); a null id is not held out; rows that repeat an id are texts of their own. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lorekeep.llm.common import discard, slices, small, stored, text_of, tidy
from lorekeep.llm.words import BLANKS, hashed_words, joined, table_of

#: Words in a context at most, and the occurrences that contexts and pairs need to be looked at.
DEPTH, LEAST_CONTEXT, LEAST_PAIR = 3, 16, 4
#: Bits of the bitmaps, as a power of two, and keys in the broadcast array at most.
BITMAP_BITS, HOT = 27, 1 << 20
#: A context with this share of all tokens is dealt by its next word; pairs are dealt into so many parts, or more for more tokens than so many a part.
HEAVY, PARTS, PART_TOKENS = 1 / 1024, 128, 1 << 23
#: Pairs in a row of arrays at most, as places in it are 16-bit.
BLOCK = 1 << 15
#: Keys of the model, on average, that meet the texts' keys in one group.
PART_KEYS = 1 << 18
#: Bytes of text that are looked at together, half as many where pairs are counted, and pairs that a task then gathers from its slices.
COUNT_BYTES, HELD_PAIRS = 8 << 20, 1 << 21
#: Pairs that are sorted by context and given to Spark together.
GIVEN_PAIRS = 1 << 18
#: Shares of the parts that a level (1 if it isn't named) counts one after the other, and of the texts that are scored so if the model's parts must be asked.
SHARES, ROUNDS = {1: 2, 2: 2}, 4
#: Spark's setting by which the shuffle files of a query go at its end, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a word in a state's own key; the words are hashes.
STATE = -1
#: Columns of the pairs that a slice gives to a part: distinct contexts and words, and of each pair their places and how often it was seen.
PAIRS = pa.schema([("part", pa.int64()), ("contexts", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("context_at", pa.list_(pa.int16())), ("word_at", pa.list_(pa.int16())), ("n", pa.list_(pa.int32()))])
#: Columns of what a slice asks of a part (texts from ``slice`` on, keys, how often), or of a text's own row; and of the answers (a sum and words
#: known for each text that has any), or of a text's own row. A slice is known by its first text's number.
_OWN = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())]
ASKED = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("row", pa.int64()), ("is_word", pa.bool_()), ("at", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), *_OWN])
SUMS = pa.schema([("slice", pa.int64()), ("row", pa.int64()), ("is_word", pa.bool_()), ("at", pa.list_(pa.int32())), ("amount", pa.list_(pa.float64())), ("n", pa.list_(pa.int32())), *_OWN])
#: The end of a text: the hash of the empty word.
END = xxhash.xxh64_intdigest(b"", 42)


@contextlib.contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run meanwhile go at each one's end."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BITMAP_BITS)


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of a table's ``key`` by its first BITMAP_BITS bits: of one size, whatever the table's."""
    at = _bit(F.col("key")) + 1  # the functions count from 1
    dealt = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).repartition("bucket")
    blocks = dealt.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("block")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for bucket, block in zip(blocks["bucket"].to_pylist(), blocks["block"].to_pylist(), strict=True):
        bits[(bucket - 1) * 4096 :][: len(block)] = np.frombuffer(block, np.uint8)[: len(bits)]
    return bits


def _within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


@dataclass
class _Tokens:
    """The tokens of a slice of texts: their hashes, texts and places in their text, and the texts' sizes."""

    hashes: np.ndarray
    text: np.ndarray
    place: np.ndarray
    sizes: np.ndarray

    def contexts(self, depth: int) -> Iterator[np.ndarray]:
        """The key of the 1, 2, ... words before each token. Where a text has fewer, the key is meaningless (see place)."""
        before = np.roll(self.hashes, 1)
        found = before
        for level in range(1, depth + 1):
            if level > 1:
                found = joined(np.roll(found, 1), before)
            yield found


def _tokens(texts: pa.Array, table: np.ndarray) -> _Tokens:
    hashes, ends = hashed_words(texts, table)
    hashes = np.insert(hashes, ends, np.uint64(END))  # each text's end after its words
    sizes = np.diff(ends, prepend=0) + 1
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(hashes), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    return _Tokens(hashes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), place, sizes)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 5; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = table_of(BLANKS)
    for batch in slices(batches, limit=COUNT_BYTES):
        keys, n = np.unique(_tokens(batch.column("text"), table).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n.astype(np.int64))], ["key", "n"])


def _count_pairs(level: int, parts: int, share: int, shares: int, bits: Broadcast, lower: Broadcast, heavy: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The next words of the contexts of ``level`` words that the bitmap may hold, if ``lower`` may hold them after the shorter context.

    Of the parts, those whose number leaves ``share`` on division by ``shares``."""

    def part_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (np.where(np.isin(context, heavy.value), word, context) % np.uint64(parts)).astype(np.int64)

    def pairs(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, shorter = _tokens(texts, table), None
        for n, context in enumerate(found.contexts(level), 1):
            if n == level:
                at = np.flatnonzero((found.place >= level) & _within(bits.value, context))
            else:
                shorter = context
        if shares > 1:
            at = at[part_of(context[at], found.hashes[at]) % shares == share]
        at = at[_within(lower.value, found.hashes[at] if shorter is None else joined(shorter[at], found.hashes[at]))]
        return _merged([(context[at], found.hashes[at], np.ones(len(at), np.int32))])

    def given(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = part_of(context, word)
        order = np.argsort(part, kind="stable")
        for start in range(0, len(order), GIVEN_PAIRS):
            at = order[start : start + GIVEN_PAIRS]
            at = at[np.lexsort((context[at], part[at]))]
            yield _blocks(part[at], context[at], word[at], n[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = table_of(BLANKS), []
        for batch in slices(batches, limit=max(1, COUNT_BYTES // 2)):
            held.append(pairs(batch.column("text"), table))
            if sum(len(x[0]) for x in held) > HELD_PAIRS:
                held = [_merged(held)]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield from given(*held.pop())
        if held:
            yield from given(*_merged(held))

    return tidy(run)


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and how often they were seen: each pair once."""
    context, word, n = (np.concatenate([x[i] for x in held]) for i in range(3))
    key = joined(context, word)
    order = np.argsort(key)
    starts = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]]) if len(key) else np.zeros(0, np.int64)
    first = order[starts]
    return context[first], word[first], np.add.reduceat(n[order], starts).astype(np.int32) if len(key) else n


def _blocks(part: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Pairs in order of part and context as PAIRS, a row for each part, or more for more than BLOCK pairs."""
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    cut = (np.arange(len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part))))) % BLOCK == 0
    begins, block = np.flatnonzero(cut), np.cumsum(cut) - 1

    def named(order: np.ndarray, x: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The distinct values of each block, and each value's place among them; ``order`` has equal ones of a block side by side."""
        fresh = cut.copy()  # blocks begin at the same places in any order within them
        fresh[1:] |= x[order][1:] != x[order][:-1]
        number = np.cumsum(fresh) - 1
        place = np.empty(len(x), np.int16)
        place[order] = number - number[begins][block]
        return pa.ListArray.from_arrays(pa.array(np.append(number[begins], number[-1] + 1).astype(np.int32)), _signed(x[order][fresh])), ends(pa.array(place))

    def ends(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(begins, len(part)).astype(np.int32)), values)

    contexts, context_at = named(np.arange(len(context)), context)
    words, word_at = named(np.lexsort((word, block)), word)
    return pa.RecordBatch.from_arrays([pa.array(part[begins]), contexts, words, context_at, word_at, ends(pa.array(n.astype(np.int32)))], schema=PAIRS)


def _adding(least: int) -> Callable[[pa.Table], pa.Table]:
    """The pairs of a part that are seen ``least`` times, with how often."""

    def run(blocks: pa.Table) -> pa.Table:
        columns = {c: blocks[c].combine_chunks() for c in PAIRS.names[1:]}
        flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in columns.items()}
        sizes = {c: pc.list_value_length(x).to_numpy(zero_copy_only=False) for c, x in columns.items()}
        context, word = (flat[c][np.repeat(np.cumsum(sizes[c]) - sizes[c], sizes["n"]) + flat[at]] for c, at in (("contexts", "context_at"), ("words", "word_at")))
        key = joined(context.view(np.uint64), word.view(np.uint64))
        order = np.argsort(key)
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        n = np.add.reduceat(flat["n"][order].astype(np.int64), starts)
        kept = order[starts[n >= least]]
        return pa.table({"context": context[kept], "word": word[kept], "n": n[n >= least]})

    return run


@dataclass
class Model:
    """``table`` (key, value, weight) with all words, states and pairs; ``tokens`` and ``distinct`` of the training texts."""

    table: DataFrame
    tokens: int
    distinct: int

    @property
    def unknown(self) -> float:
        """log10 of the probability of a word that no training text holds, at the root."""
        return math.log10(0.5 / (self.tokens + 0.5 * (self.distinct + 1)))


def _tested(pairs: DataFrame, tokens: int) -> DataFrame:
    """context, times, share: the contexts that are states, and the part of their probability that the shorter context deals out."""
    n, low, times = F.col("n"), F.col("low"), F.col("times")
    sums = pairs.groupBy("context", "times").agg(F.sum(n * F.ln(n / low)).alias("gain"), F.sum("n").alias("seen"), F.sum("low").alias("expected"), F.count("*").alias("k"))
    rest = times - F.col("seen")
    other = F.when(rest > 0, rest * F.ln(rest / (times * F.greatest(1 - F.col("expected"), F.lit(1e-12))))).otherwise(0.0)
    divergence = F.col("gain") - F.col("seen") * F.ln(times) + other
    return sums.filter(divergence >= F.col("k") * (math.log(max(tokens, 2)) / 2)).select("context", "times", ((rest + F.col("k")) / (times + F.col("k"))).alias("share"), (times + F.col("k")).alias("weight"))


def _ruling(candidates: DataFrame, lower: DataFrame, tokens: int) -> list[Broadcast]:
    """What a pass over the texts needs to skip what can't matter."""
    context = candidates.sparkSession.sparkContext
    heavy = candidates.filter(F.col("times") >= max(1.0, tokens * HEAVY)).select("key").toArrow()["key"].to_numpy()  # at most 1 / HEAVY
    return [context.broadcast(x) for x in (bitmap(candidates), bitmap(lower), heavy.view(np.uint64))]


def _pairs(texts: DataFrame, level: int, tokens: int, sent: list[Broadcast], share: int = 0, shares: int = 1) -> DataFrame:
    return texts.mapInArrow(_count_pairs(level, max(PARTS, tokens // PART_TOKENS), share, shares, *sent), from_arrow_schema(PAIRS))


def pairs_of(texts: DataFrame, level: int, candidates: DataFrame, lower: DataFrame, tokens: int) -> tuple[DataFrame, list[Broadcast]]:
    """Rows of PAIRS: the words after the contexts ``candidates`` (key, times) that ``lower`` (key) holds after the shorter context, and few others.

    The broadcasts are in use until the rows are read."""
    sent = _ruling(candidates, lower, tokens)
    return _pairs(texts, level, tokens, sent), sent


def fit(docs: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_pair: int = LEAST_PAIR) -> Model:
    """The suffix tree of all texts of ``docs`` (text), as a table of keys and values."""
    texts = docs.select(text_of(docs).alias("text"))
    vocabulary = stored(texts.mapInArrow(tidy(_count_words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    model = Model(vocabulary, tokens, distinct)
    known = F.log10((F.col("n") + 0.5) / (tokens + 0.5 * (distinct + 1)))
    parts = [vocabulary.select("key", (known - model.unknown).alias("value"), F.col("n").alias("weight"))]
    end = F.lit(int(np.uint64(END).astype(np.int64)))
    candidates = vocabulary.filter((F.col("n") >= least_context) & (F.col("key") != end)).select("key", F.col("n").alias("times"), F.lit(0).cast("long").alias("shorter"))
    lower = vocabulary.filter(F.col("n") >= least_pair)
    below = vocabulary.select(F.lit(0).cast("long").alias("shorter"), F.col("key").alias("word"), F.pow(F.lit(10.0), known).alias("low"))
    used = [vocabulary]
    for level in range(1, depth + 1):
        candidates = stored(candidates, f"candidates{level}")
        sent, shares = _ruling(candidates, lower, tokens), SHARES.get(level, 1)
        counted = [stored(_pairs(texts, level, tokens, sent, i, shares).groupBy("part").applyInArrow(_adding(least_pair), "context long, word long, n long"), f"counted{level}") for i in range(shares)]
        for x in sent:
            x.destroy()
        added = functools.reduce(DataFrame.unionByName, counted)
        priced = added.join(small(candidates.withColumnRenamed("key", "context"), 80), "context").join(small(below, 96).hint("shuffle_hash"), ["shorter", "word"])
        pairs = stored(priced, f"pairs{level}")
        discard(*counted)
        states = stored(_tested(pairs, tokens), f"states{level}")
        p = (F.col("n") + F.col("share") * F.col("weight") * F.col("low")) / F.col("weight")
        nexts = stored(pairs.join(small(states.drop("times"), 64), "context").select("context", "word", "n", "share", "low", p.alias("p")), f"nexts{level}")
        parts.append(states.select(F.xxhash64("context", F.lit(STATE).cast("long")).alias("key"), F.log10("share").alias("value"), F.col("times").alias("weight")))
        parts.append(nexts.select(F.xxhash64("context", "word").alias("key"), F.log10(F.col("p") / (F.col("share") * F.col("low"))).alias("value"), F.col("n").alias("weight")))
        # Contexts one word longer begin with one that was tested and end with a state.
        ending = F.col("word") if level == 1 else F.xxhash64("shorter", "word")
        longer = pairs.filter((F.col("n") >= least_context) & (F.col("word") != end)).select(F.xxhash64("context", "word").alias("key"), F.col("n").alias("times"), ending.alias("ending"))
        used += [candidates, pairs, states, nexts]
        candidates = longer.join(small(states.select(F.col("context").alias("ending")), 48), "ending", "left_semi").select("key", "times", F.col("ending").alias("shorter"))
        lower = nexts.select(F.xxhash64("context", "word").alias("key"))
        below = nexts.select(F.col("context").alias("shorter"), "word", F.col("p").alias("low"))
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    model.table = stored(parts[0], "model")
    discard(*used)
    return model


def _hottest(table: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None, int]:
    """Keys in order and values of the rows of greatest weight, at most ``most``: as many steps of weight as fit; the other rows (None: there are none), and their number."""
    step = F.floor(F.log2(F.col("weight")) * 8)
    sizes = table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # at most 8 * 64 rows
    least, own = None, 0
    for row, held in zip(sizes, itertools.accumulate(r["count"] for r in sizes), strict=True):
        if held > most:
            break
        least, own = row["step"], held
    rows = (table.filter(step >= least) if least is not None else table.limit(0)).select("key", "value").toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order, left = np.argsort(keys), sum(r["count"] for r in sizes) - own
    others = None if not left else table if least is None else table.filter(step < least)
    return (keys[order], rows["value"].to_numpy()[order]), others, left


def _score(depth: int, bits: Broadcast, hot: Broadcast, part_bits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the keys of each text that the broadcast array holds, and the keys, with counts, that have to be asked of the model's parts.

    ``part_bits`` are the first bits of a key that name its part; None: the array holds the whole model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = table_of(BLANKS), itertools.count(TaskContext.get().partitionId() << 33)

        def made(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in ASKED], schema=ASKED)

        def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Value (0 if unknown), whether the model may hold it, and whether a part must be asked."""
            value, may = np.zeros(len(keys)), _within(bits.value, keys)
            held, values = hot.value
            at = np.flatnonzero(may)
            place = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
            own = held[place] == keys[at] if len(held) else np.zeros(len(at), bool)
            value[at[own]] = values[place[own]]
            if part_bits is None:
                may[at[~own]] = False
                return value, may, np.zeros(len(keys), bool)
            cold = may.copy()
            cold[at[own]] = False
            return value, may, cold

        for batch in slices(batches, limit=COUNT_BYTES):
            found, n = _tokens(batch.column("text"), table), batch.num_rows
            value, may, cold = look(found.hashes)
            base = np.bincount(found.text, weights=value, minlength=n)
            known = np.bincount(found.text, weights=may & ~cold, minlength=n).astype(np.int64)
            gain, later = np.zeros(n), [(1, found.text[cold], found.hashes[cold])]
            at = np.arange(len(found.hashes))
            for level, keys in enumerate(found.contexts(depth), 1):
                at = at[found.place[at] >= level]
                context = keys[at]
                for word in (np.uint64(STATE % 2**64), None):
                    asked = joined(context, found.hashes[at] if word is None else word)
                    value, may, cold = look(asked)
                    gain += np.bincount(found.text[at], weights=value, minlength=n)
                    later.append((0, found.text[at[cold]], asked[cold]))
                    if word is not None:
                        at, context = at[may], context[may]  # a longer context is a state only if this one is
            rows = np.fromiter(itertools.islice(first, n), np.int64, n)
            own = {"slice": np.full(n, rows[0]), "row": rows, "n_tokens": found.sizes.astype(np.int64), "known": known, "base": base, "gain": gain, "part": rows % (1 << (part_bits or 0))}
            yield made(n, {k: pa.array(v) for k, v in own.items()} | {c: batch.column(c) for c in ("doc_id", "held_out")})
            for is_word in (1, 0):
                text, key = (np.concatenate([x[i] for x in later if x[0] == is_word]) for i in (1, 2))
                if not len(key):
                    continue
                part = (key >> np.uint64(64 - part_bits)).astype(np.int64)
                order = np.lexsort((key, text, part))
                text, key, part = text[order], key[order], part[order]
                starts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])])
                counts, text, key, part = np.diff(np.append(starts, len(key))).astype(np.int32), text[starts], key[starts], part[starts]
                begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ends = pa.array(np.append(begins, len(part)).astype(np.int32))
                lists = {"at": pa.array(text), "keys": _signed(key), "n": pa.array(counts)}
                scalars = {"part": part[begins], "slice": np.full(len(begins), rows[0]), "is_word": np.full(len(begins), bool(is_word))}
                yield made(len(begins), {k: pa.ListArray.from_arrays(ends, v) for k, v in lists.items()} | {k: pa.array(v) for k, v in scalars.items()})

    return tidy(run)


def _answered(asked: pa.Table, part: pa.Table) -> pa.Table:
    """The answers of a part of the model (part, key, value), a row for each one that asks, and the texts' own rows as they are."""
    whole = asked["keys"].is_null()
    own, blocks = asked.filter(whole), asked.filter(pc.invert(whole))
    keys, n, at = (blocks[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("keys", "n", "at"))
    block = np.repeat(np.arange(len(blocks)), pc.list_value_length(blocks["keys"]).to_numpy())
    held, values = part["key"].to_numpy(), part["value"].to_numpy()
    order = np.argsort(held)
    held, values = held[order], values[order]
    place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    hit = np.flatnonzero(held[place] == keys) if len(held) else np.zeros(0, np.int64)
    block, at, n, place = block[hit], at[hit], n[hit], place[hit]
    starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (at[1:] != at[:-1])]) if len(hit) else hit  # a row's keys are in order of their texts
    sums, counts = (np.add.reduceat(x, starts) if len(hit) else x for x in (n * values[place] if len(hit) else np.zeros(0), n))
    ends = np.searchsorted(block[starts], np.arange(len(blocks) + 1)).astype(np.int32)
    lists = {c: pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for c, x in (("at", at[starts].astype(np.int32)), ("amount", sums), ("n", counts.astype(np.int32)))}
    found = pa.Table.from_arrays([lists[f.name] if f.name in lists else blocks[f.name] if f.name in ("slice", "is_word") else pa.nulls(len(blocks), f.type) for f in SUMS], schema=SUMS)
    own = pa.Table.from_arrays([own[f.name].cast(f.type) if f.name in ASKED.names and f.name not in lists else pa.nulls(len(own), f.type) for f in SUMS], schema=SUMS)
    return pa.concat_tables([own, found.filter(np.diff(ends) > 0)])


def _added(sums: pa.Table) -> pa.Table:
    """A slice's texts with the sums of all answers to it."""
    whole = sums["at"].is_null()
    own, answers = sums.filter(whole), sums.filter(pc.invert(whole))
    at, amount, n = (answers[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "amount", "n"))
    is_word = np.repeat(answers["is_word"].to_numpy(), pc.list_value_length(answers["at"]).to_numpy()).astype(bool)
    place = own["row"].to_numpy() - own["slice"].to_numpy()
    more = {"known": n * is_word, "base": amount * is_word, "gain": amount * ~is_word}
    more = {c: np.bincount(at, x, len(own))[place] for c, x in more.items()}
    return pa.table({c: pa.array((own[c].to_numpy() + more[c]).astype(t.to_pandas_dtype())) if c in more else own[c] for c, t in _OWN}, schema=pa.schema(_OWN))


def _asking(table: DataFrame, depth: int) -> tuple[Callable[[DataFrame], DataFrame], DataFrame | None]:
    """What makes rows of ASKED of texts, and the model's rows that the broadcast array doesn't hold with their part, or None if it holds all."""
    context = table.sparkSession.sparkContext
    hot, others, left = _hottest(table, HOT)
    part_bits = max(1, math.ceil(math.log2(max(left / PART_KEYS, 1)))) if left else None
    sent = context.broadcast(bitmap(table)), context.broadcast(hot)

    def ask(docs: DataFrame) -> DataFrame:
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text_of(docs).alias("text"))
        return texts.mapInArrow(_score(depth, *sent, part_bits), from_arrow_schema(ASKED))

    return ask, None if others is None else others.select(F.shiftrightunsigned("key", 64 - part_bits).alias("part"), "key", "value")


def asked(docs: DataFrame, table: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """A row for each text with its sums over the keys of the broadcast array, and one for each slice of texts and part of the
    model (see ASKED); the model's other rows with their part, or None if the array holds all."""
    ask, others = _asking(table, depth)
    return ask(docs), others


def answered(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of SUMS: the texts' own rows, and a row for each slice and part that it asked with success."""
    return rows.groupBy("part").cogroup(others.groupBy("part")).applyInArrow(_answered, from_arrow_schema(SUMS))


def score(docs: DataFrame, model: Model, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``base_score`` is the root's log10 probability of the text, ``score`` the tree's; ``n_known`` counts tokens of training texts.
    A text's own row goes with the keys that its slice asks for, to a part that spreads such rows, so its words are read once."""
    with _freeing(docs.sparkSession):
        ask, others = _asking(model.table, depth)
        if others is None:
            rows = ask(docs)
        else:
            share = F.pmod(F.xxhash64(docs["doc_id"].cast("long"), text_of(docs)), F.lit(ROUNDS))
            summed = (answered(ask(docs.filter(share == i)), others).groupBy("slice").applyInArrow(_added, from_arrow_schema(pa.schema(_OWN))) for i in range(ROUNDS))
            rows = functools.reduce(DataFrame.unionByName, [stored(x, "scores") for x in summed])
    base = F.col("n_tokens") * model.unknown + F.col("base")
    return rows.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_pair: int = LEAST_PAIR) -> DataFrame:
    """All texts scored by the tree of those that aren't held out."""
    with _freeing(docs.sparkSession):
        model = fit(docs.filter(~held_out(docs["doc_id"])), depth, least_context, least_pair)
    return score(docs, model, depth)
