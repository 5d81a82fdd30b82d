"""Vectors: products as columns, and the feature-hashing embedder."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSIONS, MIN_RELEVANCE = 256, 0.18
WORD_WEIGHT, GRAM_WEIGHT, PAIR_WEIGHT = 1.0, 0.35, 0.5


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 for vectors of different widths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a width differs or a vector is zero."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


_SPLIT, _WORDS = re.compile(r"[\W_]+"), re.compile(r"[^\W_]{2,}")
#: Words whose hashes are added up at once, and so few different ones that they are hashed one by one.
MOST_WORDS, FEW_WORDS = 1 << 15, 16


def _fnv(text: str, h: int = 0x811C9DC5) -> int:
    """32-bit FNV-1a over UTF-16 units, going on from ``h``."""
    if text.isascii():
        for unit in text.encode():
            h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
        return h
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h ^ (units[i] | units[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
    return h


@lru_cache(maxsize=50_000)
def _word(word: str) -> tuple[list[int], list[float], int]:
    """The hashes of a word and its trigrams, and a place for that of the pair which ends with it, with their weights; the hash of
    a pair which begins with it, up to the next word."""
    padded = f"^{word}$"
    grams = [_fnv(f"g:{padded[i : i + 3]}") for i in range(len(padded) - 2)]
    return [_fnv(f"w:{word}"), *grams, 0], [WORD_WEIGHT, *[GRAM_WEIGHT] * len(grams), PAIR_WEIGHT], _fnv(f"b:{word}_")


def _units(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-16 units of many words, and where those of each start and how many they are."""
    units = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if sizes.sum() < len(units):  # some characters are of two
        sizes = np.array([len(w) if w.isascii() else len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words])
    return units, np.cumsum(sizes) - sizes, sizes


def _fnv_of(units: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes of words, going on from ``h``: all by their first unit, then by their second, and so on."""
    most = int(sizes.max(initial=0))
    order = np.argsort(sizes.astype(np.uint16) if most < 1 << 16 else sizes, kind="stable")[::-1]  # short numbers are sorted without comparing
    starts, h = starts[order], h[order]
    left = len(sizes) - np.cumsum(np.bincount(sizes, minlength=most))[:most]  # words that have so many units
    for i, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ units[starts[:n] + i]) * np.uint32(0x01000193)
    found = np.empty_like(h)
    found[order] = h
    return found


def _next(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes going on by one character each."""
    high = points >= 0x10000
    if not high.any():
        return (h ^ points) * np.uint32(0x01000193)
    pair = points - np.uint32(0x10000)  # of two units
    first = (h ^ np.where(high, 0xD800 + (pair >> 10), points)) * np.uint32(0x01000193)
    return np.where(high, (first ^ (0xDC00 + (pair & 0x3FF))) * np.uint32(0x01000193), first)


def _hashed(words: list[str], units: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_word`` gives, for many words at once: sizes, and the hashes and weights of all; the hash that begins a pair."""
    if len(words) <= FEW_WORDS:
        hashes, weights, begins = zip(*map(_word, words), strict=True)
        sizes = np.array([len(h) for h in hashes])
        return sizes, np.fromiter(chain.from_iterable(hashes), np.uint32), np.fromiter(chain.from_iterable(weights), np.float64), np.array(begins, np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # A word of n characters has n trigrams when it is padded to n + 2, which leaves a place before them and one behind.
    points = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    h = np.zeros(len(points), np.uint32)
    h[1:-1] = _next(_next(_next(np.full(len(points) - 2, _fnv("g:"), np.uint32), points[:-2]), points[1:-1]), points[2:])
    single, begins = (_fnv_of(*units, np.full(len(words), _fnv(kind), np.uint32)) for kind in ("w:", "b:"))
    h[starts], h[ends - 1] = single, 0
    weights = np.full(len(h), GRAM_WEIGHT)
    weights[starts], weights[ends - 1] = WORD_WEIGHT, PAIR_WEIGHT
    return sizes, h, weights, (begins ^ np.uint32(ord("_"))) * np.uint32(0x01000193)


def _added(words: list[str], sizes: np.ndarray) -> np.ndarray:
    """A row for each text of its signed hashed counts, added in the order of the text; texts are runs of ``sizes`` words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if not known:
        return np.zeros((len(sizes), DIMENSIONS))
    units = _units(list(known))
    own, h, weights, begins = _hashed(list(known), units)
    starts = np.cumsum(own) - own
    component, amount = (h % DIMENSIONS).astype(np.int64), np.where(h >> 31, -weights, weights)
    # From words to where they stand: each takes the hashes of its word, of which the last is that of the pair it ends.
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    n = own[at]
    ends = np.cumsum(n)
    place = np.arange(ends[-1]) + np.repeat(starts[at] - ends + n, n)
    text = np.repeat(np.arange(len(sizes)), sizes)
    component, amount = component[place] + np.repeat(text * DIMENSIONS, n), amount[place]
    pairs = np.flatnonzero(text[1:] == text[:-1]) + 1
    second = at[pairs]
    pair = _fnv_of(units[0], units[1][second], units[2][second], begins[at[pairs - 1]])
    amount[ends - 1] = 0.0  # nothing comes before a text's first word
    component[ends[pairs] - 1] = pair % DIMENSIONS + text[pairs] * DIMENSIONS
    amount[ends[pairs] - 1] = np.where(pair >> 31, -PAIR_WEIGHT, PAIR_WEIGHT)
    return np.bincount(component, amount, len(sizes) * DIMENSIONS).reshape(-1, DIMENSIONS)


def hashed_vectors(texts: Iterable[str | None]) -> np.ndarray:
    """Signed hashed counts of words, their character trigrams and word pairs, at unit length, a row for each text.

    A hash's remainder is the component, its highest bit the sign. Texts are taken together up to MOST_WORDS words."""
    parts: list[np.ndarray] = []
    words: list[str] = []
    sizes: list[int] = []
    for text in texts:
        found = _WORDS.findall((text or "").lower())
        if sizes and len(words) + len(found) > MOST_WORDS:
            parts.append(_added(words, np.array(sizes)))
            words, sizes = [], []
        words += found
        sizes.append(len(found))
    parts.append(_added(words, np.array(sizes, np.int64)))
    vectors = np.concatenate(parts)
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    return vectors / np.where(length, length, 1.0)


def hashed_vector(text: str | None) -> list[float]:
    """The vector of one text."""
    return hashed_vectors([text])[0].tolist()


def _embed(texts: pa.Array) -> pa.Array:
    vectors = hashed_vectors(texts.to_pylist()).astype(np.float32)
    return pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, DIMENSIONS, dtype=np.int32), vectors.ravel())


#: The builtin embedder as a column. Spark would work out a deterministic one again in each filter and column that uses it.
embed = F.arrow_udf(_embed, ArrayType(FloatType())).asNondeterministic()
