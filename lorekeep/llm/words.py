"""Splitting texts into words, a column of an Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that stand between words of text: blank, and tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes that stand between search terms: all of ASCII but letters and digits.
MARKS = bytes(b for b in range(0x80) if not chr(b).isalnum())


def table_of(separators: bytes) -> np.ndarray:
    """What each byte becomes: A-Z lower, separators a blank, the other control bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 0x20
    return table


def _mapped(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, mapped, and where each text begins and the last one ends."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return table[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]], places - places[0]


def words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts as numbers into a vocabulary, the vocabulary, and where each text's words end.

    ``table`` maps the bytes of UTF-8 first (see table_of); a null text has no words."""
    data, places = _mapped(texts, table)
    mapped = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(places)), pa.py_buffer(data))
    parts = pc.ascii_split_whitespace(mapped)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] > 0 if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(full)])[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))] if len(texts) else np.zeros(0, np.int64)
    return codes[full], coded.dictionary, ends


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Words of more bytes are hashed one by one.
LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of one 64-bit number."""
    h = (seed + _P5 + np.uint64(8)) ^ (_turn(x * _P2, 31) * _P1)
    h = _turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of two keys, as Spark's xxhash64(a, b)."""
    with np.errstate(over="ignore"):
        return _hash_long(np.asarray(b, np.uint64), _hash_long(np.asarray(a, np.uint64), np.uint64(42)))


def hashed_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words end.

    Words are hashed eight bytes at a time, all words together, from a seed of their length."""
    data, places = _mapped(texts, table)
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = data != 0x20
    begins = full[1:-1] & ~full[:-2]
    inner = places[1:-1][(places[1:-1] < len(data)) & (places[1:-1] > 0)]
    begins[inner] = full[1:-1][inner]  # a word ends with its text
    starts = np.flatnonzero(begins)
    ends_here = full[1:-1] & ~full[2:]
    ends_here[inner - 1] = full[1:-1][inner - 1]
    sizes = np.flatnonzero(ends_here) + 1 - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    with np.errstate(over="ignore"):
        found = _hash_long(lanes[starts] & _MASKS[np.minimum(sizes, 8)], sizes.astype(np.uint64))
        for done in range(8, LONG, 8):
            more = np.flatnonzero(sizes > done)
            if not len(more):
                break
            found[more] = _hash_long(lanes[starts[more] + done] & _MASKS[np.minimum(sizes[more] - done, 8)], found[more])
    for i in np.flatnonzero(sizes > LONG):
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]], 42)
    return found, np.searchsorted(starts, places[1:])
