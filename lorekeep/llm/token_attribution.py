"""Token counts of fields or sections, from one encoding of the whole document.

A document is encoded once, so counts add up to what the whole document costs. Every token has a
character span; the spans are joined to section intervals. A token that crosses a boundary goes to
the section that holds most of its characters; of equal ones, to the earliest.

Sections are the lines of a text, each with the newline that ends it, unless ``sections`` names a
column of ``array<struct<start int, end int>>`` (ascending, disjoint, in characters, exclusive end).
Tokens outside all sections are counted under section -1.

Defined results: a null or empty text has one section 0 of no characters and no tokens. Null sections,
and those with a null bound, are left out and the others numbered without them. Repeated
rows give repeated results. Columns other than doc_id, text and ``sections`` are not read. Nothing
is shuffled; memory is bounded by one slice of the input and the longest single text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import slices, text_of


@cache
def _encoding(path: str, pattern: str):
    """The encoder and the length in bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, lengths: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens; one that holds part of a character covers that character."""
    own = lengths[np.array(ids, np.int64)]
    ends = np.cumsum(own)
    starts = ends - own
    if not text.isascii():
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        starts, ends = character[starts], character[ends - 1] + 1
    return starts, ends


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    if text.isascii():
        stops = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1
    else:
        stops = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    if not len(stops) or stops[-1] != len(text):
        stops = np.append(stops, len(text))
    return np.concatenate([[0], stops[:-1]]).astype(np.int64), stops


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each section, the tokens given to it, and those of them that reach beyond it; what is in
    no section comes last."""
    n = len(lows)
    first = np.searchsorted(highs, starts, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(lows, ends, side="left") - 1  # the last one that starts before the token ends
    inside = (first == last) & (first < n)
    inside[inside] &= (starts[inside] >= lows[first[inside]]) & (ends[inside] <= highs[first[inside]])
    owner = np.where(inside, first, n)
    crossing = np.zeros(n + 1, np.int64)
    for t in np.flatnonzero(~inside):
        span = np.arange(first[t], min(last[t], n - 1) + 1)
        if len(span):
            held = np.minimum(highs[span], ends[t]) - np.maximum(lows[span], starts[t])
            if held.max() > 0:
                owner[t] = span[held.argmax()]
                crossing[owner[t]] += 1
    return np.bincount(owner, minlength=n + 1), crossing


def token_counts(docs: DataFrame, path: str, pattern: str, sections: str | None = None) -> DataFrame:
    """doc_id, section, start, end, tokens, crossing: a row for each section of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoding(path, pattern)
        for batch in slices(batches):
            parts = []
            given = batch.column("sections").to_pylist() if sections else None
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                spans = token_spans(text, lengths, encoder.encode_ordinary(text))
                if sections:
                    pairs = np.array([(s["start"], s["end"]) for s in given[i] or [] if s and s["start"] is not None and s["end"] is not None], np.int64).reshape(-1, 2)
                    lows, highs = pairs[:, 0], pairs[:, 1]
                else:
                    lows, highs = line_sections(text)
                tokens, crossing = attribute(*spans, lows, highs)
                n = len(lows) + bool(tokens[-1])
                names = np.arange(n)
                names[len(lows) :] = -1
                lows, highs = (np.append(x, [0] * (n - len(x))) for x in (lows, highs))
                parts.append(([doc_id] * n, names, lows, highs, tokens[:n], crossing[:n]))
            ids = [x for p in parts for x in p[0]]
            rest = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(1, 6)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "section", "start", "end", "tokens", "crossing"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x).cast(k) for x, k in zip(rest, kinds, strict=True))], names=names)

    columns = [docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")]
    if sections:
        columns.append(F.col(sections).alias("sections"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, section int, start long, end long, tokens long, crossing long")
