"""Toxicity: a bidirectional gated recurrent network over overlapping windows of words.

Texts are read as lower-cased words. Every text is cut into windows of WINDOW words, each STRIDE
after the last, so neighbours overlap and the last one ends with the text. The network scores all
windows; a text's score is that of its most toxic window. The network is trained in numpy on a
bounded sample of labelled rows: of a toxic text only its most suspicious windows count as toxic
(chosen by word counts at first, by the network itself later), of a harmless one all do not.

Defined results: null text counts as empty. A text without words is one window of padding and gets
the score of that, which training holds low. Without labelled rows of both classes the score is 0.
Repeated rows give repeated results. Only doc_id and text are read, and only text is an input.
Scoring shuffles nothing; tasks hold the network (of a fixed size), a bounded table of words, and one
slice of windows, which long texts are cut into as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import discard, held_out, slices, text_of, tidy
from lorekeep.llm.gru import Adam, Network, encode_words
from lorekeep.llm.labelled import labelled_rows

WINDOW, STRIDE = 64, 48
#: At most so many labelled rows of each class, and so many characters of whole texts.
PER_CLASS, CHARS = {0: 3000, 1: 1000}, {0: 8_000_000, 1: 4_000_000}
#: Training: least steps, least passes, windows in a step, rate at the start, seed.
STEPS, EPOCHS, BATCH, RATE, SEED = 300, 5, 128, 0.01, 17
THRESHOLD = 0.7
#: Words a task remembers, and windows it scores at once.
TABLE_WORDS, WINDOWS_AT_ONCE = 200_000, 4096

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words."""
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return np.minimum(starts, max(0, n - WINDOW))


def _grid(places: list[np.ndarray], kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Of texts given as table columns: windows (steps, windows), and how many each text has."""
    counts = [len(windows(len(p))) for p in places]
    grid = np.zeros((sum(counts), WINDOW), kind)
    at = 0
    for p, n in zip(places, counts, strict=True):
        if len(p) < WINDOW:
            grid[at, : len(p)] = p
        else:
            grid[at : at + n] = np.lib.stride_tricks.sliding_window_view(p, WINDOW)[windows(len(p))]
        at += n
    return np.ascontiguousarray(grid.T), np.array(counts, np.int64)


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Network | None:
    labels = np.asarray(labels).astype(bool)
    if labels.all() or not labels.any():
        return None
    draw, network = np.random.default_rng(seed), Network.initial(seed)
    column: dict[str, int] = {}
    places = []  # words are kept as numbers: the driver holds no text twice
    for t in texts:
        words = words_of(t)
        places.append(np.fromiter((column.setdefault(w, len(column) + 1) for w in words), np.int32, len(words)))
    if not column:
        return None
    codes = encode_words(list(column))
    # First guess at windows: words in proportion more frequent in toxic texts.
    seen = np.zeros((2, len(column) + 1))
    for p, y in zip(places, labels, strict=True):
        seen[int(y), np.unique(p)] += 1
    grid, counts = _grid(places, np.int32)
    del places
    text = np.repeat(np.arange(len(texts)), counts)
    toxic = labels[text]
    odds = np.log((seen[1] + 0.1) / labels.sum()) - np.log((seen[0] + 0.1) / (~labels).sum())
    odds = np.where(seen.sum(0) > 2, odds, 0).astype(np.float32)
    score = np.concatenate([np.sort(odds[grid[:, i : i + WINDOWS_AT_ONCE]], axis=0)[-3:].sum(0) for i in range(0, grid.shape[1], WINDOWS_AT_ONCE)])
    adam, rare = Adam(network, RATE), seen.sum(0)[1:] <= 3
    total = STEPS
    while adam.steps < total:
        if adam.steps:
            tables = network.projected(network.inputs(codes))
            score = np.concatenate([network.forward(tables, grid[:, i : i + WINDOWS_AT_ONCE]) for i in range(0, grid.shape[1], WINDOWS_AT_ONCE)])
        order = np.lexsort((-score, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        chosen = np.flatnonzero((rank == 0) | (~toxic & ((rank == 1) | (draw.random(len(text)) < 0.1))))
        draw.shuffle(chosen)
        if not adam.steps:
            total = max(STEPS, EPOCHS * -(-len(chosen) // BATCH))
        y = toxic[chosen].astype(np.float32)
        for i in range(0, len(chosen), BATCH):
            part, target = chosen[i : i + BATCH], y[i : i + BATCH]
            used, index = np.unique(grid[:, part], return_inverse=True)
            if used[0] != 0:
                used, index = np.concatenate([[0], used]), index + 1
            own = _subset(codes, used[1:] - 1)
            adam.rate = RATE * 0.25 ** (adam.steps / total)
            drop = (draw.random(len(used) - 1) < 0.15) | (rare[used[1:] - 1] & (draw.random(len(used) - 1) < 0.7))
            adam.step(network.gradients(own, index.reshape(grid[:, part].shape), target, np.ones(len(part), np.float32), drop))
    # Words that training never saw keep their random start; that would only be noise.
    unseen = np.ones(len(network.weights["word"]), bool)
    unseen[codes.words] = False
    network.weights["word"][unseen] = 0
    return network


def _subset(codes, at: np.ndarray):
    counts = codes.counts[at]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    grams = codes.grams[np.arange(int(counts.sum())) - np.repeat(starts - codes.starts[at], counts)]
    return type(codes)(codes.words[at], grams, starts, counts)


class _Columns(dict):
    """Numbers words from 1 as they are met; ``new`` lists those not yet in the tables."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = column = len(self) + 1
        return column


class Scorer:
    """Scores texts in one task; remembers what words project to, up to TABLE_WORDS of them."""

    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.column = _Columns()
        blank = self.network.projected(np.zeros((self.network.weights["f_in"].shape[1], 1), np.float32))
        self.tables = [np.zeros((b.shape[0], TABLE_WORDS + 1), np.float32) for b in blank]
        for table, b in zip(self.tables, blank, strict=True):
            table[:, :1] = b

    def places(self, words: list[str]) -> np.ndarray:
        """Table columns of words, all valid until the table is forgotten."""
        start = len(self.column) + 1
        found = np.fromiter(map(self.column.__getitem__, words), np.int64, len(words))
        if new := self.column.new:
            for table, x in zip(self.tables, self.network.projected(self.network.inputs(encode_words(new))), strict=True):
                table[:, start : start + len(new)] = x[:, 1:]
            new.clear()
        return found

    def score(self, texts: list[str]) -> np.ndarray:
        listed = [words_of(t) for t in texts]
        total = sum(map(len, listed))
        if len(self.column) + total > TABLE_WORDS and len(self.column) + len({w for ws in listed for w in ws} - self.column.keys()) > TABLE_WORDS:
            self._forget()
            if len({w for ws in listed for w in ws}) > TABLE_WORDS:
                return np.array([self._piecewise(ws) for ws in listed])
        flat = self.places([w for ws in listed for w in ws])
        ends = np.cumsum([len(ws) for ws in listed])
        grid, counts = _grid(np.split(flat, ends[:-1]))
        return 1 / (1 + np.exp(-np.maximum.reduceat(self._logits(grid), np.cumsum(counts) - counts)))

    def _logits(self, grid: np.ndarray) -> np.ndarray:
        return np.concatenate([self.network.forward(self.tables, grid[:, i : i + WINDOWS_AT_ONCE]) for i in range(0, grid.shape[1], WINDOWS_AT_ONCE)]).astype(float)

    def _piecewise(self, words: list[str]) -> float:
        """One text in runs of windows, each run with a fresh table: the same windows, the same scores."""
        best, starts, per = -np.inf, windows(len(words)), max(1, (TABLE_WORDS - WINDOW) // STRIDE)
        for i in range(0, len(starts), per):
            self._forget()
            run = starts[i : i + per]
            part = self.places(words[run[0] : run[-1] + WINDOW])
            if len(part) < WINDOW:
                grid = np.zeros((WINDOW, 1), np.int64)
                grid[: len(part), 0] = part
            else:
                grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, WINDOW)[run - run[0]].T)
            best = max(best, float(self._logits(grid).max()))
        return 1 / (1 + np.exp(-best))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of a network trained on all rows given, a row for each array."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    network = train([*texts, ""], np.array([*labels, 0]))
    for name, values in network.weights.items() if network else ():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(values.shape)], pa.list_(pa.int32())), pa.array([values.tobytes()], pa.binary())], names=["name", "shape", "values"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> Network | None:
    """The network, trained in one task on the bounded sample; the driver gets its weights alone."""
    rows = labelled_rows(docs, labels, "toxic", per_class, CHARS)
    ordered = rows.repartition(1).sortWithinPartitions("doc_id", "label")  # at most sum(per_class) rows and sum(CHARS) characters
    weights = ordered.mapInArrow(tidy(_trained), "name string, shape array<int>, values binary").collect()
    discard(rows)
    return Network({w["name"]: np.frombuffer(w["values"], np.float32).reshape(w["shape"]) for w in weights}) if weights else None


def _scores(network: Network | None):
    """A function from batches with a text column to pairs of a slice and its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        scorer = Scorer(network) if network else None
        for batch in slices(batches, limit=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch, scorer.score(texts) if scorer and texts else np.zeros(len(texts))

    return run


def score_toxicity(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scores = _scores(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    scored = rows.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text (a string column) scores below ``threshold``."""
    scores = _scores(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(batches):
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
