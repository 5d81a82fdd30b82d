"""Quality by compression: how much shorter is a text with a dictionary of good text than with one
of bad text?

Two zstandard dictionaries are built from labelled text, one for each class. A text is compressed
in blocks under both. The difference of the two sizes, normalised by their mean, goes through a
logistic calibration that was fitted on labelled rows which the dictionaries did not see.

Defined results: null text counts as empty. An empty text has difference 0 and gets the calibrated
score of that. With fewer than four labelled rows of a class the score is 0.5 everywhere. Repeated rows give
repeated results. Columns other than doc_id and text are never inputs. Long texts are read whole,
block by block. There is no shuffle: the two dictionaries (of a fixed size) go to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import held_out, slices, text_of
from lorekeep.llm.labelled import labelled_sample

#: At most so many labelled rows of each class, and so many characters of whole texts.
PER_CLASS, CHARS = {0: 1500, 1: 1500}, {0: 8_000_000, 1: 8_000_000}
DICTIONARY_BYTES, LEVEL, BLOCK_BYTES = 16 << 10, 1, 1 << 10


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    #: Coefficients of 1, difference, difference * log size, log size.
    weights: tuple[float, ...]

    def sizer(self):
        """A function from bytes to the two compressed sizes."""
        both = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            both.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False).compress)

        def sizes(data: bytes) -> tuple[int, int]:
            blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
            return tuple(sum(len(f(b)) for b in blocks) for f in both)

        return sizes

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


def features(sizes, data: bytes) -> tuple[float, ...]:
    good, bad = sizes(data)
    difference, scale = (bad - good) / max(1, (bad + good) / 2), math.log1p(len(data))
    return 1.0, difference, difference * scale, scale if data else 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of samples too few to train on, their ends as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> QualityModel:
    rows = labelled_sample(docs, labels, "quality", per_class, CHARS)
    data, y = [t.encode() for t in rows["text"]], rows["label"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return QualityModel(b"", b"", (0.0, 0.0, 0.0, 0.0))
    turn = np.zeros(len(y), int)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum()) % 2  # even ones build dictionaries, odd ones calibrate
    good, bad = (_dictionary([d for d, label, t in zip(data, y, turn, strict=True) if label == c and t == 0]) for c in (1, 0))
    model = QualityModel(good, bad, (0.0,) * 4)
    sizes = model.sizer()
    x = np.array([features(sizes, d) for d, t in zip(data, turn, strict=True) if t == 1])
    weights = _logistic(x, y[turn == 1].astype(float))
    # The sample holds both classes alike; the intercept goes back to their shares in the labels.
    shares = dict(labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("quality").count().collect())
    weights[0] += math.log(shares[1] / shares[0]) - math.log((y == 1).sum() / (y == 0).sum())
    model.weights = tuple(map(float, weights))
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, and the sizes of the two compressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizer()
        for batch in slices(batches):
            x = np.array([features(sizes, view.as_py()) for view in batch.column("text")], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x)), pa.array(x[:, 1])], names=["doc_id", "score", "difference"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double, difference double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")
