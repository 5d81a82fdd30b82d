"""The builtin embedder against a plain loop over words, trigrams and pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import vectors
from lorekeep.functions.vectors import DIMENSIONS, GRAM_WEIGHT, PAIR_WEIGHT, WORD_WEIGHT, hashed_vector
from lorekeep.operators import search

TEXTS = ["", "x", "one", "Hello hello world", "a bb ccc dd", "été 日本語 テスト 😀😀 naïve", "long " + "w" * 300 + " long", "\ud83d\ud83d \ude00\ude00 ab"]


def plain(text):
    words, vector = [w for w in vectors._SPLIT.split(text.lower()) if len(w) > 1], np.zeros(DIMENSIONS)

    def add(feature, weight):
        h, units = 0x811C9DC5, feature.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(units), 2):
            h = (h ^ (units[i] | units[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
        vector[h % DIMENSIONS] += -weight if h >> 31 else weight

    for i, word in enumerate(words):
        padded = f"^{word}$"
        add(f"w:{word}", WORD_WEIGHT)
        for k in range(len(padded) - 2):
            add(f"g:{padded[k : k + 3]}", GRAM_WEIGHT)
        if i:
            add(f"b:{words[i - 1]}_{word}", PAIR_WEIGHT)
    length = np.sqrt((vector**2).sum())
    return (vector / length if length else vector).tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_embedder(text):
    assert hashed_vector(text) == plain(text)


def test_pairs_of_a_text_are_hashed_together(monkeypatch):
    """A repeated word is hashed once, and no pair by itself."""
    calls, own = [], vectors._fnv
    monkeypatch.setattr(vectors, "_fnv", lambda *a: calls.append(a) or own(*a))
    vectors._word.cache_clear()
    hashed_vector("red fox " * 200)
    assert len(calls) == 2 * (1 + 3 + 1)


def test_many_words_are_hashed_together(monkeypatch):
    """each word and trigram that a worker didn't know yet was hashed by itself."""
    calls, own = [], vectors._fnv
    monkeypatch.setattr(vectors, "_fnv", lambda *a: calls.append(a) or own(*a))
    vectors._word.cache_clear()
    hashed_vector(" ".join(f"fox{i}" for i in range(500)))
    assert len(calls) <= 10


@pytest.mark.parametrize("most", [3, 40, 1 << 15])
def test_texts_together(monkeypatch, most):
    """Texts that are taken together have the bits of a plain loop, wherever they are cut."""
    monkeypatch.setattr(vectors, "MOST_WORDS", most)
    texts = [*TEXTS, None, " ".join(f"wörd{i} 😀x{i} {i}" for i in range(60)), "red fox " * 30, "", "é" * 70000 + " zz", "a 1 _b_ cc__dd"]
    assert vectors.hashed_vectors(texts).tolist() == [plain(t or "") for t in texts]
    assert vectors.hashed_vectors([]).shape == (0, DIMENSIONS)


def test_a_row_is_embedded_once(spark):
    """F2: the filter and the score each had the embedder work out a row's vector."""
    rows = spark.createDataFrame([(str(i), f"red fox {i}" if i % 3 else "blue whale") for i in range(40)], "id string, body string")
    rows = rows.withColumn("embedding", vectors.embed("body")).withColumn("embedder", F.lit("builtin"))
    query = hashed_vector("red fox")
    found = search.vector_search(rows, query, 30, embedder="builtin", floor=0.2)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    scored = [(i, float(np.dot(np.array(plain(t), np.float32).astype(float), query))) for i, t in rows.select("id", "body").collect()]
    expected = sorted((x for x in scored if x[1] >= 0.2), key=lambda x: (-round(x[1], 9), x[0]))[:30]
    assert [r["id"] for r in found.collect()] == [i for i, _ in expected] and len(expected) == 26
