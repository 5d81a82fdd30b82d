"""The suffix tree against one built and walked by plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import suffix_tree
from lorekeep.llm.words import BLANKS, hashed_words, table_of, words

from .conftest import prose, rows_of

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return (*re.findall(r"[^\x20\x09-\x0D]+", lower), "")


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tree:
    """States by their words, as the module's docstring defines them."""

    def __init__(self, texts, depth, least_context, least_pair):
        self.depth, self.words = depth, Counter(w for t in texts for w in t)
        self.total, self.states = self.words.total(), {}
        tested = {(w,) for w, n in self.words.items() if n >= least_context and w}
        for d in range(1, depth + 1):
            after = defaultdict(Counter)
            for t in texts:
                for i in range(d, len(t)):
                    if t[i - d : i] in tested:
                        after[t[i - d : i]][t[i]] += 1
            for context, counts in after.items():
                kept = {w: n for w, n in counts.items() if n >= least_pair}
                if kept and self.diverges(context, kept, counts.total()):
                    self.states[context] = (kept, counts.total())
            longer = {c + (w,): n for c, counts in after.items() for w, n in counts.items()}
            tested = {g for g, n in longer.items() if n >= max(least_context, least_pair) and g[-1] and g[1:] in self.states}

    def diverges(self, context, kept, times):
        low = {w: self.p(context[1:], w) for w in kept}
        gain = sum(n * math.log(n / times / low[w]) for w, n in kept.items())
        if rest := times - sum(kept.values()):
            gain += rest * math.log(rest / times / max(1 - sum(low.values()), 1e-12))
        return gain >= len(kept) * math.log(max(self.total, 2)) / 2

    def p(self, context, word):
        """The probability after the longest state that ends ``context``."""
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.words[word] + 0.5) / (self.total + 0.5 * (len(self.words) + 1))
        kept, times = self.states[context]
        rest = times - sum(kept.values()) + len(kept)
        return (kept.get(word, 0) + rest * self.p(context[1:], word)) / (times + len(kept))

    def score(self, text):
        return sum(math.log10(self.p(text[max(0, i - self.depth) : i], w)) for i, w in enumerate(text))


def expected(rows, *limits):
    tree = Tree([tokens(r["text"]) for r in rows if not is_held_out(r["doc_id"])], *limits)
    out = []
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10(tree.p((), w)) for w in t)
        out.append((r["doc_id"], is_held_out(r["doc_id"]), len(t), sum(tree.words[w] > 0 for w in t), tree.total, base, tree.score(t)))
    return out, tree


def same(df, rows, *limits):
    wanted, tree = expected(rows, *limits)
    found = [tuple(r[c] for c in COLUMNS) for r in rows_of(suffix_tree.suffix_tree_scores(df, *limits))]
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    found, wanted = sorted(found, key=key), sorted(wanted, key=key)
    assert [x[:5] for x in found] == [x[:5] for x in wanted]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in wanted], rtol=1e-9, atol=1e-9)
    return tree


@pytest.fixture(scope="module")
def prose_rows(spark):
    """Texts that repeat each other's passages, so that contexts of every length matter."""
    passages = [prose(i, 12) for i in range(6)]
    rows = [(i, " ".join([prose(100 + i, 20), passages[i % 6], passages[i * i % 6]])) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_keys_are_those_of_spark(spark):
    pairs = [(0, 0), (1, -1), (2**62, -(2**61)), (-5, 17)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("k")).collect()
    a, b = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in "ab")
    assert suffix_tree.joined(a, b).view(np.int64).tolist() == [r["k"] for r in rows]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.none() | st.text(st.sampled_from("ab\x00\xe9A \t\r\x1f\u6771"), max_size=200), max_size=6))
def test_words_are_hashed_alike_wherever_they_stand(texts):
    table = table_of(BLANKS)
    hashes, ends = hashed_words(pa.array(texts, pa.string()), table)
    found = [w for t in texts for w in tokens(t)[:-1]]
    assert len(hashes) == len(found) and np.diff(ends, prepend=0).tolist() == [len(tokens(t)) - 1 for t in texts]
    codes, vocabulary, also = words(pa.array(texts, pa.string()), table)
    assert [vocabulary[int(c)].as_py() for c in codes] == found and also.tolist() == ends.tolist()
    by_hash = dict(zip(hashes.tolist(), found, strict=True))
    assert len(by_hash) == len(set(found)) and [by_hash[h] for h in hashes.tolist()] == found


@pytest.mark.parametrize("limits", [(1, 2, 2), (3, 4, 2), (4, 2, 1)])
def test_passages(prose_rows, limits):
    tree = same(prose_rows, rows_of(prose_rows), *limits)
    assert {len(c) for c in tree.states} == set(range(1, min(limits[0], 3) + 1))


def test_messy_rows(messy):
    tree = same(messy, rows_of(messy), 3, 3, 2)
    assert tree.states


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tree = same(docs, rows_of(docs), suffix_tree.DEPTH, suffix_tree.LEAST_CONTEXT, suffix_tree.LEAST_PAIR)
    assert tree.states


def test_small_bitmap_and_array_change_nothing(prose_rows, monkeypatch):
    """False hits of the bitmap and keys that must be joined."""
    monkeypatch.setattr(suffix_tree, "BITMAP_BITS", 6)
    monkeypatch.setattr(suffix_tree, "HOT", 3)
    same(prose_rows, rows_of(prose_rows), 3, 4, 2)


def test_slices_change_nothing(prose_rows, monkeypatch):
    monkeypatch.setattr(suffix_tree, "COUNT_BYTES", 300)
    same(prose_rows, rows_of(prose_rows), 2, 4, 2)


def test_states_sum_to_one(prose_rows):
    tree = expected(rows_of(prose_rows), 3, 4, 2)[1]
    for context in list(tree.states)[::7]:
        assert math.isclose(sum(tree.p(context, w) for w in tree.words) + tree.p(context, "\x00"), 1, rel_tol=1e-9)


def test_held_out_texts_are_not_learned(prose_rows):
    other = prose_rows.withColumn("text", F.when(suffix_tree.held_out(F.col("doc_id")), F.lit("nothing of it")).otherwise(F.col("text")))
    a, b = ({r["doc_id"]: r for r in rows_of(suffix_tree.suffix_tree_scores(df, 2, 4, 2)) if not r["held_out"]} for df in (prose_rows, other))
    assert a.keys() == b.keys() and all(math.isclose(a[i]["score"], b[i]["score"], rel_tol=1e-12) for i in a)


def test_tree_beats_the_root_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = suffix_tree.suffix_tree_scores(docs).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).head()
    assert row["score"] > row["base"] + 0.02 * row["n"]


def test_no_rows_and_nothing_to_learn(nothing, messy):
    assert suffix_tree.suffix_tree_scores(nothing).count() == 0
    held = rows_of(suffix_tree.suffix_tree_scores(messy.filter(suffix_tree.held_out(F.col("doc_id")))))
    assert held and all(r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == r["score"] == 0 for r in held)
