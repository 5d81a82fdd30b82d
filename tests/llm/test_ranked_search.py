"""Ranked search against a plain loop over all items and documents."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import ranked_search
from lorekeep.llm.common import stored
from .conftest import rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, extra string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k):
    found = [(d["doc_id"], t) for d in docs if (t := terms(d["text"]))]
    total, n_docs = sum(len(t) for _, t in found), len(found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item in items:
        scored = []
        for doc_id, t in found:
            m, score = 10 + 90 * len(t) * n_docs // total, 0
            for x in set(terms(item["text"])) & set(t):
                w, tf = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))), t.count(x)
                score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item["item_id"], rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows_of(df)), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the Reading of station"), (2, ""), (3, None), (4, "harbour harbour HARBOUR copper!"), (4, "word short"), (None, "istanbul σας 東京 éÁ don't endoftext"), (5, "nowhere"), (6, "İstanbul ΣΑΣ it-s x")]
    return spark.createDataFrame([(*r, "x") for r in rows], ITEMS)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_messy_rows(messy, items, k):
    assert found(ranked_search.ranked_search(messy, items, k)) == expected(rows_of(messy), rows_of(items), k)


def test_all_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert found(ranked_search.ranked_search(docs, items)) == expected(rows_of(docs), rows_of(items), 10)


def test_terms_that_are_too_many_for_the_scan_are_joined(messy, items, monkeypatch):
    monkeypatch.setattr(ranked_search, "BROADCAST_BYTES", -1)
    assert found(ranked_search.ranked_search(messy, items, 4)) == expected(rows_of(messy), rows_of(items), 4)


def test_full_postings_serve_any_items(spark, messy, items, tmp_path):
    ranked_search.write_postings(messy, f"{tmp_path}/p")
    postings = ranked_search.read_postings(spark, f"{tmp_path}/p")
    assert found(ranked_search.search(postings, stored(ranked_search.item_terms(items), "items"), 5)) == expected(rows_of(messy), rows_of(items), 5)
    hits = postings.filter("bucket >= 0")
    assert hits.filter(F.col("bucket") != ranked_search.bucket_of(F.col("term"))).count() == 0
    assert hits.agg(F.sum("tf")).head()[0] == sum(len(terms(r["text"])) for r in rows_of(messy))


def test_no_rows(spark, nothing, messy, items):
    empty = spark.createDataFrame([], ITEMS)
    assert ranked_search.ranked_search(nothing, items).count() == 0
    assert ranked_search.ranked_search(messy, empty).count() == 0
    assert ranked_search.ranked_search(messy.filter("text is null"), items).count() == 0


def test_ties_rank_by_id(spark):
    docs = spark.createDataFrame([(i, "apple pear") for i in (9, 3, 7, None, 5)] + [(1, "plum")] * 8, "doc_id long, text string")
    items = spark.createDataFrame([(1, "apple", "")], ITEMS)
    assert [r["doc_id"] for r in ranked_search.ranked_search(docs, items).orderBy("rank").collect()] == [3, 5, 7, 9, None]
