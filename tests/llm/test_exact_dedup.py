import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.exact_dedup import _LOWER, exact_dedup, rice_decode, rice_encode
from lorekeep.llm.queries import op10_golomb_exact_dedup

from .conftest import rows_of


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=200))
def test_rice_round_trip(values):
    x = np.array(sorted(values), np.int64)
    assert (rice_decode(*rice_encode(x, 1 << 40)) == x).all()


def test_code_is_short():
    x = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000))
    assert len(rice_encode(x, 1 << 40)[1]) < 5000 * 4  # 8 bytes each without the code


def check(df, found):
    docs = [(r["doc_id"], (r["text"] or "").encode().translate(_LOWER)) for r in df.select("doc_id", "text").collect()]
    size, keep = Counter(t for _, t in docs), {}
    for i, t in docs:
        if i is not None:
            keep[t] = max(i, keep.get(t, i))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == Counter((i, keep.get(t), size[t], hashlib.sha256(t).hexdigest()) for i, t in docs)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(size) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_messy(messy):
    check(messy, rows_of(exact_dedup(messy)))


def test_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), rows_of(op10_golomb_exact_dedup(spark, sf)))


def test_false_suspects(messy, monkeypatch):
    """With fingerprints of few bits nearly all rows are suspects; the result stays exact."""
    monkeypatch.setattr("lorekeep.llm.exact_dedup.FINGERPRINT_BITS", 8)
    check(messy, rows_of(exact_dedup(messy, owners=3)))


def test_shuffled_suspects(messy, monkeypatch):
    monkeypatch.setattr("lorekeep.llm.common.BROADCAST_BYTES", -1)
    check(messy, rows_of(exact_dedup(messy)))


def test_large_and_small_groups(messy, monkeypatch):
    """Groups on both sides of the share that goes by broadcast."""
    monkeypatch.setattr("lorekeep.llm.exact_dedup.HOT_GROUPS", 4)
    monkeypatch.setattr("lorekeep.llm.common.BROADCAST_BYTES", -1)
    check(messy, rows_of(exact_dedup(messy)))


def test_empty(nothing):
    assert exact_dedup(nothing).count() == 0
