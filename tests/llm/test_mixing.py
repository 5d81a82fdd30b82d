import re
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import mixing
from lorekeep.llm.mixing import cut_words, mix, mixed_documents, permuted, shard_counts
from lorekeep.llm.queries import op3_source_mixing

from .conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left, weights = total - sum(full.values()), sum(weight[s] for s in free)
        over = {s: 2.0 * sizes[s] for s in free if left * weight[s] / weights > 2 * sizes[s]}
        if not over:
            return full | {s: left * weight[s] / weights for s in free}
        full |= over


def check(docs, rows, tolerance):
    sizes = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    by_source = Counter()
    for _, s, n in sizes:
        by_source[s] += n
    targets = expected_targets(by_source)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == Counter((i, n, by_source[s], round(targets[s], 6)) for i, s, n in sizes)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s in by_source:
        key = by_source[s], round(targets[s], 6)
        alike = sum((by_source[t], round(targets[t], 6)) == key for t in by_source)
        assert taken[key] == pytest.approx(targets[s] * alike, rel=tolerance, abs=2)


def test_table(spark, sf):
    docs, rows = spark.read.parquet(f"{sf}/documents.parquet"), rows_of(op3_source_mixing(spark, sf))
    check(docs, rows, 0.03)
    again = rows_of(op3_source_mixing(spark, sf))
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_messy(messy, nothing):
    check(messy, rows_of(mix(messy)), 0.05)
    assert mix(nothing).count() == 0 and mixed_documents(nothing).count() == 0


def test_documents_hold_what_is_taken(messy):
    rows = rows_of(mixed_documents(messy))
    assert set(rows[0]) == set(messy.columns)
    taken = sum(r["taken"] for r in rows_of(mix(messy)))
    assert sum(len(WORD.findall(r["text"])) for r in rows) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_permutations():
    for blocks in (1, 2, 7, 64, 1000):
        t = np.arange(2 * blocks)
        found = permuted(t, np.full(len(t), blocks), np.full(len(t), 3))
        assert sorted(found[:blocks]) == sorted(found[blocks:]) == list(range(blocks))


def test_every_slot_is_drawn():
    """Shards are full, quotas are met, slot numbers are gapless, and counts spread as multinomial draws do."""
    quotas = np.array([9000, 0, 3000, 30_000, 1])
    found = list(shard_counts(quotas, 0, 10**6, 40))
    assert [s for s, *_ in found] == list(range(-(-quotas.sum() // 40)))
    assert all(n.sum() == 40 for _, _, _, n in found[:-1])
    numbers, counts = {i: [] for i in range(5)}, []
    for _, at, first, n in found:
        for i, a, k in zip(at, first, n, strict=True):
            numbers[i] += range(a, a + k)
        counts.append(dict(zip(at, n, strict=True)).get(0, 0))
    assert all(numbers[i] == list(range(q)) for i, q in enumerate(quotas))
    p = 9000 / quotas.sum()
    assert np.var(counts[:-1]) == pytest.approx(40 * p * (1 - p), rel=0.2)
    part = list(shard_counts(quotas, 100, 103, 40))  # any task draws its shards alike
    assert [(s, n.tolist(), f.tolist()) for s, _, f, n in part] == [(s, n.tolist(), f.tolist()) for s, _, f, n in found[100:103]]


def test_draws_of_very_many_slots():
    quotas = np.array([3 * 10**11, 10**11, 7])
    (_, _, _, left), (_, _, _, right) = shard_counts(quotas, 0, 2, 2 * 10**11 + 4)
    assert (left[:2] + right[:2] == quotas[:2]).all() and left.sum() == 2 * 10**11 + 4
    assert left[0] == pytest.approx(1.5 * 10**11, rel=1e-6)


def test_taken_by_brute_force(spark, messy):
    """Words taken of each document, from slots and streams that are put together in plain Python."""
    rows = [(i, f"s{i % 3}", " ".join(f"w{i}x{k}" for k in range(7 * i % 190))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select(*mixing._sized(docs, mixing.row_tie(docs.select("doc_id", "text", "source"))))
    placed, mapped = mixing._placed(sized)
    blocks = Counter((r["sid"], r["block"]) for r in mapped.collect())
    where = {r["doc_id"]: (r["sid"], r["at"], r["size"]) for r in placed.collect()}
    for sid in {s for s, _, _ in where.values()}:  # the streams have no gaps
        spans = sorted((at, at + n) for s, at, n in where.values() if s == sid and n)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    want = {i: sum(blocks[s, (at + k) // mixing.BLOCK] for k in range(n)) for i, (s, at, n) in where.items()}
    assert {r["doc_id"]: r["taken"] for r in rows_of(mix(docs))} == want


def test_repeated_rows_and_any_names(spark):
    text = " ".join(map(str, range(300)))
    df = spark.createDataFrame([(1, "a", text)] * 5 + [(2, "b", text)], "doc_id long, source string, text string").selectExpr("*", "1 as tie", "2 as copy", "3 as doc", "4 as __nth", "5 as size")
    rows = rows_of(mix(df))
    assert len(rows) == 6 and all(r["taken"] <= 600 for r in rows)
    found = mixed_documents(df)
    assert found.columns == df.columns and sum(len(r["text"].split()) for r in rows_of(found)) == sum(r["taken"] for r in rows)


def test_cut_words():
    assert cut_words(" a  b\nc d ", [(0, 2), (3, 4)]) == "a  b\nd"
