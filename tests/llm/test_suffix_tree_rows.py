"""What the suffix tree's passes over the texts hand on: few rows, and pairs that can matter."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lorekeep.llm import suffix_tree
from lorekeep.llm.words import joined

from .conftest import prose, rows_of
from .test_suffix_tree import same


def docs(spark):
    passages = [prose(i, 12) for i in range(6)]
    return spark.createDataFrame([(i, " ".join([prose(100 + i, 20), passages[i % 6], passages[i * i % 6]])) for i in range(120)], "doc_id long, text string").repartition(3)


def test_keys_are_asked_for_by_slice_and_part(spark, monkeypatch):
    """Not by text and key, of which there are more than the array of frequent keys leaves out."""
    rows = docs(spark)
    monkeypatch.setattr(suffix_tree, "HOT", 3)
    model = suffix_tree.fit(rows.filter(~suffix_tree.held_out(F.col("doc_id"))), 3, 4, 2)
    monkeypatch.setattr(suffix_tree, "PART_KEYS", -(-model.table.count() // 8))
    asked, others = suffix_tree.asked(rows, model.table)
    found = rows_of(asked)
    assert 4 < len({r["part"] for r in rows_of(others)}) <= 8
    assert sum(len(r["keys"] or []) for r in found) > 20 * 120 and len(found) <= 120 + 3 * 2 * 8


def test_many_parts_and_short_blocks_change_nothing(spark, monkeypatch):
    for name, value in {"HOT": 3, "PART_KEYS": 40, "PARTS": 5, "PART_TOKENS": 100, "BLOCK": 7, "BITMAP_BITS": 6, "COUNT_BYTES": 900}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    rows = docs(spark)
    same(rows, rows_of(rows), 3, 4, 2)


def test_only_pairs_that_a_shorter_context_holds_are_counted(spark):
    texts = spark.createDataFrame([("a b c",), ("a b d",), ("a b c",)], "text string")
    key = {w: int(suffix_tree._tokens(pa.array([w]), suffix_tree.table_of(suffix_tree.BLANKS)).hashes[0]) for w in "abcd"}
    pair = lambda v, w: int(joined(np.array([key[v]], np.uint64), np.array([key[w]], np.uint64)).view(np.int64)[0])
    candidates = spark.createDataFrame([(pair("a", "b"), 3)], "key long, times long")
    lower = spark.createDataFrame([(pair("b", "c"),)], "key long")
    rows, _ = suffix_tree.pairs_of(texts, 2, candidates, lower, 12)
    seen = Counter()
    for r in rows_of(rows):
        for c, w, n in zip(r["context_at"], r["word_at"], r["n"], strict=True):
            seen[r["contexts"][c], r["words"][w] % 2**64] += n
    assert seen == {(pair("a", "b"), key["c"]): 2}


def test_answers_are_rows_by_slice_and_part(spark, monkeypatch):
    """Not by text and part, of which there are more with each part."""
    rows = docs(spark)
    monkeypatch.setattr(suffix_tree, "HOT", 3)
    model = suffix_tree.fit(rows.filter(~suffix_tree.held_out(F.col("doc_id"))), 3, 4, 2)
    monkeypatch.setattr(suffix_tree, "PART_KEYS", -(-model.table.count() // 8))
    asked, others = suffix_tree.asked(rows, model.table)
    sums = asked.groupBy("part").cogroup(others.groupBy("part")).applyInArrow(suffix_tree._answered, from_arrow_schema(suffix_tree.SUMS))
    assert 120 < sums.count() <= 120 + 3 * 2 * 8


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_query_that_wrote_them(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HOT", 3)
    rows, setting = docs(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows.count()
    before, as_set = shuffle_files(spark), spark.conf.get(setting, None)
    scored = suffix_tree.suffix_tree_scores(rows, 3, 4, 2)
    for _ in range(20):  # Spark doesn't wait until they are gone
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(setting, None) == as_set and scored.count() == 120


def test_pairs_gathered_from_slices_and_shares_change_nothing(spark, monkeypatch):
    for name, value in {"HELD_PAIRS": 60, "GIVEN_PAIRS": 9, "COUNT_BYTES": 500, "SHARES": {1: 3, 3: 2}, "ROUNDS": 3, "HOT": 3, "PART_KEYS": 40}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    rows = docs(spark)
    same(rows, rows_of(rows), 3, 4, 2)
