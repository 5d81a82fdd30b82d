"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import discard, held_out, stored, text_of


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], chars: dict[int, int]) -> DataFrame:
    """At most ``per_class[c]`` rows of class c, as a stored table of doc_id, label, whole text.

    Rows are drawn by a hash of doc_id from labels that aren't held out, before texts are joined. In
    the hash's order a row is taken if its text fits in what is left of the class's ``chars[c]``
    characters, so the sample has at most sum(chars) characters. Texts are never cut.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    picked = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[c]) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row of a repeated id
    found = stored(joined, "labelled")
    sizes = found.select("doc_id", "label", F.length("text").alias("size"), F.xxhash64("doc_id").alias("draw")).toPandas().sort_values(["draw", "doc_id"])
    left, taken = dict(chars), []
    for row in sizes.itertuples():
        if row.size <= left[row.label]:
            left[row.label] -= row.size
            taken.append((row.doc_id, row.label))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, label int"))  # at most sum(per_class) rows
    rows = stored(found.join(chosen, ["doc_id", "label"]).select("doc_id", "label", "text"), "sample")
    discard(found)
    return rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], chars: dict[int, int]) -> pd.DataFrame:
    """``labelled_rows`` on the driver, as (label, text) in order of the ids."""
    rows = labelled_rows(docs, labels, label, per_class, chars)
    found = rows.toPandas().sort_values(["doc_id", "label"], ignore_index=True)
    discard(rows)
    return found[["label", "text"]]
