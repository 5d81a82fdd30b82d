"""Embedding anew what has no vector of the present embedder, in batches that can be stopped and taken up again.

Rows are dealt to batches by a hash of their id. A finished batch is one commit (see sources.versions) of its rows and of its line in
the ledger, so a run that is broken off leaves whole batches, and the next one goes on with those that the ledger lacks.
Rows whose embedding fails keep no vector and are counted; they are tried again by the next run over the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.store import stale
from lorekeep.session import stored
from lorekeep.sources.versions import Tables

LEDGER = "embedder string, batch int, rows long, failed long"


def batch_of(i: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(i), F.lit(batches)).cast("int")


def reembed(store: Tables, embedder: str, embed: Callable[[Column], Column], batches: int, table: str = "observations", most: int | None = None, where: Column | None = None) -> DataFrame:
    """Gives the rows of ``table`` (id, title, body, embedding, embedder) that need it the vector that ``embed`` makes of title and body.

    Does the batches that the ledger lacks, at most ``most`` of them, and returns the ledger's lines for this embedder. Once
    all are done the ledger is emptied of them, so that a later run finds what has become stale since. ``embed`` gives null where it fails."""
    spark, name = store.spark, f"{table}_ledger"
    if name not in store.names():
        store.change({name: (spark.createDataFrame([], LEDGER), None, ["embedder", "batch"])})
    lines = lambda: store.read(name).filter(F.col("embedder") == embedder)
    done = {r["batch"] for r in lines().select("batch").collect()}  # at most ``batches``
    for number in [b for b in range(batches) if b not in done][:most]:
        after = store.versions.latest()
        rows = stale(store.read(table, after), embedder).filter(batch_of(F.col("id"), batches) == number)
        if where is not None:
            rows = rows.filter(where)
        vector = embed(F.concat_ws("\n", "title", "body"))
        made = stored(rows.withColumn("embedding", vector).withColumn("embedder", F.when(F.col("embedding").isNotNull(), F.lit(embedder))), "embedded")
        line = made.agg(F.lit(embedder).alias("embedder"), F.lit(number).alias("batch"), F.count("*").alias("rows"), F.count_if(F.col("embedding").isNull()).alias("failed"))
        store.change({table: (made.select(rows.columns), None, ["id"]), name: (line, None, ["embedder", "batch"])}, after)
    found = stored(lines(), "ledger")
    if found.count() >= batches:
        store.change({name: (None, found.select("embedder", "batch"), [])})
    return found
