"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.plans.captures import OBSERVED, TURNS, entries
from lorekeep.plans.catalog import NOW, query
from lorekeep.session import shared_folder
from lorekeep.sources.versions import Tables
from lorekeep.streaming.flush import flush, recorded
from lorekeep.streaming.turns import ingest, ingested

#: Micro-batches of a stream: entries come in them without regard to session or order.
BATCHES = 12


def _stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The conversations as a stream of log entries, out of order: each file of the log holds entries from everywhere."""
    rows = entries(spark, sf_dir)
    rows.repartition(BATCHES, F.xxhash64("session_id", "offset")).write.parquet(f"{folder}/log")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/log")


@query(f"""WITH {TURNS} SELECT session_id, turn_no, "offset", prompt, reasoning FROM turns""")
def streaming_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations streamed into turns in twelve batches out of order: the same rows as the batch query."""
    folder = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    ingest(_stream(spark, sf_dir, folder), folder).awaitTermination()
    return ingested(spark, folder).select("session_id", "turn_no", "offset", "prompt", "reasoning")


@query(f"""WITH {OBSERVED}, d AS (SELECT session_id, title, min((list_position(['decision', 'deadend', 'preference', 'bugfix', 'pattern', 'context'], kind), created_at, id)) AS first FROM observed GROUP BY session_id, title),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS n FROM d),
    s AS (SELECT session_id, string_agg(title, ' | ' ORDER BY n) AS summary FROM r WHERE n <= 3 GROUP BY session_id)
    SELECT o.id, o.session_id, o.kind, o.title, sha256(o.body) AS body_sha256, 256 AS width, o.created_at, o.status, min(o.created_at) OVER (PARTITION BY o.session_id) AS started_at, s.summary
    FROM observed o JOIN s ON o.session_id = s.session_id""")
def streaming_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations streamed into observations, vectors and summaries in twelve batches out of order: what the batch functions give."""
    folder = f"{shared_folder(spark)}/flush-{uuid.uuid4().hex}"
    store = Tables(spark, f"{folder}/store")
    flush(_stream(spark, sf_dir, folder), store, f"{folder}/checkpoint", NOW).awaitTermination()
    sessions = store.read("sessions").select(F.col("id").alias("session_id"), "started_at", "summary")
    rows = recorded(spark, store).join(sessions, "session_id", "left")
    return rows.select("id", "session_id", "kind", "title", F.sha2("body", 256).alias("body_sha256"), F.size("embedding").alias("width"), "created_at", "status", "started_at", "summary")
