"""The registry of queries, and the driver tables read as the engine's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: 2024-02-01, the clock of queries that need one.
NOW = 1_706_745_600_000


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations: the source is the project, the first line the title."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("project"),
        F.col("lang").alias("kind"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("body"),
        F.array("lang", "source").alias("tags"),
        (F.col("doc_id") * 60_000 + 1_700_000_000_000).alias("created_at"),
        "doc_id",
    )


DOCUMENTS = """docs AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, source AS project, lang AS kind, substring(split_part(text, chr(10), 1), 1, 80) AS title,
           text AS body, [lang, source] AS tags, doc_id * 60000 + 1700000000000 AS created_at, doc_id
    FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the user is the project, the type the kind."""
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("project"),
        F.col("event_type").alias("kind"),
        millis.alias("created_at"),
        F.when(F.col("value") > 10, "open").otherwise("done").alias("status"),
        F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("tags"),
        "value",
    )


EVENTS = """ev AS (
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS project, event_type AS kind, epoch_us(ts) // 1000 AS created_at,
           CASE WHEN value > 10 THEN 'open' ELSE 'done' END AS status, [event_type, 'k' || json_extract_string(props, '$.k')] AS tags, value
    FROM events)"""
