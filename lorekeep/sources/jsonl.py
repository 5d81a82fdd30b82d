"""Observations as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.schemas import OBSERVATION


def import_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an id and a project; torn and blank lines are dropped."""
    rows = spark.read.schema(f"{OBSERVATION}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.filter(F.col("_torn").isNull() & F.col("id").isNotNull() & F.col("project").isNotNull()).drop("_torn")


def export_rows(observations: DataFrame, path: str) -> None:
    observations.write.option("ignoreNullFields", "true").json(path)
