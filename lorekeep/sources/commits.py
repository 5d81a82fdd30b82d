"""Commits, from git or from a dump of its log."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"
FORMAT = "%x1e%H%x1f%an%x1f%aI%x1f%s%x1f%b%x1f"
COMMIT = "sha string, author string, date string, subject string, body string, paths array<string>"


def git_log(root: str, limit: int) -> str:
    """The dump of a repository's last ``limit`` commits; empty if there is no repository."""
    command = ["git", "-C", root, "log", "--no-merges", f"-{limit}", f"--pretty=format:{FORMAT}", "--name-only"]
    found = subprocess.run(command, capture_output=True, text=True, check=False)
    return found.stdout if found.returncode == 0 else ""


def commits(dump: DataFrame) -> DataFrame:
    """sha, author, date, subject, body, paths of dumped records (value)."""
    fields = F.split("value", FIELD)
    rows = dump.filter(F.trim("value") != "").select(*(F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(("sha", "author", "date", "subject", "body"))), F.split(F.coalesce(F.get(fields, F.lit(5)), F.lit("")), "\n").alias("paths"))
    return rows.filter((F.col("sha") != "") & F.col("subject").isNotNull() & F.col("date").isNotNull())


def commits_of(spark: SparkSession, root: str, limit: int) -> DataFrame:
    records = [(r,) for r in git_log(root, limit).split(RECORD) if r.strip()]
    return commits(spark.createDataFrame(records, "value string"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return commits(spark.read.option("lineSep", RECORD).text(path))
