"""Stores by address, and replacing a stored table as a whole."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Schemes that Spark's file readers open.
_FILES = ("", "file", "hdfs", "viewfs", "s3a", "abfss", "gs", "dbfs")


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store at an address: a folder of Parquet tables, a database over JDBC, or MongoDB.

    JDBC and MongoDB need their drivers on the class path."""
    parts = urlparse(store)
    if parts.scheme in _FILES:
        return spark.read.parquet(f"{store.rstrip('/')}/{name}")
    if parts.scheme in ("postgres", "postgresql"):
        options = {"url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}", "dbtable": name}
        if parts.username:
            options |= {"user": parts.username, "password": parts.password or ""}
        return spark.read.format("jdbc").options(**options).load()
    if parts.scheme == "sqlite":
        return spark.read.format("jdbc").options(url=f"jdbc:sqlite:{parts.path}", dbtable=name).load()
    if parts.scheme in ("mongodb", "mongodb+srv"):
        database = parts.path.strip("/") or "lorekeep"
        return spark.read.format("mongodb").options(**{"connection.uri": store, "database": database, "collection": name}).load()
    raise ValueError(f"no store for {parts.scheme}://")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the old table and then swaps the folders, so a failed job leaves the old one.

    ``df`` may read the table it replaces."""
    spark, new, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(make(path)):
        files.rename(make(path), make(old))
    files.rename(make(new), make(path))
    files.delete(make(old), True)
