"""Source files as tables."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.ids import file_hash
from lorekeep.operators.graph import language

LARGEST, VERSION = 1 << 20, "1"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """file, lang, source, hash of text files in known languages, up to a mebibyte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    rows = files.filter(F.col("length") <= LARGEST).select(path.alias("file"), language(path).alias("lang"), "content")
    rows = rows.filter(F.col("lang").isNotNull() & ~F.contains(F.col("content"), F.lit(b"\x00")))
    return rows.select("file", "lang", F.decode("content", "UTF-8").alias("source"), file_hash(F.col("content"), VERSION).alias("hash"))


def python_symbols(files: DataFrame) -> DataFrame:
    """file, name, kind, start, end of the definitions in Python files, from their syntax trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, source in zip(batch["file"], batch["source"], strict=True):
                try:
                    tree = ast.parse(source)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                methods = {id(d) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for d in c.body}
                for node in ast.walk(tree):
                    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        kind = "class" if isinstance(node, ast.ClassDef) else "method" if id(node) in methods else "function"
                        rows.append((file, node.name, kind, node.lineno, node.end_lineno))
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "start", "end"])

    return files.filter(F.col("lang") == "python").select("file", "source").mapInPandas(run, "file string, name string, kind string, start int, end int")


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files that need no new scan: their hash is the known one (path, hash)."""
    return files.join(known.select(F.col("path").alias("file"), "hash"), ["file", "hash"], "left_semi")


def to_scan(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select(F.col("path").alias("file"), "hash"), ["file", "hash"], "left_anti")
