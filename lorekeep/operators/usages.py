"""Text search over lines, with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(symbol: str) -> str:
    return "\\Q" + symbol.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def matches(text: Column, symbol: str, regex: bool = False) -> Column:
    """Whether a line holds the whole word ``symbol``, or matches it as a pattern."""
    return text.rlike(symbol if regex else rf"(?<![A-Za-z0-9_]){_quoted(symbol)}(?![A-Za-z0-9_])")


def defines(text: Column, symbol: str) -> Column:
    """Whether a line looks like the definition of ``symbol``."""
    s, end, start = _quoted(symbol), "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
    #: The forms of a definition.
    forms = "|".join((rf"function\*?\s+{s}{end}", rf"class\s+{s}{end}", rf"(?:interface|type|enum)\s+{s}{end}", rf"(?:export\s+)?(?:const|let|var)\s+{s}\s*[:=]", rf"export\s*\{{[^}}]*{start}{s}{end}"))
    return text.rlike(f"{start}(?:{forms})")


def find_usages(lines: DataFrame, symbol: str, context: int = 0, regex: bool = False, limit: int | None = None) -> DataFrame:
    """file, line, text, is_definition, is_match of the lines (file, line, text) that match and those around them.

    A line near several matches comes once. ``limit`` cuts the matches, by file and line."""
    hits = lines.filter(matches(F.col("text"), symbol, regex)).select("file", "line")
    if limit is not None:
        hits = hits.orderBy("file", "line").limit(limit)
    around = hits.select("file", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line"), F.col("line").alias("hit"))
    around = around.groupBy("file", "line").agg(F.bool_or(F.col("line") == F.col("hit")).alias("is_match"))
    found = lines.join(around, ["file", "line"])
    return found.select("file", "line", "text", (F.col("is_match") & defines(F.col("text"), symbol)).alias("is_definition"), "is_match")


def usage_total(lines: DataFrame, symbol: str, limit: int, regex: bool = False) -> DataFrame:
    """One row: all matching lines, how many of them ``limit`` shows, and whether it leaves any out."""
    total = lines.filter(matches(F.col("text"), symbol, regex)).agg(F.count("*").alias("total"))
    return total.select("total", F.least("total", F.lit(limit).cast("long")).alias("shown"), (F.col("total") > limit).alias("truncated"))
