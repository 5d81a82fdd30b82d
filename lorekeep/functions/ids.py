"""Identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT, FULL = 13, 36
NUL = "\u0000"


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters of ``text`` (of the basic plane)."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def scope_token(project: Column) -> Column:
    """A word that stands for a project in a text index."""
    return F.concat(F.lit("scope"), F.lower(F.conv(fnv1a32(project).cast("string"), 10, 36)))


def content_id(session: Column, timestamp: Column, seed: Column) -> Column:
    """An id in the form of a UUID that the content alone decides, so that a repeated write replaces."""
    h = F.sha2(F.concat_ws(" ", session, timestamp.cast("string"), seed), 256)
    return F.concat_ws("-", *(F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def symbol_id(project: Column, file: Column, name: Column, kind: Column) -> Column:
    return content_id(F.lit("graph"), F.lit(0), F.concat_ws(NUL, project, file, name, kind))


def edge_id(project: Column, file: Column, line: Column, src: Column, dst: Column, relation: Column) -> Column:
    """Edges of different relations on one line differ."""
    return content_id(F.lit("graph"), F.lit(0), F.concat_ws(NUL, project, file, line.cast("string"), src, dst, relation))


def short_id(full: Column) -> Column:
    return F.substring(full, 1, SHORT)


def matches_ids(column: Column, ids: list[str]) -> Column:
    """Whole ids match exactly, shorter ones as prefixes; wildcards mean themselves."""
    found = column.isin([i for i in ids if len(i) >= FULL]) if any(len(i) >= FULL for i in ids) else F.lit(False)
    for prefix in (i for i in ids if 0 < len(i) < FULL):
        found = found | column.startswith(prefix)
    return found


def file_hash(content: Column, version: str) -> Column:
    """Hash of a file's bytes and of the rules that read it; new rules make every file new."""
    return F.substring(F.sha2(F.concat(F.encode(F.lit(f"v{version}\n"), "utf-8"), content), 256), 1, 32)
