"""Schemas of the stored tables. Times are epoch milliseconds."""

from __future__ import annotations

SESSION = "id string, project string, started_at bigint, ended_at bigint, summary string"
OBSERVATION = (
    "id string, session_id string, project string, kind string, title string, body string, files array<string>, "
    "tags array<string>, created_at bigint, embedding array<float>, embedder string, author string, status string"
)
SYMBOL = "id string, project string, name string, kind string, file string, line int, lang string, signature string"
EDGE = (
    "id string, project string, src_id string, src_name string, dst_id string, dst_name string, relation string, "
    "confidence string, score double, file string, line int"
)
SCANNED_FILE = "project string, path string, hash string, scanned_at bigint"

#: Fixed values.
OBSERVATION_KINDS = ("decision", "pattern", "bugfix", "context", "deadend", "preference")
STATUSES = ("open", "done")
SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "enum", "variable")
CONFIDENCES = ("EXTRACTED", "INFERRED")
