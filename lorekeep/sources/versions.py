"""Several tables under one manifest, so that a change of all of them becomes visible at once.

Data is written beside what is there, in folders of its own. A commit writes one small file, the manifest of the next
version, which names the folders of every table; it exists as a whole or not at all, and only one writer can make
version n. Readers pin a version. A job that dies before its commit leaves folders that no manifest names, which ``vacuum``
removes. Everything goes through Hadoop's file system, so a folder may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removed keys are broadcast up to this number; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Segments of about one size that are merged into one.
FAN = 8


class Conflict(RuntimeError):
    """Another writer made the version that a commit was to make."""


class Files:
    """Small files of one folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder: str = "") -> list[str]:
        place = self._path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(place)) if self.system.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file that is there as a whole or not at all; False if it exists already."""
        if self.system.exists(self._path(name)):
            return False
        draft = f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}".lstrip("/")
        stream = self.system.create(self._path(draft), False)
        stream.write(text.encode())
        stream.close()
        keep = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = keep
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf) if ":" in self.folder else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        try:
            context.rename(self._path(draft), self._path(name), options)  # fails if the name was taken meanwhile
        except Exception:
            self.system.delete(self._path(draft), False)
            if self.system.exists(self._path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.system.delete(self._path(name), True)


class Versions:
    """Versions of a folder's tables. A state is a JSON object; its ``folders`` name what data it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    def latest(self) -> int:
        """The number of the newest version; 0 before the first commit."""
        return max((int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict[str, Any]:
        version = self.latest() if version is None else version
        return json.loads(self.files.read(f"versions/{version:012d}.json")) if version else {}

    def new_folder(self, name: str) -> str:
        """A folder for data that no version names yet, below ``folder``."""
        return f"data/{name}-{uuid.uuid4().hex}"

    def path(self, folder: str) -> str:
        return f"{self.folder}/{folder}"

    def commit(self, state: dict[str, Any], after: int) -> int:
        """Makes ``state`` the version that follows ``after``."""
        if not self.files.create(f"versions/{after + 1:012d}.json", json.dumps(state)):
            raise Conflict(f"version {after + 1} of {self.folder} exists")
        return after + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all versions but the last ``keep``, and data that these don't name. No writer may be at work."""
        newest = self.latest()
        held, gone = set(), []
        for name in self.files.names("versions"):
            if name.endswith(".json") and int(name.removesuffix(".json")) > newest - keep:
                held |= set(_folders(json.loads(self.files.read(f"versions/{name}"))))
            else:
                self.files.delete(f"versions/{name}")
        for name in self.files.names("data"):
            if f"data/{name}" not in held:
                self.files.delete(f"data/{name}")
                gone.append(f"data/{name}")
        return gone


def _folders(state: Any) -> list[str]:
    """All folders that a state names, at any depth."""
    if isinstance(state, dict):
        return [f for v in state.values() for f in _folders(v)]
    if isinstance(state, list):
        return [f for v in state for f in _folders(v)]
    return [state] if isinstance(state, str) and state.startswith("data/") else []


def ddl(df: DataFrame) -> str:
    """The columns of a table as text that ``schema`` takes."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Tables:
    """Named tables of keyed rows, changed together.

    A table is a list of segments, each with the rows of one change and the keys that the change took out of the earlier
    segments. A change costs what it writes, however large the table is; a read joins the removed keys once. ``merge`` keeps
    the list short: it merges the last segments when there are FAN of about one size, so each row is written some log n times."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self.versions.state(version).get("tables", {}))

    def mark(self, name: str, version: int | None = None) -> Any:
        """What a change noted under a name (see ``change``); None before any did."""
        return self.versions.state(version).get("marks", {}).get(name)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as of a version (the newest if None)."""
        table = self.versions.state(version).get("tables", {}).get(name)
        if table is None:
            raise KeyError(name)
        return self._live(table, table["segments"])

    def _live(self, table: dict[str, Any], segments: list[dict[str, Any]]) -> DataFrame:
        """The rows of consecutive segments without those that a later one of them removed."""
        live = []
        for at, segment in enumerate(segments):
            if not segment["rows"]:
                continue
            rows = self.spark.read.schema(table["schema"]).parquet(self.versions.path(segment["rows"]))
            if later := [s for s in segments[at + 1 :] if s["removed"]]:
                gone = self._removed(table, later).select([F.col(k).alias(f"__{k}") for k in table["keys"]])
                if sum(s["n_removed"] for s in later) <= BROADCAST_KEYS:  # counted when they were written
                    gone = F.broadcast(gone)
                same = F.lit(True)
                for k in table["keys"]:
                    same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
                rows = rows.join(gone, same, "left_anti")
            live.append(rows)
        found = live[0] if live else self.spark.createDataFrame([], table["schema"])
        for rows in live[1:]:
            found = found.unionByName(rows)
        return found

    def _removed(self, table: dict[str, Any], segments: list[dict[str, Any]]) -> DataFrame:
        return self.spark.read.schema(table["key_schema"]).parquet(*(self.versions.path(s["removed"]) for s in segments))

    def change(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None, list[str]]], after: int | None = None, marks: dict[str, Any] | None = None) -> int:
        """One commit for several tables: name to (new rows, removed keys, key columns).

        New rows replace what has their key; a row whose key is in ``removed`` goes; either may be None. Without new
        rows the key columns are the table's. ``marks`` are noted in the same commit. ``after`` is
        the version that the change was worked out from: if there is a newer one, Conflict is raised and nothing changes."""
        after = self.versions.latest() if after is None else after
        state = self.versions.state(after)
        tables = dict(state.get("tables", {}))
        for name, (rows, removed, keys) in changes.items():
            table = dict(tables.get(name) or {})
            if rows is not None:
                table |= {"schema": ddl(rows), "keys": keys, "key_schema": ddl(rows.select(keys))}
            elif not table:
                raise KeyError(name)
            keys = table["keys"]
            segment: dict[str, Any] = {"rows": None, "removed": None, "n_rows": 0, "n_removed": 0}
            if rows is not None:
                segment["rows"], segment["n_rows"] = self._write(rows, name)
                stored = self.spark.read.schema(table["schema"]).parquet(self.versions.path(segment["rows"])).select(keys)
                removed = stored if removed is None else stored.unionByName(removed.select(keys))
            if removed is not None and table.get("segments"):
                segment["removed"], segment["n_removed"] = self._write(removed.select(keys).distinct(), f"{name}-removed")
            tables[name] = table | {"segments": [*table.get("segments", []), segment]}
        return self.versions.commit(state | {"tables": tables, "marks": state.get("marks", {}) | (marks or {})}, after)

    def merge(self, *names: str, everything: bool = False) -> int:
        """The last segments of each table as one, where FAN of them are of one size class (or all, if asked); one commit."""
        after = self.versions.latest()
        state = self.versions.state(after)
        tables, merged = dict(state.get("tables", {})), False
        for name in names or list(tables):
            table = tables[name]
            segments = table["segments"]
            while len(segments) > 1 and (start := 0 if everything else _tail(segments)) is not None:
                run = segments[start:]
                new: dict[str, Any] = {"removed": None, "n_removed": 0}
                new["rows"], new["n_rows"] = self._write(self._live(table, run), name)
                if start and (cut := [s for s in run if s["removed"]]):
                    new["removed"], new["n_removed"] = self._write(self._removed(table, cut).distinct(), f"{name}-removed")
                segments, merged = [*segments[:start], new], True
            tables[name] = table | {"segments": segments}
        return self.versions.commit(state | {"tables": tables}, after) if merged else after

    def _write(self, df: DataFrame, name: str) -> tuple[str, int]:
        folder = self.versions.new_folder(name)
        df.write.parquet(self.versions.path(folder))
        return folder, self.spark.read.parquet(self.versions.path(folder)).count()


def _tail(segments: list[dict[str, Any]]) -> int | None:
    """Where the run of last segments starts that are of one size class or smaller, if they are FAN or more."""
    sizes = [int(math.log(max(1, s["n_rows"] + s["n_removed"]), FAN)) for s in segments]
    start = len(sizes) - 1
    while start and sizes[start - 1] <= max(sizes[start:]):
        start -= 1
    return start if len(sizes) - start >= FAN else None
