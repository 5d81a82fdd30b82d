"""Conversation logs: JSON lines, one file for each session.

A line's offset is the byte it begins at, and above that the generation of its file: a log that is rotated begins anew under
the same name, and its lines must not take the place of those read before. A session is named by its file's path below the
folder, without the suffix.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "session_id string, offset long, value string"
#: Bits of an offset below the generation: logs of up to a tebibyte.
PLACE_BITS = 40
#: Bytes that one task reads, and bytes that are read at once.
PIECE, BLOCK = 64 << 20, 1 << 20


def _session(spark: SparkSession, path: str, file_path: Column) -> Column:
    """The session of a file below ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    plain = F.url_decode(F.regexp_replace(file_path, r"\+", "%2B"))
    below = F.substring_index(plain, f"{root}/", -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, offset and value of every line below ``path``, as the stream of a first generation gives them."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(path)
    rows = lines.select(_session(spark, path, F.col("_metadata.file_path")).alias("session_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    before = Window.partitionBy("session_id").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("session_id", F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0)).cast("long").alias("offset"), "value")


def sessions_on_disk(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return files.select(_session(spark, path, F.col("path")).alias("session_id"), "length", "modificationTime").distinct()


def project_of(entries: DataFrame) -> DataFrame:
    """session_id, project: the first working folder that a session's lines name."""
    folder = F.try_variant_get(F.try_parse_json("value"), "$.cwd", "string")
    return entries.select("session_id", "offset", folder.alias("cwd")).filter("cwd is not null").groupBy("session_id").agg(F.min_by("cwd", "offset").alias("project"))


class _Piece(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int, skip: bool):
        self.path, self.generation, self.start, self.end, self.skip = path, generation, start, end, skip


class _Tail(DataSourceStreamReader):
    """Reads what was appended to files. The offset of the stream is the generation of each file and the place reached in it.

    A file's generation ends when its first line is another one, or when it became shorter. Which ones there were is noted in
    a folder beside the stream's data, as the source may not look at its last offset when it looks at the files."""

    def __init__(self, folder: str, notes: str):
        self.system, self.root = _opened(folder)
        self.notes_system, self.notes = _opened(notes)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for info in self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(".jsonl"):
                with self.system.open_input_file(info.path) as file:
                    whole = _whole_lines(file, info.size)
                    first = _first_line(file, whole)
                found[info.path] = [self._generation(info.path, first, whole), whole]
        return dict(sorted(found.items()))

    def _generation(self, path: str, first: str | None, whole: int) -> int:
        """The number of the file's generation; notes a new one."""
        name = f"{self.notes}/{hashlib.sha256(path.encode()).hexdigest()[:32]}.json"
        noted = []
        if self.notes_system.get_file_info(name).type == fs.FileType.File:
            with self.notes_system.open_input_file(name) as file:
                noted = json.loads(file.read())
        before = json.dumps(noted)
        if first is None:
            return max(0, len(noted) - 1)
        if not noted or noted[-1][0] != first or noted[-1][1] > whole:
            noted.append([first, whole])
        noted[-1][1] = whole
        if json.dumps(noted) != before:
            self.notes_system.create_dir(self.notes, recursive=True)
            with self.notes_system.open_output_stream(f"{name}.new") as file:
                file.write(json.dumps(noted).encode())
            self.notes_system.move(f"{name}.new", name)
        return len(noted) - 1

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        pieces = []
        for path, (generation, to) in end.items():
            old, at = start.get(path, [generation, 0])
            first = at if old == generation else 0
            pieces += [_Piece(path, generation, i, min(i + PIECE, to), i > first) for i in range(first, to, PIECE)]
        return pieces

    def read(self, partition: _Piece) -> Iterator[tuple]:
        """The lines that begin within the piece."""
        session = partition.path.removeprefix(self.root).lstrip("/").rpartition(".")[0]
        with self.system.open_input_file(partition.path) as file:
            at = partition.start
            file.seek(at - 1 if partition.skip else at)
            if partition.skip:
                at += len(_line(file, rest := bytearray())) - 1
            else:
                rest = bytearray()
            while at < partition.end:
                line = _line(file, rest)
                if not line:
                    break
                yield session, partition.generation << PLACE_BITS | at, line.decode("utf-8", "replace").rstrip("\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (``s3://``, ``hdfs://``, ``file://``, ... or a plain path) and the path in it."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return system, path.rstrip("/")


def _line(file, rest: bytearray) -> bytes:
    """The next line with its break; ``rest`` holds what was read beyond it."""
    cut = rest.find(b"\n")
    while cut < 0:
        block = file.read(BLOCK)
        if not block:
            break
        searched = len(rest)
        rest += block
        cut = rest.find(b"\n", searched)
    line = bytes(rest[: cut + 1] if cut >= 0 else rest)
    del rest[: len(line)]
    return line


def _whole_lines(file, size: int) -> int:
    """Bytes up to the last line break: a line that is still being written waits."""
    while size > 0:
        start = max(0, size - 65_536)
        file.seek(start)
        cut = file.read(size - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        size = start
    return 0


def _first_line(file, whole: int) -> str | None:
    """A hash of the first line, as far as BLOCK bytes; None if there is none yet."""
    if not whole:
        return None
    file.seek(0)
    return hashlib.sha256(file.read(min(whole, BLOCK)).partition(b"\n")[0]).hexdigest()


class TranscriptSource(DataSource):
    """``spark.readStream.format("transcripts").load(folder)``: appended lines of JSON-lines files, on a path or address all executors share.

    The built-in text source reads a file once and ignores what is appended to it later. The option ``notes`` names the
    folder where generations are noted; ``.generations`` below the logs if it isn't set."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Tail:
        folder = self.options["path"]
        return _Tail(folder, self.options.get("notes") or f"{folder.rstrip('/')}/.generations")
