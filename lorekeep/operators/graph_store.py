"""The code graph as stored tables that follow their files.

Four tables change in one commit (see sources.versions): ``files`` with their hashes, ``symbols``, ``refs`` (references as they
were read) and ``edges`` (references as they resolve). A refresh reads the files whose hash changed, and resolves
again the references of these files, and those anywhere whose name lost or won a symbol; all else stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph
from lorekeep.operators.store import changes
from lorekeep.session import stored
from lorekeep.sources.versions import Tables

FILES = "project string, file string, hash string"
REFS = "project string, file string, line int, name string, relation string, weak boolean, from_id string, from_name string"
SYMBOLS = "id string, project string, name string, kind string, file string, line int, lang string, signature string"
EDGES = "edge_id string, src_id string, src_name string, dst_id string, dst_name string, relation string, confidence string, score double, file string, line int, project string"
#: What a table's rows are replaced by.
KEYS = {"files": ["project", "file"], "symbols": ["project", "file"], "refs": ["project", "file"], "edges": ["project", "file", "line"]}
_SCHEMAS = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "edges": EDGES}


class CodeGraph:
    """The graph of one project in a store of tables, which other projects may share."""

    def __init__(self, spark: SparkSession, store: Tables, project: str):
        self.spark, self.store, self.project = spark, store, project

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The project's rows of a table; none before the first commit."""
        if name not in self.store.names(version):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.store.read(name, version).filter(F.col("project") == self.project)

    def upsert(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, refs: DataFrame | None = None, removed: DataFrame | None = None, stale: DataFrame | None = None, after: int | None = None) -> int:
        """One commit: the rows of ``files``' files are replaced in all tables, those of ``removed`` (file) go, and so do the
        edges of ``stale`` (file, line), which new ones take the place of."""
        own = F.lit(self.project).alias("project")
        gone = files.select(own, "file")
        if removed is not None:
            gone = gone.unionByName(removed.select(own, "file"))
        lines = self.read("edges", after).join(gone.select("file").distinct(), "file", "left_semi").select("project", "file", "line").distinct()
        if stale is not None:
            lines = lines.unionByName(stale.select(own, "file", "line"))
        change = {"files": (files.select(own, "file", "hash"), gone, KEYS["files"]), "symbols": (symbols.select(_names(SYMBOLS)), gone, KEYS["symbols"]), "edges": (edges.select(*(c for c in _names(EDGES) if c != "project"), own).select(_names(EDGES)), lines, KEYS["edges"])}
        if refs is not None:
            change["refs"] = (refs.select(own, *(c for c in _names(REFS) if c != "project")).select(_names(REFS)), gone, KEYS["refs"])
        return self.store.change(change, after)

    def refresh(self, files: DataFrame, longest: int | None = graph.LONGEST_LINE, most: int | None = graph.MOST_CALLS) -> dict[str, int]:
        """Brings the graph up to ``files`` (file, source, hash); how many files were read and dropped, and references resolved.

        ``files`` is worked out twice, for the hashes and for the lines; lines are dealt over all tasks, however few files there are."""
        after = self.store.versions.latest()
        hashes = stored(files.select("file", "hash"), "hashes")
        known = stored(changes(self.read("files", after), hashes, "file", "hash"), "changed")
        sizes = {r["change"]: r["n"] for r in known.groupBy("change").agg(F.count("*").alias("n")).collect()}  # three values
        if not sizes:
            return {"read": 0, "dropped": 0, "resolved": 0}
        changed, dropped = known.filter("change <> 'deleted'").select("file"), known.filter("change = 'deleted'").select("file")
        fresh = hashes.join(changed, "file", "left_semi")
        lines = stored(graph.source_lines(files.join(changed, "file", "left_semi")).repartition("file", "line"), "lines")
        symbols = stored(graph.symbols(graph.declarations(lines, longest), self.project), "symbols")
        called = stored(graph.calls(lines, longest, most).select("file", "line", "name", F.lit("calls").alias("relation"), F.lit(True).alias("weak")), "called")
        refs = stored(graph.nearest_above(called, symbols), "refs")

        # A name resolves anew where its set of symbols is no longer the same.
        before = self.read("symbols", after).join(known.select("file"), "file", "left_semi")
        names = stored(before.select("id", "name").join(symbols.select("id"), "id", "left_anti").unionByName(symbols.select("id", "name").join(before.select("id"), "id", "left_anti")).select("name").distinct(), "names")
        kept = self.read("refs", after).join(known.select("file"), "file", "left_anti").drop("project")
        stale = stored(kept.join(names, "name", "left_semi").select("file", "line").distinct(), "stale")  # calls of one line may merge
        again = stored(refs.unionByName(kept.join(stale, ["file", "line"], "left_semi").select(refs.columns)), "again")
        now = self.read("symbols", after).join(known.select("file"), "file", "left_anti").unionByName(symbols)
        edges = graph.edges_of(again, now.join(again.select("name").distinct(), "name", "left_semi"), self.project)
        self.upsert(fresh, symbols, edges, refs, dropped, stale, after)
        return {"read": sizes.get("added", 0) + sizes.get("changed", 0), "dropped": sizes.get("deleted", 0), "resolved": again.count()}

    def remove(self, files: DataFrame | None = None) -> int:
        """One commit: all tables without ``files`` (file), or without the project; returns how many symbols went."""
        after = self.store.versions.latest()
        rows = {name: self.read(name, after) for name in KEYS if name in self.store.names(after)}
        if files is not None:
            rows = {name: r.join(files.select("file"), "file", "left_semi") for name, r in rows.items()}
        gone = rows["symbols"].count() if "symbols" in rows else 0
        self.store.change({name: (None, r.select(KEYS[name]).distinct(), []) for name, r in rows.items()}, after)
        return gone


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def wipe(store: Tables, project: str | None = None) -> int:
    """One commit: every table without a project's rows, or without any; tables without a project column lose theirs in the latter case alone."""
    after = store.versions.latest()
    change = {}
    for name in store.names(after):
        rows = store.read(name, after)
        if project is not None and "project" not in rows.columns:
            continue
        keys = store.versions.state(after)["tables"][name]["keys"]
        change[name] = (None, (rows if project is None else rows.filter(F.col("project").eqNullSafe(F.lit(project)))).select(keys).distinct(), [])
    return store.change(change, after)
