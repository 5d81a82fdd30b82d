"""The code graph: symbols and references from text, resolved edges, lookups and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.ids import edge_id, symbol_id
from lorekeep.functions.text import name_similarity, redact, trim
from lorekeep.operators.intervals import best_around, holders
from lorekeep.operators.running import MOST_ROWS, running

SAME_FILE, SINGLE_MATCH, AMBIGUOUS_MATCH = 1.0, 0.95, 0.85
#: Lines that are longer, and calls of a file beyond so many, are left out unless a caller says otherwise.
LONGEST_LINE, MOST_CALLS = 400, 200
#: Declaring words and the kinds they declare.
KEYWORDS = {
    "class": "class", "struct": "class", "object": "class", "record": "class", "actor": "class", "contract": "class",
    "module": "class", "defmodule": "class", "namespace": "class", "interface": "interface", "protocol": "interface",
    "trait": "interface", "typeclass": "interface", "enum": "enum", "type": "type", "typedef": "type", "data": "type",
    "newtype": "type", "def": "function", "defp": "function", "defn": "function", "defun": "function",
    "function": "function", "func": "function", "fn": "function", "sub": "function", "proc": "function", "method": "method",
}
#: What stands before a parenthesis and isn't a call.
NOT_CALLS = (
    "if for while switch catch return with else elsif unless until when case do end and not or sizeof typeof defined "
    "print printf echo assert require import include new delete throw super self this"
).split() + list(KEYWORDS)
#: Languages by file extension.
LANGUAGES = {
    "c": "c h", "cpp": "cc cpp cxx hpp hh", "csharp": "cs", "java": "java", "kotlin": "kt kts", "swift": "swift",
    "objective-c": "m mm", "scala": "scala", "php": "php", "perl": "pl pm", "lua": "lua", "r": "r", "julia": "jl",
    "dart": "dart", "elixir": "ex exs", "erlang": "erl", "clojure": "clj cljs cljc", "haskell": "hs", "ocaml": "ml mli",
    "fsharp": "fs fsx", "groovy": "groovy gradle", "shell": "sh bash zsh", "powershell": "ps1 psm1", "sql": "sql",
    "zig": "zig", "nim": "nim", "crystal": "cr", "solidity": "sol", "vala": "vala", "python": "py", "go": "go",
    "rust": "rs", "ruby": "rb", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs",
}
#: Lines that declare, lines that open a callable, and calls.
DECLARATION = r"^[\t ]*(?:[A-Za-z0-9_@\[\]]+[\t ]+){0,3}(" + "|".join(KEYWORDS) + r")[\t ]+([A-Za-z_][A-Za-z0-9_]*)"
CALLABLE = r"^[\t ]*(?:[A-Za-z_][A-Za-z0-9_:<>,.\[\]*&\t ]*[\t *&]+)?([A-Za-z_][A-Za-z0-9_]*)[\t ]*\([^;=]*\)[\t ]*(?:const[\t ]*)?\{[\t ]*$"
CALL = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,})[\t ]*\("


def language(path: Column) -> Column:
    """Language by extension, null if it isn't known."""
    known = F.create_map(*(F.lit(x) for name, ends in LANGUAGES.items() for e in ends.split() for x in (e, name)))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def source_lines(files: DataFrame) -> DataFrame:
    """file, line, text of files (file, source)."""
    return files.select("file", F.posexplode(F.split("source", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def _no_longer(text: Column, longest: int | None) -> Column:
    return F.lit(True) if longest is None else F.length(text) <= longest


def declarations(lines: DataFrame, longest: int | None = LONGEST_LINE) -> DataFrame:
    """file, line, name, kind, text of the declarations that patterns find in lines of at most ``longest`` characters (None: all)."""
    text = F.col("text")
    keyword, named, callable_ = F.regexp_extract(text, DECLARATION, 1), F.regexp_extract(text, DECLARATION, 2), F.regexp_extract(text, CALLABLE, 1)
    kinds = F.create_map(*(F.lit(x) for pair in KEYWORDS.items() for x in pair))
    found = lines.filter(_no_longer(text, longest)).select("file", "line", "text", keyword.alias("keyword"), named.alias("named"), callable_.alias("callable"))
    by_word = (F.col("keyword") != "") & ~F.col("named").isin(*KEYWORDS)
    by_form = (F.col("keyword") == "") & (F.col("callable") != "") & ~F.col("callable").isin(*NOT_CALLS)
    return found.filter(by_word | by_form).select("file", "line", F.when(by_word, F.col("named")).otherwise(F.col("callable")).alias("name"), F.when(by_word, F.element_at(kinds, F.nullif("keyword", F.lit("")))).otherwise("function").alias("kind"), "text")


def calls(lines: DataFrame, longest: int | None = LONGEST_LINE, most: int | None = MOST_CALLS) -> DataFrame:
    """file, line, name of calls in lines of at most ``longest`` characters, from the first lines of a file that hold ``most`` of them (None: all)."""
    text = F.col("text")
    rows = lines.filter(_no_longer(text, longest) & ~text.rlike(DECLARATION) & ~text.rlike(CALLABLE))
    rows = rows.select("file", "line", F.filter(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), lambda n: ~n.isin(*NOT_CALLS)).alias("names")).filter(F.size("names") > 0)
    if most is not None:
        rows = running(rows, ["file"], ["line"], sums={"upto": F.size("names")}).filter(F.col("upto") - F.size("names") < most)
    return rows.select("file", "line", F.explode("names").alias("name"))


def symbols(found: DataFrame, project: str) -> DataFrame:
    """Vertices of declarations; of overloads in a file the first stays."""
    rows = found.withColumn("id", symbol_id(F.lit(project), F.col("file"), F.col("name"), F.col("kind")))
    first = rows.groupBy("id").agg(F.min(F.struct("line", "file", "name", "kind", "text")).alias("s"))
    return first.select("id", F.lit(project).alias("project"), "s.name", "s.kind", "s.file", "s.line", language(F.col("s.file")).alias("lang"), F.substring(redact(trim(F.col("s.text"))), 1, 200).alias("signature"))


def nearest_above(references: DataFrame, spans: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """References (file, line, ...) with from_id and from_name: the last declaration at or above the line; of several on one line the greatest id.

    An as-of join by one sort of both sides, so a long file costs no pairs; a very long one is dealt over many tasks."""
    mark = spans.select("file", "line", F.lit(0).alias("late"), F.struct("id", "name").alias("span"))
    rows = references.select(F.struct(*references.columns).alias("reference"), "file", "line", F.lit(1).alias("late")).unionByName(mark, allowMissingColumns=True)
    placed = running(rows, ["file"], ["line", "late", "span"], lasts={"last": F.col("span")}, most_rows=most_rows).filter("late = 1")
    return placed.select("reference.*", F.col("last.id").alias("from_id"), F.col("last.name").alias("from_name"))


def enclosing(references: DataFrame, spans: DataFrame, key: str = "ref_id") -> DataFrame:
    """key, span_id: the narrowest span of the file around each line; callables before other spans.

    No pairs of lines and spans are formed (see intervals.best_around)."""
    ranked = spans.select("file", "start", "end", "span_id", (~F.col("callable")).alias("other"), (F.col("end") - F.col("start")).alias("width"))
    return best_around(references, ranked, key, "span_id", ["other", "width", "span_id"])


def resolve(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (ref_id, file, line, name, relation, weak) with dst_id, confidence and score.

    A symbol of the same file wins; else the first of the name, by id. Names are counted before the
    join, so a name with many symbols meets each reference once. Weak references without a symbol go."""
    by_name = known.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    by_file = known.groupBy("name", "file").agg(F.min("id").alias("local"))
    rows = references.join(by_name, "name", "left").join(by_file, ["name", "file"], "left")
    rows = rows.filter(F.col("n").isNotNull() | ~F.col("weak"))
    elsewhere = F.col("local").isNull() & F.col("n").isNotNull()
    return rows.select(
        *references.columns,
        F.coalesce(F.col("local"), F.col("first")).alias("dst_id"),
        F.when(elsewhere, "INFERRED").otherwise("EXTRACTED").alias("confidence"),
        F.when(~elsewhere, SAME_FILE).when(F.col("n") == 1, SINGLE_MATCH).otherwise(AMBIGUOUS_MATCH).alias("score"),
    )


def merge_member_calls(edges: DataFrame) -> DataFrame:
    """Edges (edge_id, file, line, dst_name, dst_id, relation, confidence, score) where a call ``x.f`` takes over
    what the bare ``f`` of the same line and relation resolved to, and the bare one goes.

    The edges are sorted once, by file, line, relation and tail; where one of these is null, none meets another."""
    qualified, key = F.col("dst_name").contains("."), ["file", "line", "relation", "__tail"]
    known = F.col("file").isNotNull() & F.col("line").isNotNull() & F.col("relation").isNotNull()
    group = Window.partitionBy(*key)
    bare = F.when(known & ~qualified & F.col("dst_id").isNotNull(), F.struct("edge_id", "dst_id", "confidence", "score"))
    rows = edges.filter("dst_name is not null").withColumn("__tail", F.substring_index("dst_name", ".", -1))
    met = rows.select("*", F.min(bare).over(group).alias("__bare"), F.max(known & qualified).over(group).alias("__taken"))
    fresh = F.col("dst_id").isNull() & F.col("__bare").isNotNull() & qualified
    merged = [F.when(fresh, F.col(f"__bare.{c}")).otherwise(F.col(c)).alias(c) if c in ("dst_id", "confidence", "score") else F.col(c) for c in edges.columns]
    return met.filter(qualified | ~F.col("__taken")).select(*merged)


def edges_of(references: DataFrame, known: DataFrame, project: str) -> DataFrame:
    """Resolved and merged edges of references that carry from_id and from_name."""
    name = F.coalesce("from_name", "file")
    rows = references.withColumn("src_name", name).withColumn("edge_id", edge_id(F.lit(project), F.col("file"), F.col("line"), name, F.col("name"), F.col("relation")))
    found = resolve(rows, known).select("edge_id", F.coalesce("from_id", F.lit("")).alias("src_id"), "src_name", "dst_id", F.col("name").alias("dst_name"), "relation", "confidence", "score", "file", "line")
    return merge_member_calls(found.dropDuplicates(["edge_id"]))


def usages(edges: DataFrame, known: DataFrame, symbol: str) -> DataFrame:
    """Edges that reach ``symbol``: by its name, as a member, or by one of its definitions."""
    ids = known.filter(F.col("name") == symbol).select(F.col("id").alias("dst_id"))
    by_name = edges.filter((F.col("dst_name") == symbol) | (F.substring_index("dst_name", ".", -1) == symbol))
    return by_name.unionByName(edges.join(ids, "dst_id", "left_semi").select(*edges.columns)).distinct()


def explain(edges: DataFrame, known: DataFrame, symbol: str) -> DataFrame:
    """Edges that leave a definition of ``symbol``, but for those to itself."""
    ids = known.filter(F.col("name") == symbol).select(F.col("id").alias("src_id"))
    return edges.join(ids, "src_id", "left_semi").filter(F.col("dst_name") != symbol).select(*edges.columns)


def suggest(names: DataFrame, symbol: str, limit: int = 5, least: float = 40.0) -> DataFrame:
    """name, similarity: the nearest names, best first, shorter ones before longer, and then as a reader would order
    them: by letter, accent and case in turn, by the root collation."""
    rows = names.select("name").distinct().filter((F.col("name") != symbol) & (F.length("name") >= 3))
    scored = rows.withColumn("similarity", name_similarity(F.col("name"), F.lit(symbol))).filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), F.length("name"), F.collate(F.col("name"), "UNICODE"), "name").limit(limit)


def find_symbols(known: DataFrame, name: str | None = None, file: str | None = None, limit: int | None = 500) -> DataFrame:
    """Symbols of a name, a file or both, by file and line."""
    for column, value in (("name", name), ("file", file)):
        if value is not None:
            known = known.filter(F.col(column) == value)
    rows = known.orderBy("file", "line", "id")
    return rows if limit is None else rows.limit(limit)


def find_edges(edges: DataFrame, src_ids: DataFrame | None = None, dst_ids: DataFrame | None = None) -> DataFrame:
    """Edges that leave one of ``src_ids`` (id) or reach one of ``dst_ids`` (id), each once; all without either."""
    sides = [("src_id", src_ids), ("dst_id", dst_ids)]
    for side, ids in sides:
        if ids is not None:
            edges = edges.join(ids.select(F.col("id").alias(side), F.lit(True).alias(f"by_{side}")).distinct(), side, "left")
    hits = [F.coalesce(F.col(f"by_{side}"), F.lit(False)) for side, ids in sides if ids is not None]
    if hits:
        edges = edges.filter(reduce(lambda a, b: a | b, hits))
    return edges.drop("by_src_id", "by_dst_id")


def without_files(rows: DataFrame, project: str, files: DataFrame | None = None, column: str = "file") -> DataFrame:
    """A table of the graph without a project's rows, or without those of the ``files`` (file) of it."""
    if files is None:
        return rows.filter(~F.col("project").eqNullSafe(F.lit(project)))
    gone = files.select(F.col("file").alias(column), F.lit(project).alias("project")).distinct()  # a row that stays would be held against each copy
    return rows.join(gone, ["project", column], "left_anti").select(rows.columns)


def labelled(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """``nodes`` with a label: the name of the symbol that a node is, else the node itself."""
    names = known.select(F.col("id").alias("node"), F.col("name").alias("__name"))
    return nodes.join(names, "node", "left").withColumn("label", F.coalesce("__name", F.col("node").cast("string"))).drop("__name")


def contained(spans: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """span_id, parent_id: the narrowest other span of the file that holds a whole span; of equal spans the next smaller id.

    Spans must nest. No pairs of spans are formed (see intervals.holders)."""
    return holders(spans, most_rows=most_rows)
