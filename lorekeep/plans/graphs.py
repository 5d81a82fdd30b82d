"""Graph and text-usage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph, paths, usages
from lorekeep.operators.graph_store import CodeGraph, wipe
from lorekeep.operators.report import adoption as adoption_counts
from lorekeep.plans.catalog import query, table
from lorekeep.session import shared_folder
from lorekeep.sources.versions import Tables

SYMBOL = "red widget"

_KNOWN = "known AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_partkey AS line FROM part)"
_REFERENCES = """refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, 'Brand#' || CAST(l_suppkey % 30 AS VARCHAR) AS file, l_orderkey AS line,
    CASE WHEN l_returnflag = 'R' THEN 'lost ' || p_name ELSE p_name END AS name, l_linestatus AS relation, l_discount > 0.05 AS weak FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: the brand is the file."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references to their part's name."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"),
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("file"),
        F.col("l_orderkey").alias("line"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("lost "), F.col("p_name"))).otherwise(F.col("p_name")).alias("name"),
        F.col("l_linestatus").alias("relation"),
        (F.col("l_discount") > 0.05).alias("weak"),
    )


_RESOLVED = f"""{_KNOWN}, {_REFERENCES}, bn AS (SELECT name, count(*) AS n, min(id) AS first FROM known GROUP BY name), bf AS (SELECT name, file, min(id) AS own FROM known GROUP BY name, file),
    resolved AS (SELECT ref_id, r.file, line, r.name, relation, coalesce(own, first) AS dst_id,
        CASE WHEN own IS NULL AND n IS NOT NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence,
        CASE WHEN own IS NOT NULL OR n IS NULL THEN 1.0 WHEN n = 1 THEN 0.95 ELSE 0.85 END AS score
        FROM refs r LEFT JOIN bn ON r.name = bn.name LEFT JOIN bf ON r.name = bf.name AND r.file = bf.file WHERE n IS NOT NULL OR NOT weak)"""


@query(f"WITH {_RESOLVED} SELECT ref_id, dst_id, confidence, CAST(score AS DOUBLE) AS score FROM resolved")
def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved to symbols: same file, one match, many, none."""
    return graph.resolve(_references(spark, sf_dir), _known(spark, sf_dir)).select("ref_id", "dst_id", "confidence", "score")


_EDGES = """edges AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS edge_id, 'f' AS file, l_orderkey AS line, CASE WHEN l_linestatus = 'O' THEN 'x.' || p_type ELSE p_type END AS dst_name,
    CASE WHEN l_linestatus = 'F' THEN l_partkey END AS dst_id, 'calls' AS relation, 'c' || CAST(l_linenumber AS VARCHAR) AS confidence, l_discount AS score FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines, is_open = table(spark, sf_dir, "lineitem").join(parts, "l_partkey"), F.col("l_linestatus") == "O"
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"),
        F.lit("f").alias("file"),
        F.col("l_orderkey").alias("line"),
        F.when(is_open, F.concat(F.lit("x."), F.col("p_type"))).otherwise(F.col("p_type")).alias("dst_name"),
        F.when(~is_open, F.col("l_partkey")).alias("dst_id"),
        F.lit("calls").alias("relation"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("confidence"),
        F.col("l_discount").alias("score"),
    )


@query(f"""WITH {_EDGES}, bare AS (SELECT line, dst_name AS tail, arg_min(dst_id, (edge_id, dst_id, confidence, score)) AS b_dst, arg_min(confidence, (edge_id, dst_id, confidence, score)) AS b_confidence,
        arg_min(score, (edge_id, dst_id, confidence, score)) AS b_score FROM edges WHERE dst_id IS NOT NULL AND NOT contains(dst_name, '.') GROUP BY line, dst_name)
    SELECT q.edge_id, q.dst_name, coalesce(q.dst_id, b_dst) AS dst_id, coalesce(b_confidence, q.confidence) AS confidence, coalesce(b_score, q.score) AS score
    FROM edges q LEFT JOIN bare ON q.line = bare.line AND split_part(q.dst_name, '.', 2) = tail WHERE contains(q.dst_name, '.')
    UNION ALL SELECT edge_id, dst_name, dst_id, confidence, score FROM edges e WHERE NOT contains(dst_name, '.') AND NOT EXISTS (SELECT 1 FROM edges q WHERE q.line = e.line AND q.dst_name = 'x.' || e.dst_name)""")
def member_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified calls take over what the bare call of the same line resolved to."""
    edges = _edges(spark, sf_dir).repartition("file", "line", "relation").distinct()  # the one shuffle that the merge needs too
    return graph.merge_member_calls(edges).select("edge_id", "dst_name", "dst_id", "confidence", "score")


_GRAPH = f"{_RESOLVED}, g AS (SELECT ref_id, line % 2000 AS src_id, dst_id, name AS dst_name, relation FROM resolved)"


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.resolve(_references(spark, sf_dir), _known(spark, sf_dir))
    return found.select("ref_id", (F.col("line") % 2000).alias("src_id"), "dst_id", F.col("name").alias("dst_name"), "relation")


@query(f"WITH {_GRAPH} SELECT DISTINCT * FROM g WHERE dst_name = '{SYMBOL}' OR dst_id IN (SELECT id FROM known WHERE name = '{SYMBOL}')")
def graph_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that reach a symbol."""
    return graph.usages(_graph(spark, sf_dir), _known(spark, sf_dir), SYMBOL)


@query(f"WITH {_GRAPH} SELECT * FROM g WHERE src_id IN (SELECT id FROM known WHERE name = '{SYMBOL}') AND dst_name <> '{SYMBOL}'")
def graph_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave a symbol's definitions."""
    return graph.explain(_graph(spark, sf_dir), _known(spark, sf_dir), SYMBOL)


_STEPS = """edges AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'o' || CAST(o_orderkey AS VARCHAR) AS dst FROM orders
    UNION SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem
    UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
    UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    found = pair("orders", "c", "o_custkey", "o", "o_orderkey").unionByName(pair("lineitem", "o", "l_orderkey", "s", "l_suppkey"))
    return found.unionByName(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(pair("nation", "n", "n_nationkey", "r", "n_regionkey")).distinct()


@query(f"""WITH RECURSIVE {_STEPS}, walk AS (SELECT 'c1' AS node, 0 AS distance UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 6)
    SELECT node, min(distance) AS distance FROM walk GROUP BY node""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all that a customer reaches over foreign keys."""
    start = spark.createDataFrame([("c1",)], "node string")
    return paths.shortest_paths(_steps(spark, sf_dir), start, 6).select("node", "distance")


@query(f"""WITH RECURSIVE {_STEPS}, goal AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node FROM region),
    walk AS (SELECT 'c1' AS node, 0 AS distance UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 6),
    back AS (SELECT node, 0 AS distance FROM goal UNION SELECT e.src, b.distance + 1 FROM back b JOIN edges e ON e.dst = b.node WHERE b.distance < 6),
    away AS (SELECT node, min(distance) AS distance FROM walk GROUP BY node), near AS (SELECT node, min(distance) AS distance FROM back GROUP BY node),
    total AS (SELECT min(a.distance + n.distance) AS steps FROM away a JOIN near n ON a.node = n.node),
    path AS (SELECT 0 AS step, 'c1' AS node UNION ALL
        SELECT step + 1, (SELECT min(e.dst) FROM edges e JOIN near n ON n.node = e.dst, total t WHERE e.src = p.node AND n.distance = t.steps - p.step - 1) FROM path p, total t WHERE p.step < t.steps)
    SELECT CAST(step AS INTEGER) AS step, node FROM path""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a shortest path from a customer to any region, searched from both ends."""
    start = spark.createDataFrame([("c1",)], "node string")
    goal = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return paths.shortest_path(_steps(spark, sf_dir), start, goal)


_INTERVALS = "spans AS (SELECT o_orderkey AS span_id, o_custkey AS file, o_orderkey AS start, o_orderkey + 400 AS \"end\", o_orderstatus = 'O' AS callable FROM orders)"
_POINTS = "points AS (SELECT DISTINCT l_orderkey AS ref_id, o_custkey AS file, l_orderkey + 100 AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(orders, "l_orderkey").select(F.col("l_orderkey").alias("ref_id"), F.col("o_custkey").alias("file"), (F.col("l_orderkey") + 100).alias("line"))


@query(f"""WITH {_INTERVALS}, {_POINTS} SELECT ref_id, arg_min(span_id, (NOT callable, "end" - start, span_id)) AS span_id
    FROM points p JOIN spans s ON p.file = s.file AND p.line BETWEEN s.start AND s."end" GROUP BY ref_id""")
def enclosing_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest span around each point of the same file."""
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("span_id"), F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 400).alias("end"), (F.col("o_orderstatus") == "O").alias("callable"))
    return graph.enclosing(_points(spark, sf_dir), spans)


@query(f"""WITH {_POINTS}, d AS (SELECT o_custkey AS file, o_orderkey AS line FROM orders WHERE o_orderstatus = 'F')
    SELECT p.ref_id, d.line AS from_id FROM points p ASOF LEFT JOIN d ON p.file = d.file AND p.line >= d.line""")
def nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last declaration at or above each point: an as-of join."""
    spans = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderkey").alias("id"), F.lit("f").alias("name"))
    return graph.nearest_above(_points(spark, sf_dir), spans).select("ref_id", "from_id")


#: The parts of an identifier.
_PARTS = r"list_transform(regexp_extract_all({}, '([A-Z]+[a-z0-9]*|[a-z0-9]+)'), lambda part: regexp_replace(lower(part), '^(.{{3,}})s$', '\1'))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, 'red widgets' AS wanted FROM part WHERE length(p_name) >= 3 AND p_name <> 'red widgets'),
    s AS (SELECT name, CASE WHEN length(name) <= length(wanted) THEN lower(name) ELSE lower(wanted) END AS short, CASE WHEN length(name) <= length(wanted) THEN lower(wanted) ELSE lower(name) END AS long,
        {_PARTS.format('name')} AS parts, {_PARTS.format('wanted')} AS others FROM n),
    c AS (SELECT *, list_max(list_filter(range(0, length(short) + 1), lambda k: starts_with(long, left(short, k)))) AS start, len(list_filter(parts, lambda p: list_contains(others, p))) AS common FROM s),
    r AS (SELECT name, CASE WHEN short = long THEN 100.0 ELSE greatest(CASE WHEN start >= 3 THEN 120.0 * start / length(long) ELSE 0.0 END,
        CASE WHEN common > 0 THEN 100.0 * common / greatest(len(parts), len(others)) ELSE 0.0 END, CASE WHEN contains(long, short) THEN 100.0 * length(short) / length(long) ELSE 0.0 END) END AS similarity FROM c)
    SELECT name, round(similarity, 6) AS similarity FROM r WHERE similarity >= 40 ORDER BY r.similarity DESC, length(name), lower(name), name LIMIT 5""")
def suggest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like a misspelt one, of all parts."""
    return graph.suggest(_known(spark, sf_dir), "red widgets").select("name", F.round("similarity", 6).alias("similarity"))


_SOURCES = "files AS (SELECT CAST(page_id AS VARCHAR) AS file, html AS source FROM pages)"
_LINES = f"{_SOURCES}, numbered AS (SELECT file, unnest(string_split(source, chr(10))) AS text, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS line FROM files)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.source_lines(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("source")))


@query(rf"""WITH {_LINES}, hits AS (SELECT file, line FROM numbered WHERE regexp_matches(text, '\btrack\b')),
    around AS (SELECT n.file, n.line, bool_or(n.line = h.line) AS is_match FROM numbered n JOIN hits h ON n.file = h.file AND n.line BETWEEN h.line - 2 AND h.line + 2 GROUP BY ALL)
    SELECT a.file, CAST(a.line AS INTEGER) AS line, n.text, a.is_match FROM around a JOIN numbered n ON a.file = n.file AND a.line = n.line""")
def text_usages_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a word, with two lines around them."""
    return usages.find_usages(_lines(spark, sf_dir), "track", context=2).drop("is_definition")


#: Fixed values, as text: what is no call, what declares, what opens a callable, and what calls.
_NOT_CALLS = """if for while switch catch return with else elsif unless until when case do end and not or sizeof typeof defined print printf echo assert require import include new delete throw super self this
    class struct object record actor contract module defmodule namespace interface protocol trait typeclass enum type typedef data newtype def defp defn defun function func fn sub proc method""".split()
_DECLARING = """class struct object record actor contract module defmodule namespace interface protocol trait typeclass enum type typedef data newtype def defp defn defun function func fn sub proc method""".split()
_DECLARATION = r"^[\t ]*(?:[A-Za-z0-9_@\[\]]+[\t ]+){0,3}(" + "|".join(_DECLARING) + r")[\t ]+([A-Za-z_][A-Za-z0-9_]*)"
_CALLABLE = r"^[\t ]*(?:[A-Za-z_][A-Za-z0-9_:<>,.\[\]*&\t ]*[\t *&]+)?([A-Za-z_][A-Za-z0-9_]*)[\t ]*\([^;=]*\)[\t ]*(?:const[\t ]*)?\{[\t ]*$"
_CALL = r"\b([A-Za-z_][A-Za-z0-9_]{2,})[\t ]*\("
#: All documents and what parts are as source text, line by line.
_TEXTS = """src AS (SELECT p_brand AS file, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'def ' || replace(p_name, ' ', '_') || CAST(p_partkey % 40 AS VARCHAR) || '(x):'
        WHEN p_partkey % 5 = 0 THEN 'int ' || replace(p_name, ' ', '_') || '(char c) {' ELSE '    ' || replace(p_name, ' ', '_') || CAST(p_partkey % 40 AS VARCHAR) || '(x); if (y) other_' || p_brand[7:] || ' (z)' END AS text FROM part),
    n AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents
        UNION ALL SELECT file, text, row_number() OVER (PARTITION BY file ORDER BY p_partkey) FROM src)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents and of source text that parts make."""
    part, name = table(spark, sf_dir, "part"), F.replace("p_name", F.lit(" "), F.lit("_"))
    numbered, number = F.concat(name, (F.col("p_partkey") % 40).cast("string")), F.substring("p_brand", 7, 9)
    called = F.concat(F.lit("    "), numbered, F.lit("(x); if (y) other_"), number, F.lit(" (z)"))
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("def "), numbered, F.lit("(x):"))).when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("int "), name, F.lit("(char c) {"))).otherwise(called)
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    source = part.groupBy(F.col("p_brand").alias("file")).agg(F.array_join(listed["line"], "\n").alias("source"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("source"))
    return graph.source_lines(docs.unionByName(source))


@query(f"""WITH {_TEXTS},
    c AS (SELECT file, line, unnest(list_filter(regexp_extract_all(text, '{_CALL}', 1), lambda n: NOT list_contains({_NOT_CALLS}, n))) AS name FROM n
        WHERE NOT regexp_matches(text, '{_DECLARATION}') AND NOT regexp_matches(text, '{_CALLABLE}'))
    SELECT name, count(*) AS calls FROM c GROUP BY name""")
def pattern_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines of text and source call: all lines of any length, and all calls of a file."""
    return graph.calls(_texts(spark, sf_dir), longest=None, most=None).groupBy("name").agg(F.count("*").alias("calls"))


@query(f"""WITH {_TEXTS},
    d AS (SELECT file, CAST(line AS INTEGER) AS line, regexp_extract(text, '{_DECLARATION}', 1) AS word, regexp_extract(text, '{_DECLARATION}', 2) AS named,
        regexp_extract(text, '{_CALLABLE}', 1) AS callable FROM n)
    SELECT file, line, CASE WHEN word <> '' THEN named ELSE callable END AS name FROM d
    WHERE (word <> '' AND NOT list_contains({_DECLARING}, named)) OR (word = '' AND callable <> '' AND NOT list_contains({_NOT_CALLS}, callable))""")
def pattern_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines of text and source declare, by words and by form."""
    return graph.declarations(_texts(spark, sf_dir), longest=None).select("file", "line", "name")


@query("""WITH u AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'mcp__memory__search' ELSE 'Bash' END AS name, CASE WHEN p_size % 3 = 1 THEN 'grep -rn ' || split_part(p_name, ' ', 2) || 'Widget src' ELSE 'ls' END AS command FROM part),
    k AS (SELECT DISTINCT split_part(p_name, ' ', 2) || 'Widget' AS name FROM part WHERE p_size > 40),
    c AS (SELECT count(*) FILTER (name = 'Bash') AS commands, count(*) FILTER (name = 'Bash' AND command <> 'ls') AS greps, count(*) FILTER (name = 'Bash' AND command <> 'ls') AS candidates,
        count(*) FILTER (name = 'Bash' AND command <> 'ls' AND split_part(command, ' ', 3) IN (SELECT name FROM k)) AS fires, count(*) FILTER (name <> 'Bash') AS memory_calls FROM u)
    SELECT *, greps / commands AS grep_share FROM c""")
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel from shell commands to graph lookups, over commands made from parts."""
    part, word = table(spark, sf_dir, "part"), F.concat(F.element_at(F.split("p_name", " "), 2), F.lit("Widget"))
    size = F.col("p_size") % 3
    uses = part.select(F.col("p_partkey").alias("id"), F.when(size == 0, "mcp__memory__search").otherwise("Bash").alias("name"), F.when(size == 1, F.concat(F.lit("grep -rn "), word, F.lit(" src"))).otherwise("ls").alias("command"))
    return adoption_counts(uses, part.filter("p_size > 40").select(word.alias("name")))


@query(f"WITH {_KNOWN} SELECT id, file, line FROM known WHERE name = '{SYMBOL}'")
def symbol_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols of a name."""
    return graph.find_symbols(_known(spark, sf_dir), SYMBOL, limit=None).select("id", "file", "line")


@query(f"WITH {_GRAPH}, ids AS (SELECT id FROM known WHERE name = '{SYMBOL}') SELECT ref_id, src_id, dst_id FROM g WHERE src_id IN (SELECT id FROM ids) OR dst_id IN (SELECT id FROM ids)")
def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave or reach a symbol's definitions."""
    ids = _known(spark, sf_dir).filter(F.col("name") == SYMBOL)
    return graph.find_edges(_graph(spark, sf_dir), ids, ids).select("ref_id", "src_id", "dst_id")


@query("SELECT p_partkey AS id, p_type AS project, p_brand AS file FROM part WHERE NOT (p_type = (SELECT min(p_type) FROM part) AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 45))")
def graph_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols without those of some files of one project."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("project"), F.col("p_brand").alias("file"))
    project = rows.agg(F.min("project")).head()[0]
    return graph.without_files(rows, project, part.filter("p_size > 45").select(F.col("p_brand").alias("file"))).select("id", "project", "file")


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 10), n AS (SELECT DISTINCT l_partkey AS node FROM lineitem)
    SELECT node, coalesce(name, CAST(node AS VARCHAR)) AS label FROM n LEFT JOIN p ON node = id""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the names of their symbols, or as they are."""
    known = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return graph.labelled(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node")).distinct(), known)


_NESTED = """spans AS (SELECT o_orderkey AS span_id, o_custkey AS file, o_orderkey - o_orderkey % CAST(pow(4, o_orderkey % 7) AS BIGINT) AS start,
    o_orderkey - o_orderkey % CAST(pow(4, o_orderkey % 7) AS BIGINT) + CAST(pow(4, o_orderkey % 7) AS BIGINT) - 1 AS "end" FROM orders)"""


@query(f"""WITH {_NESTED}, pairs AS (SELECT a.span_id, b.span_id AS parent, b."end" - b.start AS width FROM spans a JOIN spans b ON a.file = b.file AND a.span_id <> b.span_id
        AND b.start <= a.start AND b."end" >= a."end" AND (b."end" - b.start > a."end" - a.start OR b.span_id < a.span_id))
    SELECT span_id, arg_min(parent, (width, -parent)) AS parent_id FROM pairs GROUP BY span_id""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What defines what: the narrowest other span around each span of a file."""
    width, key = F.pow(F.lit(4), F.col("o_orderkey") % 7).cast("long"), F.col("o_orderkey")
    spans = table(spark, sf_dir, "orders").select(key.alias("span_id"), F.col("o_custkey").alias("file"), (key - key % width).alias("start"), (key - key % width + width - 1).alias("end"))
    return graph.contained(spans)


@query(rf"""WITH {_LINES}, c AS (SELECT count(*) AS total FROM numbered WHERE regexp_matches(text, '\btrack\b'))
    SELECT total, least(total, 20) AS shown, total > 20 AS truncated FROM c""")
def text_usages_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines hold a word, and whether a page of 20 shows them all."""
    return usages.usage_total(_lines(spark, sf_dir), "track", 20)


def _store(spark: SparkSession) -> Tables:
    return Tables(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")


#: Source text from parts: the brand is the file, each part a line that declares or calls. The last of three revisions.
_SOURCE_SQL = """source_lines AS (SELECT p_brand AS file, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line, p_partkey % 3 = 0 AS declares,
        CASE WHEN p_size > 40 AND p_brand LIKE '%2' THEN 'new_' ELSE '' END || replace(p_name, ' ', '_') || CAST(p_partkey % 40 AS VARCHAR) AS name FROM part WHERE p_brand NOT LIKE '%3'),
    symbols AS (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id FROM (
        SELECT file, name, min(line) AS line, sha256('graph 0 p' || chr(0) || file || chr(0) || name || chr(0) || 'function') AS h FROM source_lines WHERE declares GROUP BY file, name)),
    by_name AS (SELECT name, count(*) AS n, min(id) AS first FROM symbols GROUP BY name),
    above AS (SELECT c.file, c.line, c.name, d.id AS src_id, d.name AS src_name FROM (SELECT * FROM source_lines WHERE NOT declares) c ASOF LEFT JOIN symbols d ON c.file = d.file AND c.line >= d.line),
    edges AS (SELECT a.file, a.line, coalesce(a.src_name, a.file) AS src_name, coalesce(a.src_id, '') AS src_id, a.name AS dst_name, coalesce(o.id, b.first) AS dst_id,
        CASE WHEN o.id IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, CASE WHEN o.id IS NOT NULL THEN 1.0 WHEN b.n = 1 THEN 0.95 ELSE 0.85 END AS score
        FROM above a JOIN by_name b ON a.name = b.name LEFT JOIN symbols o ON o.file = a.file AND o.name = a.name)"""


def _source(spark: SparkSession, sf_dir: str, revision: int) -> DataFrame:
    """file, source, hash of one of three revisions: the second renames parts of some brands, the third drops others."""
    part = table(spark, sf_dir, "part").filter("p_brand not like '%3'" if revision == 3 else "true")
    renamed = (F.col("p_size") > 40) & F.col("p_brand").like("%2") if revision > 1 else F.lit(False)
    name = F.concat(F.when(renamed, "new_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), (F.col("p_partkey") % 40).cast("string"))
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("def "), name, F.lit("(x):"))).otherwise(F.concat(F.lit("    "), name, F.lit("(x)")))
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    return part.groupBy(F.col("p_brand").alias("file")).agg(F.array_join(listed["line"], "\n").alias("source")).withColumn("hash", F.sha2("source", 256))


@query(f"WITH {_SOURCE_SQL} SELECT file, line, src_name, src_id, dst_name, dst_id, confidence, CAST(score AS DOUBLE) AS score FROM edges")
def graph_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of source text after three revisions, each of which resolves again only what it touches: the edges of a rebuild."""
    kept = CodeGraph(spark, _store(spark), "p")
    for revision in (1, 2, 3):
        kept.refresh(_source(spark, sf_dir, revision), longest=None, most=None)
    return kept.read("edges").select("file", "line", "src_name", "src_id", "dst_name", "dst_id", "confidence", "score")


@query(f"WITH {_SOURCE_SQL} SELECT id, name, file, line FROM symbols")
def graph_refresh_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of the last revision, after the two before it."""
    kept = CodeGraph(spark, _store(spark), "p")
    for revision in (1, 2, 3):
        kept.refresh(_source(spark, sf_dir, revision), longest=None, most=None)
    return kept.read("symbols").select("id", "name", "file", "line")


_THREE = """s AS (SELECT 'symbol' AS kind, p_brand AS file, CAST(p_partkey AS VARCHAR) AS id, p_type AS state FROM part),
    e AS (SELECT 'edge' AS kind, p_brand AS file, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_linestatus AS state FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (SELECT DISTINCT 'file' AS kind, p_brand AS file, p_brand AS id, '1' AS state FROM part),
    fresh AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f) WHERE file LIKE '%4'),
    kept AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f) WHERE file NOT LIKE '%4' AND file NOT LIKE '%5')"""


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and edges as of a scan: brands, parts and line items."""
    part = table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    files = part.select(F.col("p_brand").alias("file"), F.lit("1").alias("hash")).distinct()
    symbols = part.select(text("p_partkey").alias("id"), F.lit("p").alias("project"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_brand").alias("file"), F.lit(1).alias("line"), none.alias("lang"), F.col("p_type").alias("signature"))
    lines = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"), "p_name"), "l_partkey")
    edges = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), text("l_suppkey").alias("src_id"), none.alias("src_name"), text("l_partkey").alias("dst_id"), F.col("p_name").alias("dst_name"), F.lit("sells").alias("relation"), F.col("l_linestatus").alias("confidence"), F.lit(1.0).alias("score"), "file", F.lit(1).alias("line"))
    return files, symbols, edges


def _state(kept: CodeGraph) -> DataFrame:
    parts = (("files", "file", F.col("file"), F.col("hash")), ("symbols", "symbol", F.col("id"), F.col("signature")), ("edges", "edge", F.col("edge_id"), F.col("confidence")))
    rows = [kept.read(name).select(F.lit(kind).alias("kind"), "file", i.alias("id"), state.alias("state")) for name, kind, i, state in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {_THREE} SELECT * FROM kept UNION ALL SELECT kind, file, id, CASE WHEN kind = 'file' THEN '2' ELSE lower(state) END AS state FROM fresh")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables changed by one commit: all files' rows, then those of some files replaced and of others removed."""
    files, symbols, edges = _three(spark, sf_dir)
    kept = CodeGraph(spark, _store(spark), "p")
    kept.upsert(files, symbols, edges)
    some: Column = F.col("file").like("%4")
    kept.upsert(files.filter(some).withColumn("hash", F.lit("2")), symbols.filter(some).withColumn("signature", F.lower("signature")), edges.filter(some).withColumn("confidence", F.lower("confidence")), removed=files.filter("file like '%5'"))
    return _state(kept)


@query(f"WITH {_THREE} SELECT * FROM s UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f")
def graph_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables without one project, by one commit; the other project's rows stay."""
    store, scan = _store(spark), _three(spark, sf_dir)
    kept, gone = CodeGraph(spark, store, "p"), CodeGraph(spark, store, "q")
    kept.upsert(*scan)
    gone.upsert(scan[0], scan[1].withColumn("project", F.lit("q")), scan[2])
    wipe(store, "q")
    return _state(kept).unionByName(_state(gone))
