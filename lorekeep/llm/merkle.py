"""A Merkle manifest of a dataset: a hash for each row, source and the whole, and a proof for each row.

A leaf is the SHA-256 of a row's fields; per source, runs of ``fanout`` consecutive nodes are hashed into
parents until one is left, the subroot; the subroots, in order of their sources, are hashed into the root alike.

Rows are numbered without gathering a source: they are dealt by range of (source, doc_id, leaf), numbered
with row_number within a range and source, and the counts of earlier ranges (a row a range and source) are added.
Each level is one grouping by (source, number div fanout) of at most ``fanout`` rows a group. Proofs are joined from the
root down, at the level of the runs, so that a join moves a path for each run and not for each leaf.

A proof step is what stands left and right of a node in its run; folding a leaf with its steps gives the
root. ``tampered`` leaves are folded with the true siblings, so that they must miss the root.

Defined cases: a null field is ``-``, other than the empty text; rows of one source and doc_id are ordered by
leaf (a null doc_id first), equal rows stay rows of their own; a null source is a source, the first; the only row
of the only source is the root itself, with an empty proof; an empty table gives no rows.
Columns other than the five are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import discard, shuffle_partitions, small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that are tampered with: those whose crc32 of the id's decimals this number divides.
TAMPER = 5


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, offered: the leaf of each row, and the one that is offered for proof (tampered or the same)."""
    fields = {c: docs[c] for c in FIELDS}
    leaf = _sha(*(field(c) for c in fields.values()))
    altered = _sha(*(field(F.translate(c.cast("string"), UPPER, UPPER.lower()) if name == "text" else c) for name, c in fields.items()))
    tampered = F.coalesce(F.crc32(fields["doc_id"].cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    return docs.select(fields["doc_id"].cast("long").alias("doc_id"), fields["source"].cast("string").alias("source"), leaf.alias("leaf"), F.when(tampered, altered).otherwise(leaf).alias("offered"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 among those of their ``key`` in ``order``, and ``n``, how many these are.

    Rows that agree in ``order`` must be alike. ``rows`` must be a stored table: it is read twice."""
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id())  # alike rows may fill many ranges
    ranged = ranged.repartitionByRange(shuffle_partitions(rows.sparkSession), F.asc_nulls_first(key), *map(F.asc_nulls_first, order), "__tie")
    ranged = ranged.withColumn("__range", F.spark_partition_id())
    place = Window.partitionBy("__range", key).orderBy(*map(F.asc_nulls_first, order), "__tie")
    placed = stored(ranged.withColumn("__at", F.row_number().over(place).cast("long") - 1).drop("__tie"), "placed")
    counts = placed.groupBy("__range", key).agg(F.count("*").alias("__n"))  # a row a range, and one more for each further key
    of_key = Window.partitionBy(key).orderBy("__range")
    before = F.coalesce(F.sum("__n").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select(F.col("__range").alias("__r"), F.col(key).alias("__k"), before.alias("__before"), F.sum("__n").over(Window.partitionBy(key)).alias("n")), "ranges")
    same = (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k"))
    return placed.join(small(counts, 128), same).select(*rows.columns, (F.col("__at") + F.col("__before")).alias("at"), "n")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """source, parent, n and the sorted children (at, node, and what else ``nodes`` hold) of the runs that are hashed into one node."""
    rest = [c for c in nodes.columns if c not in ("source", "n", "at")]
    runs = nodes.groupBy("source", "n", F.floor(F.col("at") / fanout).alias("parent"))
    return runs.agg(F.sort_array(F.collect_list(F.struct("at", *rest))).alias("children"))


def _hashed(runs: DataFrame, fanout: int) -> DataFrame:
    """The parents of runs: source, n (as many as the next level has), at, node."""
    return runs.select("source", F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("at"), F.sha2(F.array_join("children.node", ""), 256).alias("node"))


def _steps(others: Column, own: Column) -> Column:
    """What stands before and after the child of number ``own`` (from 0) in the nodes ``others``."""
    before, after = F.slice(others, F.lit(1), own), F.slice(others, own + 2, F.size(others))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


PATH = "array<struct<before:string,after:string>>"


def tree(base: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs above numbered nodes (source, at, n, node, ...), and source, root of every source.

    A source with one node left takes no part in the next level."""
    levels, roots, nodes = [], [base.filter("n = 1").select("source", F.col("node").alias("root"))], base
    widest = base.agg(F.max("n")).head()[0] or 0
    while widest > 1:
        runs = stored(_runs(nodes.filter("n > 1"), fanout), f"level{len(levels)}")
        levels.append(runs)
        nodes = _hashed(runs, fanout)
        roots.append(nodes.filter("n = 1").select("source", F.col("node").alias("root")))
        widest = -(-widest // fanout)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, stored(found, "roots")


def paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The runs of the lowest level with ``path``, the steps above them, and ``subroot``; ``tops`` (source, subroot, path) hold
    those above the subroots. Levels are joined from the top down."""
    above = tops.select(F.col("source").alias("__source"), "subroot", "path")
    down: DataFrame | None = None  # source, at, subroot, path of the nodes that the next lower level hashes into
    for level in reversed(levels):
        last = level.filter(F.col("n") <= fanout).join(above, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        rest = level.filter(F.col("n") > fanout)
        runs = last
        if down is not None:
            below = down.select(F.col("source").alias("__source"), F.col("at").alias("__parent"), "subroot", "path")
            runs = runs.unionByName(rest.join(below, F.col("source").eqNullSafe(F.col("__source")) & (F.col("parent") == F.col("__parent"))).select(last.columns))
        if level is levels[0]:
            return runs
        opened = runs.select("source", "subroot", "path", F.posexplode("children").alias("own", "child"), F.col("children.node").alias("nodes"))
        steps = F.concat(F.array(_steps(F.col("nodes"), F.col("own"))), F.col("path"))
        down = stored(opened.select("source", F.col("child.at").alias("at"), "subroot", steps.alias("path")), "paths")
    raise ValueError("no levels")


def manifest(docs: DataFrame, fanout: int = 16) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row, and its ``path`` of steps."""
    found = stored(leaves(docs), "leaves")
    base = stored(numbered(found, "source", ["doc_id", "leaf"]).withColumnRenamed("leaf", "node"), "base")
    discard(found)
    levels, subroots = tree(base.select("source", "at", "n", "node", "doc_id", "offered"), fanout)

    # The subroots are leaves of one more tree, under a source that is the same for all.
    tops = stored(numbered(subroots.select(F.lit(0).alias("all"), "source", F.col("root").alias("node")), "all", ["source"]).select(F.lit("").alias("source"), F.col("source").alias("own"), "at", "n", "node"), "tops")
    upper, root = tree(tops, fanout)
    root = root.head()  # one row, or none of an empty table
    top = root["root"] if root else None
    none = F.array().cast(PATH)
    if upper:
        runs = paths(upper, docs.sparkSession.range(1).select(F.lit("").alias("source"), F.lit("").alias("subroot"), none.alias("path")), fanout)
        opened = runs.select("path", F.posexplode("children").alias("own", "child"), F.col("children.node").alias("nodes"))
        heads = opened.select(F.col("child.own").alias("source"), F.col("child.node").alias("subroot"), F.concat(F.array(_steps(F.col("nodes"), F.col("own"))), F.col("path")).alias("path"))
    else:
        heads = tops.select(F.col("own").alias("source"), F.col("node").alias("subroot"), none.alias("path"))
    heads = small(stored(heads, "heads"), 256 + (fanout - 1) * 72 * len(upper))

    # Sources of one row are subroots themselves; the rows of the others hang below a run.
    lone = base.filter("n = 1").join(heads.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    rows = lone.select("doc_id", "source", F.col("node").alias("leaf"), "offered", "subroot", "path")
    if levels:
        runs = paths(levels, heads, fanout)
        opened = runs.select("source", "subroot", "path", F.posexplode("children").alias("own", "child"), F.col("children.node").alias("nodes"))
        steps = F.concat(F.array(_steps(F.col("nodes"), F.col("own"))), F.col("path"))
        rows = rows.unionByName(opened.select("child.doc_id", "source", F.col("child.node").alias("leaf"), "child.offered", "subroot", steps.alias("path")))
    proof = F.sha2(F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"]))), ""), 256)
    folded = F.aggregate("path", F.col("offered"), lambda h, s: _sha(s["before"], h, s["after"]))
    rows = rows.select("doc_id", "source", "leaf", "subroot", F.lit(top).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), "path")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

