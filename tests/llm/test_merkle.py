"""The manifest against a plain recomputation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import merkle
from .conftest import rows_of

FANOUT = 4


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes, fanout):
    """The top of a list of nodes, and for each node the steps (before, after) up to it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, a in enumerate(at):
            run = runs[a // fanout]
            steps[k].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
        nodes, at = [sha(*run) for run in runs], [a // fanout for a in at]
    return nodes[0], steps


def expected(rows, fanout):
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sources = {}
    for r in rows:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        own = leaf(r, r["text"])
        sources.setdefault(r["source"], []).append((r["doc_id"], own, leaf(r, lower(r["text"])) if tampered else own))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[s] = climb([x[1] for x in sources[s]], fanout)
    if not names:
        return []
    root, upper = climb([tops[s][0] for s in names], fanout)
    out = []
    for s, above in zip(names, upper, strict=True):
        for (doc_id, own, offered), below in zip(sources[s], tops[s][1], strict=True):
            folded = offered
            for before, after in below + above:
                folded = sha(before, folded, after)
            out.append((doc_id, s, own, tops[s][0], root, sha(*(x for step in below + above for x in step)), folded, folded == root))
    return sorted(out, key=str)


def found(df, fanout):
    return sorted((tuple(r[c] for c in ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows_of(merkle.manifest(df, fanout))), key=str)


@pytest.mark.parametrize("fanout", [2, FANOUT, 16])
def test_messy_rows(messy, fanout):
    assert found(messy, fanout) == expected(rows_of(messy), fanout)


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    result = found(docs, 16)
    assert result == expected(rows_of(docs), 16)
    assert {r[7] for r in result} == {True, False}


def test_one_row_is_the_root(messy):
    one = messy.filter("doc_id = 11")
    [(_, _, own, subroot, root, proof, folded, _)] = found(one, 16)
    assert own == subroot == root and proof == sha("") and (folded == root) == (zlib.crc32(b"11") % 5 != 0)


def test_a_source_of_many_equal_rows(spark):
    rows = [(1, "Same", "en", "hot", 4)] * 300 + [(i, f"T{i}", None, None, None) for i in range(40)] + [(None, "x", "en", "hot", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert found(df, FANOUT) == expected(rows_of(df), FANOUT)


def test_more_sources_than_a_run(spark):
    df = spark.createDataFrame([(i, "A", "en", f"s{i % 23}", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(df, FANOUT) == expected(rows_of(df), FANOUT)


def test_no_rows(nothing):
    assert merkle.manifest(nothing).count() == 0


def test_numbers_do_not_depend_on_the_partitions(messy):
    clashing = messy.withColumns({"at": F.lit(1), "n": F.lit(2), "node": F.lit("n"), "leaf": F.lit("l"), "path": F.lit(0)})
    assert found(clashing.repartition(9), FANOUT) == found(messy.coalesce(1), FANOUT)
