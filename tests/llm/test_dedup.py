import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import line_dedup, linking, near_dedup
from lorekeep.llm.queries import op2_fuzzy_lines, op9_dart_near_dedup

from .conftest import groups, prose, rows_of


def test_components(spark):
    draw = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(1, 80)]
    found = {r["node"]: r["root"] for r in rows_of(linking.components(spark.createDataFrame(edges, "a long, b long")))}
    root = groups(1000, edges)
    assert found == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_no_link_is_missed(spark):
    """Buckets in which few members resemble the leader: all similar pairs that share one end in a component."""
    draw = np.random.default_rng(7)
    place = {i: float(draw.uniform(0, 30)) for i in range(80)}
    similar = lambda a, b: abs(place[a] - place[b]) < 0.6
    buckets = [(b, i) for b in range(4) for i in range(80) if draw.random() < 0.7]
    members = spark.createDataFrame(buckets, "bucket long, node long")
    near = spark.createDataFrame(list(place.items()), "n long, p double")

    def verify(pairs):
        return pairs.filter(F.abs(F.col("content_a") - F.col("content_b")) < 0.6).select("a", "b")

    # Equal sketches, so that the bound rules out nothing.
    contents = near.toDF("node", "content").withColumn("size", F.lit(2).cast("long")).withColumns({c: F.lit(7).cast("long") for c in linking.SKETCH})
    roots = {r["node"]: r["root"] for r in rows_of(linking.link(members, contents, verify, 0.8))}
    shared = {tuple(sorted(p)) for b in range(4) for p in combinations([i for c, i in buckets if c == b], 2)}
    want = groups(80, [p for p in shared if similar(*p)])
    assert [roots.get(i, i) for i in range(80)] == want


def test_sketches_bound_the_difference():
    """Differing bits are never more than differing elements, and near to them while these are few."""
    draw, ratios = np.random.default_rng(2), []
    for n, edits in ((150, 20), (600, 100), (5000, 800), (3, 2)):
        a = draw.integers(0, 2**63, n, dtype=np.uint64)
        b = np.append(a[edits:], draw.integers(0, 2**63, edits, dtype=np.uint64))
        words = np.array(linking.sketches(np.repeat([0, 1], n), np.concatenate([a, b]), 2))
        assert words[0].tolist() == [n, n]
        bits = sum(int(x).bit_count() for x in (words[1:, 0] ^ words[1:, 1]).view(np.uint64))
        assert bits <= 2 * edits
        ratios.append(bits / (2 * edits))
    assert min(ratios[:2]) > 0.8


@pytest.mark.parametrize("wanted", [0.5, 0.8])
def test_darts_estimate_weighted_jaccard(wanted):
    draw, agreed, exact = np.random.default_rng(0), [], []
    for _ in range(40):
        a = np.sort(draw.integers(0, 2**63, 400, dtype=np.uint64))
        b = a.copy()
        b[: int(400 * (1 - wanted) / (1 + wanted))] = draw.integers(0, 2**63, int(400 * (1 - wanted) / (1 + wanted)), dtype=np.uint64)
        weights = draw.uniform(0.5, 4, 400)
        order = np.argsort(b)
        agreed.append(np.mean(near_dedup.dart_minhash(a, weights) == near_dedup.dart_minhash(b[order], weights[order])))
        exact.append(near_dedup.similarity((a, weights), (b[order], weights[order])))
    assert np.mean(agreed) == pytest.approx(np.mean(exact), abs=0.03)


def near_classes(docs):
    """Roots of rows by comparing all pairs that share a shingle."""
    sets = [near_dedup.shingles(w) if (w := near_dedup._WORD.findall((t or "").lower())) else None for _, t in docs]
    at, pairs = defaultdict(list), set()
    for i, s in enumerate(sets):
        for v in [] if s is None else s[0].tolist():
            pairs.update((j, i) for j in at[v])
            at[v].append(i)
    return sets, groups(len(docs), [p for p in pairs if near_dedup.similarity(sets[p[0]], sets[p[1]]) >= near_dedup.SIMILARITY])


def check_near(df, rows):
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    sets, roots = near_classes(docs)
    members = defaultdict(list)
    for (i, _), s, r in zip(docs, sets, roots, strict=True):
        members[r if s is not None else None].append(i)
    alone = members.pop(None, [])
    want = Counter((i, min((x for x in m if x is not None), default=None), len(m)) for m in members.values() for i in m) + Counter((i, i, 1) for i in alone)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(members) + len(alone)


def test_near_table(spark, sf):
    check_near(spark.read.parquet(f"{sf}/documents.parquet"), rows_of(op9_dart_near_dedup(spark, sf)))


def test_near_messy(messy, nothing):
    check_near(messy, rows_of(near_dedup.near_dedup(messy)))
    kept = rows_of(near_dedup.near_deduplicated(messy))
    assert set(kept[0]) == set(messy.columns)
    assert len(kept) == sum(r["kept"] for r in rows_of(near_dedup.near_dedup(messy)))
    assert near_dedup.near_dedup(nothing).count() == 0 and near_dedup.near_deduplicated(nothing).count() == 0


def test_near_large_group(spark):
    """Several hundred near copies of one text, each edited in its own place, are one class; others stay out."""
    base = prose(50, 300).split()
    rows = [(i, " ".join(base[:i] + ["edited"] + base[i + 1 :])) for i in range(300)] + [(1000 + i, prose(100 + i, 200)) for i in range(30)]
    found = rows_of(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["class_id"] for r in found if r["doc_id"] < 1000} == {0}
    assert all(r["class_size"] == 1 for r in found if r["doc_id"] >= 1000)


def test_near_group_of_uneven_copies(spark):
    """Copies with few and with many edits: classes are those of a comparison of all pairs."""
    draw, base = np.random.default_rng(3), prose(60, 150).split()
    rows = []
    for i in range(250):
        words = list(base)
        for at in draw.integers(0, 150, int(draw.integers(0, 9))):
            words[at] = f"edit{draw.integers(0, 60)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df, rows_of(near_dedup.near_dedup(df)))


def lines_that_go(docs):
    """Numbers of removed lines of each document, by comparing all pairs of lines that share a shingle."""
    seen, places = Counter(), []
    for d, (i, t) in enumerate(docs):
        seen[i, t] += 1
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(line_dedup.BLANK)
            if len(line) >= line_dedup.LEAST_CHARS:
                places.append(((i is None, i or 0), seen[i, t] > 1, d, n, line))
    distinct = list(dict.fromkeys(p[4] for p in places))
    sets, at, pairs = [line_dedup.grams(x) for x in distinct], defaultdict(list), set()
    for i, s in enumerate(sets):
        for g in s:
            pairs.update((j, i) for j in at[g])
            at[g].append(i)

    def similar(a, b):
        common = len(sets[a] & sets[b])
        return common >= line_dedup.SIMILARITY * (len(sets[a]) + len(sets[b]) - common)

    roots = dict(zip(distinct, groups(len(distinct), [p for p in pairs if similar(*p)]), strict=True))
    return places, roots


def check_lines(df, rows):
    """Of each group of similar lines one occurrence stays, that of the smallest doc_id."""
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    places, roots = lines_that_go(docs)
    removed = sum(r["n_removed"] for r in rows)
    assert removed == len(places) - len({roots[p[4]] for p in places})
    assert len(rows) == len(docs)
    if all(n == 1 for n in Counter(i for i, _ in docs).values()):
        first, gone = {}, defaultdict(set)
        for place, _, d, n, line in sorted(places, key=lambda p: (p[0], p[3])):
            if first.setdefault(roots[line], (d, n)) != (d, n):
                gone[docs[d][0]].add(n)
        for (i, t), row in zip(sorted(docs), sorted(rows, key=lambda r: r["doc_id"]), strict=True):
            kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i])
            assert hashlib.sha256(kept.encode()).hexdigest() == row["kept_sha256"]


def test_lines_table(spark, sf):
    check_lines(spark.read.parquet(f"{sf}/documents.parquet"), rows_of(op2_fuzzy_lines(spark, sf)))


def test_lines_messy(messy, nothing):
    check_lines(messy, rows_of(line_dedup.line_decisions(messy)))
    kept = rows_of(line_dedup.deduplicated(messy))
    assert set(kept[0]) == set(messy.columns) and None in [r["text"] for r in kept]
    assert not any((r["text"] or "").upper() == (r["text"] or "") != "" and len(r["text"]) > 500 and " " in r["text"].strip() for r in kept)  # the upper-case copy is gone
    assert line_dedup.deduplicated(nothing).count() == 0


def test_short_lines(spark):
    """Lines of any length go: copies, copies but for case, near copies; blank lines stay, also in repeated rows."""
    long = "a line of more than forty characters, held once"
    df = spark.createDataFrame([(1, "Menu\n\n}\nRead more about harbours"), (2, "menu\n}\n \nread more about harbours!\nMen"), (3, long + "\n}\n\nOk"), (3, long + "\n}\n\nOk")], "doc_id long, text string")
    rows = rows_of(line_dedup.line_decisions(df))
    assert sorted((r["doc_id"], r["kept_text"]) for r in rows) == [(1, "Menu\n\n}\nRead more about harbours"), (2, " \nMen"), (3, ""), (3, long + "\n\nOk")]
    check_lines(df, rows)


def test_lines_of_few_shingles_have_whole_signatures():
    bins = line_dedup.signatures(["}", "exactly8", "nine char", "a line with more shingles than those before it"])
    assert (bins != 2**32 - 1).all() and len(set(bins[0])) == len(set(bins[1])) == 1


def test_frequent_lines_are_not_gathered(spark):
    df = spark.createDataFrame([(i, "a line that all documents hold, held once") for i in range(20)] + [(None, "a line that all documents hold, held once")], "doc_id long, text string")
    found = rows_of(line_dedup.line_decisions(df))
    assert {r["doc_id"]: r["n_removed"] for r in found} == {0: 0, **dict.fromkeys([*range(1, 20), None], 1)}


def test_repeated_rows_and_any_names(spark):
    """Rows that differ in other columns only: the same one stays however rows are dealt; helper names don't clash."""
    text = prose(9, 40)
    rows = [(1, text, f"s{i}", i) for i in range(30)] + [(2, prose(10, 40), "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, __tie long").withColumns({c: F.lit(1) for c in ("tie", "node", "n_lines", "kept_text", "removed", "doc", "key")})
    for operator in (line_dedup.deduplicated, near_dedup.near_deduplicated):
        kept = [sorted((r["doc_id"], r["row"], r["__tie"]) for r in rows_of(operator(df.repartition(n)))) for n in (1, 7)]
        assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2]
        assert operator(df).columns == df.columns
