import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, size long, line string, bucket int"


def prose(seed, words):
    draw = random.Random(seed)
    stems = ["the", "of", "and", "reading", "station", "harbour", "quiet", "engine", "copper", "river", "letter", "morning", "signal", "garden", "winter", "bridge", "market", "silver", "window", "travel"]
    return " ".join(draw.choice(stems) + (str(draw.randrange(40)) if draw.random() < 0.3 else "") for _ in range(words))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank texts, a very long one, copies, near copies, repeated rows and clashing names."""
    base = prose(1, 120)
    near = base.replace("the", "THE", 1) + " tail"
    rows = [
        (1, base),
        (2, base.upper()),
        (3, near),
        (4, ""),
        (5, None),
        (6, "   \n \t"),
        (7, prose(2, 60) + "\n" + prose(3, 60)),
        (7, prose(2, 60) + "\n" + prose(3, 60)),
        (None, prose(4, 50)),
        (None, base),
        (8, "\n".join(prose(i, 30) for i in range(10, 400))),
        (9, "word " * 3000),
        (10, "x" * 20_000),
        (11, "short"),
        (12, "İstanbul ΣΑΣ 東京 éá 😀 don't <|endoftext|> it's"),
        (13, prose(5, 80)),
        (13, prose(6, 80)),
    ]
    made = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), 0.5, k, 3, "l", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def groups(n, edges):
    """Root of each of n nodes, by a plain union-find."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
