"""Re-embedding that is broken off and taken up again."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.reembed import batch_of, reembed
from lorekeep.sources.versions import Tables

SCHEMA = "id string, title string, body string, kind string, embedding array<float>, embedder string"


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"id{i}", f"t{i}", None if i % 7 == 0 else f"b{i}", "note", [0.5] if i % 3 == 0 else None, ["old", "new", None][i % 3]) for i in range(60)]
    rows = [(*r[:4], [9.0], "new") if r[5] == "new" else r for r in rows]
    made = Tables(spark, str(tmp_path))
    made.change({"observations": (spark.createDataFrame(rows, SCHEMA), None, ["id"])})
    return made


def embed(text):
    """A vector of the text's length; fails for texts that hold a 5."""
    return F.when(~text.contains("5"), F.array(F.length(text).cast("float")))


def rows(store):
    return sorted(map(tuple, store.read("observations").collect()), key=str)


def test_whole_run(store):
    before = {r["id"]: r for r in store.read("observations").collect()}
    ledger = reembed(store, "new", embed, 4)
    assert ledger.agg(F.sum("rows")).head()[0] == 40
    for r in store.read("observations").collect():
        old = before[r["id"]]
        if old["embedder"] == "new":
            assert r == old
        else:
            text = "\n".join(x for x in (r["title"], r["body"]) if x is not None)
            assert (r["embedding"], r["embedder"]) == ((None, None) if "5" in text else ([float(len(text))], "new"))
        assert (r["title"], r["body"], r["kind"]) == (old["title"], old["body"], old["kind"])
    assert store.read("observations").count() == 60


def test_a_broken_run_ends_with_the_same_table(spark, store, tmp_path, monkeypatch):
    whole = Tables(spark, f"{tmp_path}-whole")
    whole.change({"observations": (store.read("observations"), None, ["id"])})
    reembed(whole, "new", embed, 6)
    change, count, seen = store.change, iter(range(99)), []

    def dying(changes, *args):
        if "observations" in changes and next(count) == 3:
            raise RuntimeError("lost")
        seen.extend(r["id"] for r in changes["observations"][0].collect() if r["embedding"] is not None) if "observations" in changes else None
        return change(changes, *args)

    monkeypatch.setattr(store, "change", dying)
    with pytest.raises(RuntimeError):
        reembed(store, "new", embed, 6)
    assert store.read("observations_ledger").count() == 3
    assert rows(store) != rows(whole)
    reembed(store, "new", embed, 6)
    assert rows(store) == rows(whole)
    assert len(seen) == len(set(seen))  # each row was embedded once
    assert store.read("observations_ledger").count() == 0


def test_stop_and_go_on(store):
    assert reembed(store, "new", embed, 5, most=2).count() == 2
    left = store.read("observations").filter("embedder is distinct from 'new'")
    assert left.filter(batch_of(F.col("id"), 5) < 2).filter("not contains(concat_ws('-', title, body), '5')").count() == 0
    assert reembed(store, "new", embed, 5).count() == 5
    again = reembed(store, "new", lambda text: F.array(F.lit(1.0).cast("float")), 5)
    assert again.agg(F.sum("rows"), F.sum("failed")).head()[:] == tuple([store.read("observations").filter("embedding = array(1f)").count(), 0])


def test_a_part_of_the_table(store):
    reembed(store, "new", embed, 3, where=F.col("id") < "id2")
    changed = store.read("observations").filter("embedder = 'new' and embedding[0] <> 9").select(F.max("id")).head()[0]
    assert changed < "id2"


def test_nothing_to_do(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    store.change({"observations": (spark.createDataFrame([], SCHEMA), None, ["id"])})
    assert reembed(store, "new", embed, 3).agg(F.sum("rows")).head()[0] == 0
