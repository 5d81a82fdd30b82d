import pytest

import corpus_pipeline
from lorekeep.llm.common import stored
from lorekeep.llm.toxicity import fit_toxicity, score_toxicity

from .conftest import rows_of


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), f"test-{name}")
        after[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r["doc_id"] for r in rows_of(score_toxicity(whole, fit_toxicity(whole, known))) if r["predicted"] == 1}
    assert {r["doc_id"] for r in after["toxicity"].select("doc_id").collect()} == {r["doc_id"] for r in whole.select("doc_id").collect()} - rejected
    assert after["near_dedup"].count() <= after["line_dedup"].count() <= after["toxicity"].count()
    found = rows_of(corpus_pipeline.run(spark, sf))
    assert sorted(map(str, found)) == sorted(map(str, rows_of(after["packing"])))


@pytest.mark.parametrize("which", ["messy", "nothing"])
def test_odd_documents(spark, request, which, tmp_path):
    docs = request.getfixturevalue(which)
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), f"odd-{name}")
    assert (docs.count() > 0) == (which == "messy")
