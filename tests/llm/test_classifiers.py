import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import gru, quality, toxicity
from lorekeep.llm.labelled import labelled_sample
from lorekeep.llm.queries import op1_compression_quality, op5_gru_toxicity

from .conftest import rows_of

LARGER = "/root/testdata/sf0.1"


def outcome(spark, rows, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([p == t for p, t in held]), held


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """The labelled documents of a larger table."""
    place = str(tmp_path_factory.mktemp("labelled"))
    known = spark.read.parquet(f"{LARGER}/labels.parquet")
    known.write.parquet(f"{place}/labels.parquet")
    spark.read.parquet(f"{LARGER}/documents.parquet").join(known.select("doc_id"), "doc_id", "left_semi").write.parquet(f"{place}/documents.parquet")
    return place


def test_quality_held_out(spark, labelled):
    rows = rows_of(op1_compression_quality(spark, labelled))
    accuracy, held = outcome(spark, rows, "quality")
    assert accuracy > 0.96
    assert np.mean([p for p, t in held if t == 1]) > 0.97 and np.mean([p for p, t in held if t == 0]) < 0.2
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_held_out(spark, labelled):
    rows = rows_of(op5_gru_toxicity(spark, labelled))
    accuracy, held = outcome(spark, rows, "toxic")
    assert accuracy > 0.96
    assert np.mean([p for p, t in held if t == 1]) > 0.75 and np.mean([p for p, t in held if t == 0]) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, known = (spark.read.parquet(f"{labelled}/{t}.parquet") for t in ("documents", "labels"))
    turned = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, known) == quality.fit_quality(docs, turned)


def test_gradients():
    net = gru.Network.initial(3)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    codes = gru.encode_words(["ab", "hello", "x", "éa", "zz"])
    index = np.random.default_rng(0).integers(0, 6, (7, 4))
    index[:, 0] = [1, 2, 0, 0, 0, 0, 0]
    y, weight, drop = np.array([1, 0, 1, 0.0]), np.array([1.0, 2.0, 1.0, 0.5]), np.array([False, True, False, False, False])

    def loss():
        inputs = net.inputs(codes).astype(float)
        inputs[: gru.WORD_DIM, 1:][:, drop] = 0
        p = 1 / (1 + np.exp(-net.forward(net.projected(inputs), index)))
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum() / weight.sum())

    for name, gradient in net.gradients(codes, index, y, weight, drop).items():
        flat = net.weights[name].reshape(-1)
        for i in np.argsort(-np.abs(gradient).reshape(-1))[:3]:
            was = flat[i]
            flat[i] = was + 1e-2
            up = loss()
            flat[i] = was - 1e-2
            down = loss()
            flat[i] = was
            assert gradient.reshape(-1)[i] == pytest.approx((up - down) / 2e-2, rel=2e-2, abs=1e-5), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        starts = toxicity.windows(n)
        assert starts[0] == 0 and (np.diff(starts) <= toxicity.STRIDE).all()
        assert n <= toxicity.WINDOW or starts[-1] + toxicity.WINDOW == n


def test_scores_do_not_depend_on_slices(monkeypatch):
    texts = ["you idiot " + "word%d " * 1 % 1, "a quiet day " * 100, "", "idiot " + "b c d " * 300]
    net = toxicity.train(texts * 5, np.array([1, 0, 0, 1] * 5))
    whole = toxicity.Scorer(net).score(texts)
    monkeypatch.setattr(toxicity, "TABLE_WORDS", 70)
    many = [" ".join(f"w{i}" for i in range(500)) + " idiot", *texts]
    piecewise = toxicity.Scorer(net).score(many)
    assert np.allclose(piecewise[1:], whole, atol=1e-5)
    monkeypatch.setattr(toxicity, "TABLE_WORDS", 200_000)
    assert np.allclose(toxicity.Scorer(net).score(many), piecewise, atol=1e-5)


def test_messy(spark, messy, nothing, labels):
    for docs in (messy, nothing):
        rows = rows_of(quality.score_quality(docs, quality.fit_quality(docs, labels)))
        assert len(rows) == docs.count() and all(r["score"] == 0.5 for r in rows)
        rows = rows_of(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)))
        assert len(rows) == docs.count() and all(r["score"] == 0 for r in rows)
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None), (9, 0, 0), (13, 1, 0)] * 3, "doc_id long, quality int, toxic int")
    for rows in (rows_of(quality.score_quality(messy, quality.fit_quality(messy, known))), rows_of(toxicity.score_toxicity(messy, toxicity.fit_toxicity(messy, known)))):
        assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_sampled_texts_are_whole(spark):
    """Rows are left out to keep the bound on characters; no text is cut."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (i % 7) * 20) for i in ids] + [(ids[0], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", {0: 10, 1: 40}, {0: 10**6, 1: 300})
    texts = {(r["text"] or "", r["doc_id"] % 2) for r in docs.collect()}
    assert all((r.text, r.label) in texts for r in rows.itertuples())
    assert (rows["label"] == 0).sum() == 10 and 0 < rows[rows["label"] == 1]["text"].str.len().sum() <= 300
    assert not len(labelled_sample(docs.limit(0), labels, "toxic", {0: 10, 1: 40}, {0: 300, 1: 300}))
