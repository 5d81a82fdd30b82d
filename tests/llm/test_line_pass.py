"""Line deduplication hands each text to Python once, within its document."""

import itertools

import pyarrow as pa

from lorekeep.llm import line_dedup


def test_text_is_a_field_of_its_document(monkeypatch):
    monkeypatch.setattr(line_dedup, "row_numbers", itertools.count)
    texts = ["one line here\n\nanother line", None, ""]
    doc = pa.StructArray.from_arrays([pa.array([1, 2, 3]), pa.array(texts, pa.string())], ["doc_id", "text"])
    given = {"doc": doc, "doc_id": pa.array([1, 2, 3]), "tie": pa.array([0, 0, 0])}
    within = pa.Table.from_batches(line_dedup._read(iter([pa.RecordBatch.from_pydict(given)]), 1))
    beside = pa.Table.from_batches(line_dedup._read(iter([pa.RecordBatch.from_pydict(given | {"text": pa.array([t or "" for t in texts])})])))
    assert within.to_pylist() == beside.to_pylist()
    assert [len(r["nodes"]) for r in within.to_pylist() if r["row"] is not None] == [3, 1, 1]
