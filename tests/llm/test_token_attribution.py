import public_tokenizers
from pyspark.sql import functions as F

from lorekeep.llm.queries import op8_token_attribution
from lorekeep.llm.token_attribution import _encoding, attribute, line_sections, token_counts, token_spans

from .conftest import rows_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def slow(text):
    """Tokens of each line by whole-text encoding, one character at a time."""
    encoder, lengths = _encoding(PATH, PATTERN)
    owner, line = [], 0
    for c in text:
        owner += [line] * len(c.encode())
        line += c == "\n"
    n = line + (not text.endswith("\n"))
    counts, at = [0] * max(1, n), 0
    for t in encoder.encode_ordinary(text):
        data = text.encode()
        first = at
        while first > 0 and data[first] & 0xC0 == 0x80:
            first -= 1
        last = at + int(lengths[t])
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        held = [owner[i] for i in range(first, last) if data[i] & 0xC0 != 0x80]
        counts[min(set(held), key=lambda x: (-held.count(x), x))] += 1
        at += int(lengths[t])
    return counts


def test_against_slow(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {}
    for r in rows_of(op8_token_attribution(spark, sf)):
        found.setdefault(r["doc_id"], {})[r["section"]] = r["tokens"]
    for doc in docs:
        assert [found[doc["doc_id"]][i] for i in range(len(found[doc["doc_id"]]))] == slow(doc["text"] or "")


def test_crossing_token_goes_to_the_larger_part():
    import numpy as np

    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 8])
    counts, crossing = attribute(starts, ends, np.array([0, 3]), np.array([3, 8]))
    assert counts.tolist() == [1, 2, 0] and crossing.tolist() == [0, 1, 0]
    counts, _ = attribute(starts, ends, np.array([0, 4]), np.array([4, 8]))
    assert counts.tolist() == [2, 1, 0]  # equal parts: the earlier one
    counts, _ = attribute(starts, ends, np.array([0]), np.array([2]))
    assert counts.tolist() == [1, 2]


def test_sections_column(messy):
    given = messy.withColumn("parts", F.when(F.length("text") > 20, F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")))))
    rows = rows_of(token_counts(given, PATH, PATTERN, "parts"))
    encoder, _ = _encoding(PATH, PATTERN)
    total = sum(len(encoder.encode_ordinary(r["text"] or "")) for r in messy.collect())
    assert sum(r["tokens"] for r in rows) == total and any(r["section"] == -1 for r in rows)


def test_messy(messy, nothing):
    encoder, lengths = _encoding(PATH, PATTERN)
    texts = [r["text"] or "" for r in messy.collect()]
    rows = rows_of(token_counts(messy, PATH, PATTERN))
    assert sum(r["tokens"] for r in rows) == sum(len(encoder.encode_ordinary(t)) for t in texts)
    assert len(rows) == sum(len(line_sections(t)[0]) for t in texts)
    for t in texts:
        starts, ends = token_spans(t, lengths, encoder.encode_ordinary(t))
        assert not len(starts) or (starts[0] == 0 and ends[-1] == len(t))
    assert token_counts(nothing, PATH, PATTERN).count() == 0


def test_null_sections_are_left_out(spark):
    parts = "array(null, named_struct('start', 0, 'end', 5), named_struct('start', int(null), 'end', 9), named_struct('start', 5, 'end', 9)) AS parts"
    rows = rows_of(token_counts(spark.sql(f"SELECT 1L AS doc_id, 'some text' AS text, {parts}"), PATH, PATTERN, "parts"))
    assert [(r["section"], r["start"], r["end"]) for r in rows if r["section"] >= 0] == [(0, 0, 5), (1, 5, 9)]
