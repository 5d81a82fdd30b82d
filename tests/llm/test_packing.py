import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lorekeep.llm import packing
from lorekeep.llm.queries import op4_hilbert_packing

from .conftest import prose, rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(docs, rows, encode, length=4096):
    want = {}
    for r in docs.collect():
        ids = encode(r["text"])
        want.setdefault((r["doc_id"], len(ids)), []).append(ids)
    covered = {}
    for r in rows:
        ids = [i for i in want[r["doc_id"], r["doc_tokens"]] if zlib.crc32(i[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert ids and r["length"] > 0
        covered.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for key, copies in want.items():
        times = np.zeros(key[1], int)
        for start, n in covered[key]:
            times[start : start + n] += 1
        assert (times == len(copies)).all()
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == length for s, n in sequences.items() if s < len(sequences) - 1)


def test_table(spark, sf, encode):
    check(spark.read.parquet(f"{sf}/documents.parquet"), rows_of(op4_hilbert_packing(spark, sf)), encode)


def test_messy(messy, nothing, encode, monkeypatch):
    check(messy, rows_of(packing.pack(messy, PATH)), encode)
    monkeypatch.setattr(packing, "LEAST_BUCKET", 50)  # cells are split
    rows = rows_of(packing.pack(messy, PATH, with_ids=True))
    check(messy, rows, encode)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(nothing, PATH).count() == 0


def test_chunks_encode_like_whole_texts(encode, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_CHUNKS", 3)
    encoder = packing.ChunkEncoder(PATH)
    texts = ["Don't stop, it's 12,5%!!! ...ok\tTab x\x1fy", "İ ΣΑΣ é é 🙂🙂 한글 漢字", "<|endoftext|> a<|startoftext|>b", "", " \n\n ", "_a_ 'll we'll 's", "x" * 500, "Ünïcödé,, (brackets) [x] #tag @at a-b"]
    for _ in range(2):
        for text, found in zip(texts, encoder.encode(texts), strict=True):
            assert (np.append(np.frombuffer(found, "<u4"), 2) == encode(text)).all(), text


def test_hilbert():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_order_depends_on_rows_alone(spark, messy, monkeypatch):
    """However small the buckets are, the order is that of one bucket: key, then hash."""
    docs = messy.unionByName(messy.limit(1).drop("doc_id").crossJoin(spark.range(100, 130).withColumnRenamed("id", "doc_id")))  # many share a key
    monkeypatch.setattr(packing, "LEAST_BUCKET", 1 << 40)
    monkeypatch.setattr(packing, "MOST_BUCKET", 1 << 40)
    whole = sorted(map(str, rows_of(packing.pack(docs, PATH, length=64))))
    for size in (3000, 300, 1):
        monkeypatch.setattr(packing, "LEAST_BUCKET", size)
        monkeypatch.setattr(packing, "MOST_BUCKET", size)
        assert sorted(map(str, rows_of(packing.pack(docs, PATH, length=64)))) == whole, size


def test_documents_follow_the_curve(spark, encode):
    """The order of documents in sequences is that of Hilbert keys computed from whole texts."""
    docs = spark.createDataFrame([(i, prose(i % 7 * 100 + i, 20 + 13 * i)) for i in range(60)], "doc_id long, text string")
    rows = sorted(rows_of(packing.pack(docs, PATH, length=256)), key=lambda r: (r["sequence_id"], r["offset"]))
    order = list(dict.fromkeys(r["doc_id"] for r in rows))
    size = Tokenizer.from_file(PATH).get_vocab_size()
    keys = {r["doc_id"]: int(packing.curve_keys([encode(r["text"])], size)[0]) for r in docs.collect()}
    assert len(set(keys.values())) > 50 and [keys[i] for i in order] == sorted(keys.values())


def test_large_vocabulary(spark, tmp_path):
    tokenizer = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokenizer.save(f"{tmp_path}/large.json")
    docs = spark.createDataFrame([(1, "w5 w65535 w65536 w69999")], "doc_id long, text string")
    (row,) = rows_of(packing.pack(docs, f"{tmp_path}/large.json", with_ids=True))
    assert row["ids"] == [5, 65535, 65536, 69999, 2]
