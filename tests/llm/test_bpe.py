import hashlib
import struct

import numpy as np
import pytest
import pyarrow as pa
from tokenizers import Tokenizer

from loomspark.llm import bpe
from loomspark.llm.queries import op2_bpe_encode_decode, vocabulary

CASES = [
    (1, "Hello  wörld, it's <|endoftext|> 日本 x \x00 é é"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r"),
    (5, "a<|startoftext|>b c\x1cd   e"),
    (6, "x" * 5000 + " " + "ΑΣ ΣΑΣ 12345 don't we'll"),
    (7, "Hello  wörld"),
    (7, "Hello  wörld"),
    (None, "\U0001f600 tie"),
]


def brute(text):
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    text = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_same_as_library_on_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    monkeypatch.setattr(bpe, "WHOLE_BYTES", 200)
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in CASES], "doc_id long, text string, word string, block string").coalesce(2)
    got = bpe.encode_decode(docs, vocabulary(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(t))) for i, t in CASES)


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_bpe_encode_decode(spark, sf).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == brute(texts[r.doc_id]) for r in got)


def test_decode_by_join(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld, it's"), (2, ""), (3, None)], "doc_id long, text string")
    got = bpe.encode_decode(docs, vocabulary())
    joined = {r.doc_id: r.decoded for r in bpe.decode(got, vocabulary()).collect()}
    assert joined == {r.doc_id: r.decoded for r in got.collect()}


def test_packed_numbers():
    for n in ([], [0], [127, 128, 0, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**32 - 1, 5]):
        assert bpe.unpack(bpe.pack(np.array(n, np.uint32))).tolist() == n


def test_each_distinct_word_once(spark, monkeypatch):
    """Words in many blocks and documents reach the tokenizer once."""
    docs = spark.createDataFrame([(i, "a b a c" + " w" * (i % 5)) for i in range(500)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(bpe, "WHOLE_BYTES", 500)
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def __init__(self, t):
            self.t = t

        def encode_batch_fast(self, words, **kw):
            seen.add(len(words))
            return self.t.encode_batch_fast(words, **kw)

    real = bpe.load_tokenizer
    run = bpe._encode(spark.sparkContext.broadcast(open(vocabulary()).read()))
    monkeypatch.setattr(bpe, "load_tokenizer", lambda blob: Counting(real(blob)))
    packed = [[k, 0, bpe.squeeze(b"".join(w + b"\n" for w in ws))] for k, ws in enumerate([(b"a", b"b"), (b"b", b"c", b""), (b"c", b"a")])]
    got = [b for r in packed for b in run(iter([pa.RecordBatch.from_arrays([pa.array([x]) for x in r], names=["block", "part", "packed"])]))]
    assert [len(bpe.unpack(b.column(2)[0].as_py())) for b in got] == [2, 3, 2]
    seen.value = 0
    list(run(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*packed)], names=["block", "part", "packed"])])))
    assert seen.value == 4
    monkeypatch.setattr(bpe, "load_tokenizer", real)
    assert bpe.encode_decode(docs, vocabulary()).count() == 500
