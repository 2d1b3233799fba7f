"""Parity with the sentencepiece library, exact round trips, and both kinds of model."""

from __future__ import annotations

import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from mound.llm import sentencepiece_codec as codec
from tests.conftest import SF

ODD = ["", "  two  spaces ", "\n\t x", " lead", "<s> hi </s> <0x0A>", "emoji 🎉 ̈ü", "▁mark▁▁a", "a" * 3000, "   ", "日本語 テキスト", "x\x00y", "word " * 20_000]


@pytest.fixture(scope="module")
def data():
    with open(codec.default_model(), "rb") as f:
        return f.read()


def test_odd_texts(data):
    ours, theirs = codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, same = ours.encode(ODD)
    assert all(same) and ids == theirs.encode(ODD)
    assert ours.decode(ids) == theirs.decode(ids) == [t.replace("▁", " ") for t in ODD]


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = codec.encode(docs)
    assert out.columns == [*docs.columns, "ids", "n_tokens", "parity", "round_trip"]
    assert out.filter("parity and round_trip and n_tokens = size(ids)").count() == docs.count()
    assert codec.decode(out).filter("decoded != text").count() == 0


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (1, None), (None, ""), (2, "héllo  wörld")]).withColumn("ids", F.lit("mine"))
    rows = codec.decode(codec.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0, r.parity, r.decoded) for r in rows) == [
        (0, False, True, ""), (1, False, True, ""), (1, False, True, ""), (2, True, True, "héllo  wörld"),
    ]
    assert codec.encode(docs.limit(0)).count() == 0
    assert codec.decode(spark.createDataFrame([(1, None)], "a int, ids array<int>")).first().decoded is None


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number * 8 + 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number * 8) + varint(value)
    return varint(number * 8 + 2) + varint(len(value)) + value


def test_unigram_model_with_byte_fallback():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    words = {"▁": -3.0, "▁ca": -4.0, "t": -3.5, "▁cat": -5.0, "s": -3.0, "▁cats": -9.5, "a": -4.0, "c": -4.0, "ts": -4.4, "▁the": -4.0}
    pieces += [(p, s, 1) for p, s in words.items()]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1) + field(40, 0)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    spec = codec.parse(data)
    assert (spec.kind, spec.byte_fallback, spec.squeeze, len(spec.pieces)) == (1, True, True, len(pieces))
    ours, theirs = codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the cats", "  the   cat sat ", "caté 🎉", "", "tssca"]
    ids, same = ours.encode(texts)
    assert all(same) and ids == theirs.encode(texts)
    assert ours.decode(ids) == [ours.normalised(t) for t in texts] == theirs.decode(ids)


def test_parity_is_by_word(data):
    ours = codec.Codec(data)
    ours.encode(["one two three"])
    ours.known["two"] = ours.known["one"]
    ours.differ.add("two")
    ids, same = ours.encode(["one", "two", "three one", "one  two"])
    assert same == [True, False, True, True] and ids[1] == ids[0]
    assert ours.returns(ids, ["one", "two", "three one", "one  two"]) == [True, False, True, True]


class Other:
    """A library that gives other results for lines or batches."""

    def __init__(self, own, **other):
        self.own, self.other = own, other

    def __getattr__(self, name):
        return self.other.get(name) or getattr(self.own, name)


def test_line_that_differs_with_no_word_that_does(data):
    ours = codec.Codec(data)
    theirs = ours.theirs
    ours.theirs = Other(theirs, encode=lambda x, **k: theirs.encode(x) if isinstance(x, str) else [i[::-1] for i in theirs.encode(x)])
    assert ours.encode(["one two three"])[1] == [False]


def test_round_trip_rests_on_the_decoder(data):
    ours = codec.Codec(data)
    ours.whole = Other(ours.whole, decode_batch=lambda ids, **k: ["wrong"] * len(ids))
    ids, _ = ours.encode(["one two"])
    assert ours.returns(ids, ["one two"]) == [False]
