"""Held-out accuracy on planted insults, hidden forms, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mound.llm import toxicity

CLEAN = "river stone window garden paper copper morning letter silver basket velvet harbor candle meadow engine".split()
BAD = ["blockhead", "numskull", "dimwit"]


def sentences(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(6, 14))
        words = [w + rng.choice(["", "s", "ed", "ing"]) for w in words]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((" ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.createDataFrame(sentences(400), "text string, toxic int"), landmarks=48)


def margin_score(model, text):
    words = sorted(toxicity.strings(text))
    margins = model.margins(words) if words else np.array([model.offset])
    return float(model.score(margins.max(keepdims=True))[0])


def test_held_out_sentences(model):
    got = [(margin_score(model, t) >= 0.5) == bool(y) for t, y in sentences(200, seed=9)]
    assert np.mean(got) > 0.97


@pytest.mark.parametrize("word", ["blockhead", "BLOCKHEAD!", "block-head", "blockkhead", "blo.ckhead", "num*skull", "d i m w i t"])
def test_hidden_insults(model, word):
    assert margin_score(model, f"river stone {word} garden") >= 0.5


def test_kernel_is_that_of_all_gapped_subsequences():
    words = ["abc", "axbc", "cabbage", "b"]
    marks = ["abc", "bag"]
    got = toxicity.kernel(toxicity.Alphabet(marks), words, marks)

    def vector(w):
        s, out, norm = "\x01" + w + "\x02", {}, 0.0
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    v = toxicity.DECAY ** (k - i + 1)
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + v
                    norm += v * v
        return {k: v / norm**0.5 for k, v in out.items()}

    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = vector(w), vector(m)
            assert got[i, j] == pytest.approx(sum(v * b.get(k, 0) for k, v in a.items()), abs=1e-5)


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a dimwit " * 5000, None)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert [r.doc_id for r in out] == [1, 2, 2, None]
    assert out[0].score == out[1].score == out[2].score < 0.5
    assert out[3].predicted == 1
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_fit_without_both_labels(spark, documents):
    none = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert toxicity.score(documents([(1, "a dimwit")]), none).first().predicted == 0
    bad = toxicity.fit(spark.createDataFrame([("x", 1), (None, 1), ("y", None)], "text string, toxic int"))
    assert toxicity.score(documents([(1, "a")]), bad).first().predicted == 1


def test_learns_only_from_the_rest(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    import zlib

    got = {r.text for r in toxicity.training_rows(docs, labels).collect()}
    assert got == {f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    held = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_fit_takes_a_thousand_texts_of_each_label():
    assert toxicity.FIT_TEXTS >= 1_000 and not hasattr(toxicity, "CLEAN_STRINGS")


def test_large_alphabet_needs_no_cube():
    """2,000 characters: 8 * 10^9 cells as an array; codes beyond 32 bits."""
    rng = random.Random(4)
    marks = ["".join(chr(0x4E00 + 2_000 * i // 40 + rng.randrange(50)) for _ in range(60)) for i in range(40)]
    alphabet = toxicity.Alphabet(marks + [chr(0x4E00 + i) for i in range(2_000)])
    assert alphabet.size > 2_000
    codes = toxicity.Codes(alphabet, marks)
    assert codes.codes.min() > 2**31 - 1 or codes.codes.max() > 2**31 - 1
    assert codes.spread(np.zeros(len(codes.codes) + 1)) is None
    got = toxicity.kernel(alphabet, marks + ["none of it"], marks)
    assert (np.diag(got[:40]) > 1 - 1e-5).all() and got[40].max() < 0.05
    small = toxicity.kernel(toxicity.Alphabet(marks[:1]), marks[:1] + [marks[0][::2]], marks[:1])
    large = toxicity.kernel(alphabet, marks[:1] + [marks[0][::2]], marks[:1])
    assert np.allclose(small, large, atol=1e-6)


def test_parts_of_a_long_string_add_up(model, monkeypatch):
    words = ["blockhead" * 30, "x" * 500, "dimwit"]
    whole = model.margins(words)
    mark = toxicity.kernel(model.alphabet, words, ["blockhead"])
    monkeypatch.setattr(toxicity, "STARTS", 37)
    assert np.allclose(model.margins(words), whole, atol=1e-6)
    assert np.allclose(toxicity.kernel(model.alphabet, words, ["blockhead"]), mark, atol=1e-6)


def test_token_of_five_megabytes(spark, model):
    import tracemalloc

    text = "ab" * 2_500_000
    tracemalloc.start()
    assert model.margins([text]).shape == (1,)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    rows = spark.createDataFrame([(1, text + " dimwit"), (2, text)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(rows, model).orderBy("doc_id").collect()] == [1, 0]


def test_one_id_counts_once(spark, documents):
    labels = spark.range(200_000).selectExpr("1L as doc_id", "0 as quality", "cast(id % 2 as int) as toxic")
    docs = documents([(1, f"text {i % 7}") for i in range(300)] + [(2, "other")])
    more = spark.createDataFrame([(2, 0, 0), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, labels.unionByName(more)).collect()
    want = {(1, 1), (2, 0)} - {(i, t) for i, t in ((1, 1), (2, 0)) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    assert len(got) == len(want) and sorted(r.toxic for r in got) == sorted(t for _, t in want)
