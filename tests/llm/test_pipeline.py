"""The stages one by one on a small corpus, and the whole run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mound.llm import simhash, toxicity
from tests.conftest import SF


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF).cache()))
        docs = out[-1][1]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns(results):
    for before, after in results[:-1]:
        assert after.columns == before.columns


def test_toxicity(spark, results):
    before, after = results[0]
    model = toxicity.fit(toxicity.training_rows(before, spark.read.parquet(f"{SF}/labels.parquet")))
    want = [r.doc_id for r in before.collect() if model.score(max([*model.margins(sorted(toxicity.strings(r.text))), model.offset][: len(toxicity.strings(r.text)) or None])) < 0.5]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_near_copies(results):
    before, after = results[1]
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    root = {i: i for i in fps}
    for i in sorted(fps):
        for j in sorted(fps):
            if i < j and root[i] != root[j] and bin(fps[i] ^ fps[j]).count("1") <= 4:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(root.values()))


def test_pii(results):
    before, after = results[2]
    kept = {r.doc_id: r for r in after.collect()}
    assert kept.keys() == {r.doc_id for r in before.collect()}
    from tests.llm.test_pii import base

    for r in before.collect():
        assert base(kept[r.doc_id].text) == [] and kept[r.doc_id].n_chars == len(kept[r.doc_id].text)
        if not base(r.text):
            assert kept[r.doc_id].text == r.text


def test_mixing(results):
    before, after = results[3]
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    n = [r["count"] for r in after.groupBy("doc_id").count().collect()]
    assert n and max(n) <= 3


def test_encoding(results):
    before, after = results[4]
    assert after.count() == before.count()
    assert after.filter("not (parity and round_trip)").count() == 0


def test_run(spark, results):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(results[-1][1])


LONG = "plain words of one very long text " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns of clashing names."""
    rows = [
        (1, "some words a@b.cd and more of them", "en", "a", 34), (1, "some words a@b.cd and more of them", "en", "a", 34), (2, None, None, None, None),
        (3, "", "en", "a", 0), (None, "no id here but 10.0.0.1 stands", "de", None, 30), (4, LONG, "en", "b", len(LONG)), (5, "x", "en", "c", 1), (6, "", "en", "only empty", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = ("score", "predicted", "key", "base", "spans", "fingerprint", "component_id", "copies", "size", "target", "ids", "parity", "n_tokens", "leak")
    return docs.withColumns({c: F.lit("mine") for c in more})


def outcome(spark, docs, number):
    return corpus_pipeline.STAGES[number][1](spark, docs, SF)


def test_odd_rows_of_toxicity(spark, odd):
    out = outcome(spark, odd, 0)
    assert out.columns == list(corpus_pipeline.DOCUMENTS)
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 1, 2, 3, 4, 5, 6]


def test_odd_rows_of_near_copies(spark, odd):
    out = outcome(spark, odd, 1)
    assert out.columns == list(corpus_pipeline.DOCUMENTS)
    # 2, 3 and 6 have no words: one group.
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 4, 5]


def test_odd_rows_of_pii(spark, odd):
    out = outcome(spark, odd, 2)
    assert out.columns == list(corpus_pipeline.DOCUMENTS)
    texts = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.filter("doc_id is null or doc_id != 2").collect())
    one = "some words [EMAIL] and more of them"
    assert texts == [(0, "no id here but [IP] stands", 26), (1, one, len(one)), (1, one, len(one)), (3, "", 0), (4, LONG, len(LONG)), (5, "x", 1), (6, "", 0)]
    assert out.filter("doc_id = 2").first().text is None


def test_odd_rows_of_mixing(spark, odd):
    out = outcome(spark, odd, 3)
    assert out.columns == list(corpus_pipeline.DOCUMENTS)
    copies = {}
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    # The long text has nearly all words, and no source goes beyond three times its own.
    assert copies[None] == 3 and copies[1] == 6 and copies[5] == 3 and copies.get(4, 0) in (0, 1) and 6 not in copies


def test_odd_rows_of_encoding(spark, odd):
    out = {(r.doc_id, r.source): r for r in outcome(spark, odd, 4).collect()}
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in out.values())
    assert {k[0] for k, r in out.items() if r.n_tokens == 0} == {2, 3, 6}


@pytest.mark.parametrize("number", range(5))
def test_stages_of_an_empty_table(spark, odd, number):
    assert outcome(spark, odd.limit(0), number).count() == 0
