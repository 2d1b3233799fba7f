"""Targets against a brute-force filling, copies against the rates, and the DuckDB text."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from mound.llm import mixing
from mound.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle_check import differences


def filled(sizes, most=3):
    """Share out by weight; cap, and share the rest anew until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return {s: most * sizes[s] for s in names}
        left = total - sum(most * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 500, "c": 300},
        {"a": 1, "b": 2, "c": 1000, "d": 7, None: 90},
        {"a": 0, "b": 5},
        {"é": 3, "z": 4, "Z": 5, None: 600},
        {"a": 0},
    ],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(filled(sizes))


def test_mixture_follows_rates(documents):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    docs = documents(rows)
    rated = mixing.rated(docs).cache()
    for r in rated.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("k"), F.max("target").alias("t"), F.sum(F.col("size") ** 2).alias("s2")).collect():
        # A draw of probability p has variance p (1 - p) <= 1/4.
        assert abs(r.k - r.t) <= 3 * (r.s2 / 4) ** 0.5
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n == {r.doc_id: r.copies for r in rated.collect() if r.copies}
    assert rated.filter("copies not between 0 and 3").count() == 0


def test_odd_rows(spark, documents):
    docs = documents([(1, None, None), (None, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (3, "word " * 100_000, "b")])
    docs = docs.withColumn("size", F.lit("mine")).withColumn("target", F.lit(None).cast("int"))
    out = {(r.doc_id, r.size, r.source_size) for r in mixing.rated(docs).collect()}
    assert out == {(1, 0, 0), (None, 0, 4), (2, 2, 4), (3, 100_000, 100_000)}
    assert mixing.rated(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_query_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert differences(QUERIES["op2_mixing"](spark, SF), con, ORACLES["op2_mixing"]) == []


def test_rows_without_id_draw_by_text(spark):
    """Half of a source has no id: its copies come near the rate, and equal rows draw alike."""
    rows = [(None if i % 2 else i, f"w{i} b c d", "a") for i in range(1_000)] + [(i, "x " * 20, "b") for i in range(400)] + [(None, "same", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.rated(docs)
    r = out.filter("source = 'a'").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("copies") * F.col("size"))).alias("without"), F.first("target").alias("target"), F.first("source_size").alias("size")).first()
    assert abs(r.without / 2_003 - r.target / r.size) < 0.1
    assert out.filter("text = 'same'").select("copies").distinct().count() == 1
