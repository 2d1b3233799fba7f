"""Both vector searches against brute force, with ties, hot vectors and odd rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mound.llm import ann_tree, cells, exact_topk
from mound.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle_check import differences

KIND = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 12))
    v = (centres[rng.integers(0, 6, 600)] + 0.3 * rng.normal(size=(600, 12))).astype(np.float32)
    v[100:300] = v[100]
    return v


def frame(spark, points):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], KIND)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_exact(spark, points):
    q = np.floor(1024 * points.astype(float)).astype(np.int64)
    want = {}
    for i in range(0, 600, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(600), -s)) if j != i][:10]
        want[i] = [(j, s[j]) for j in order]
    assert answers(exact_topk.top_k(frame(spark, points), every=20, regions=8, sample=200)) == want


def test_exact_with_many_shards(spark, points, monkeypatch):
    monkeypatch.setattr(cells.meet, "__defaults__", (40, 7))
    q = np.floor(1024 * points.astype(float)).astype(np.int64)
    got = answers(exact_topk.top_k(frame(spark, points), every=50, regions=4))
    for i in range(0, 600, 50):
        s = q @ q[i]
        assert got[i] == [(j, s[j]) for j in np.lexsort((np.arange(600), -s)) if j != i][:10]


def test_tree_covers_its_rows():
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 9, (500, 5)).astype(float)
    nodes, order, low, high = exact_topk.split(v, 16)
    assert sorted(order) == list(range(500))
    for (a, b, left, right), lo, hi in zip(nodes, low, high):
        own = v[order[a:b]]
        assert (own.min(0) == lo).all() and (own.max(0) == hi).all()
        assert left < 0 or (nodes[left][0], nodes[left][1], nodes[right][1]) == (a, nodes[right][0], b)
    q = rng.normal(size=(20, 5))
    assert (exact_topk.reach(q, low[:1], high[:1])[:, 0] >= (v @ q.T).max(0) - 1e-9).all()


def test_products_beyond_doubles():
    v = exact_topk.quantised(np.array([[3e38, 1.0], [2.0**40, 1 / 1024]]))
    assert exact_topk.products(v, v[0]).tolist() == [2**63 - 1, 2**63 - 1]
    assert exact_topk.products(v[1:], np.array([1.0, 1.0])).tolist() == [2**50 + 1]
    assert exact_topk.products(v[1:] + 0, np.array([512.0, 3.0])).tolist() == [2**59 + 3]


def test_recall(spark, points):
    got = answers(ann_tree.nearest(frame(spark, points), every=20, branch=4, calibrate=60, recall=0.95))
    v, share = points.astype(float), []
    for i in range(0, 600, 20):
        far = np.sqrt(np.square(v - v[i]).sum(1))
        order = [j for j in np.lexsort((np.arange(600), far)) if j != i][:10]
        assert [j for j, _ in got[i]] == sorted((j for j, _ in got[i]), key=lambda j: (far[j], j))
        assert [s for _, s in got[i]] == pytest.approx([far[j] for j, _ in got[i]])
        share.append(len(set(order) & {j for j, _ in got[i]}) / 10)
    assert np.mean(share) >= 0.9


def test_tree_places_every_row_in_a_leaf_it_visits(points):
    tree = ann_tree.Tree(points.astype(float), 4, 2)
    leaves = tree.place(points.astype(float))
    assert set(leaves) <= set(range(tree.leaves))
    for i in range(0, 600, 37):
        bins = tree.bins(points[i].astype(float), tree.leaves)
        assert sorted(bins) == list(range(tree.leaves)) and bins[0] == leaves[i]


@pytest.mark.parametrize("search", [exact_topk.top_k, ann_tree.nearest])
def test_odd_rows(spark, search):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.5, 0.5]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 0.0]),
        (11, []), (None, [1.0, 1.0]), (12, [2.0, 1.0]), (12, [2.0, 1.0]), (200, [1.0, 2.0, 3.0]), (13, [1.0, 1.0, 1.0]), (300, None), (400, [5.0]),
    ]
    df = spark.createDataFrame(rows, KIND).withColumns({"vec": F.lit("mine"), "score": F.lit(1), "cell": F.lit(None)})
    got = {q: [v for v, _ in a] for q, a in answers(search(df)).items()}
    assert {q: sorted(a) for q, a in got.items()} == {0: [12, 12, 100], 100: [0, 0, 12, 12], 200: [13]}
    assert search(df.limit(0)).count() == 0


def test_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (100, [1.0, 1.0])], KIND)
    assert set(answers(ann_tree.nearest(df))) == {100}
    assert answers(exact_topk.top_k(df)) == {0: [(1, 0), (100, 0)], 100: [(1, 1024**2), (0, 0)]}


def test_calibration_widens_until_recall():
    class One:
        leaves = 4

        def bins(self, v, n):
            return [2, 0, 1, 3][:n]

    asked = pd.DataFrame({"vec_id": [5], "dims": [2], "vec": [np.zeros(2)]})
    truth = pd.DataFrame({"query_id": [5] * 4, "rank": [1, 2, 3, 4], "cell": [2, 2, 0, 1]})
    assert [ann_tree.calibrated({2: One()}, truth, asked, r) for r in (0.5, 0.75, 1.0)] == [1, 2, 3]


def test_query_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    assert differences(QUERIES["op4_exact_topk"](spark, SF), con, ORACLES["op4_exact_topk"]) == []


def test_rows_go_only_where_they_are_asked_for(spark):
    """A cell that one query asks gets one block, one that nothing asks none, a crowded one as many as its queries fill."""
    rows = spark.range(3_000).selectExpr("id as vec_id", "2 as dims", "cast(id % 3 as int) as cell", "array(0.0D, 1.0D) as vec")
    sizes = rows.groupBy("dims", "cell").count().withColumnRenamed("count", "n")
    asks = spark.range(501).selectExpr("id as vec_id", "2 as dims", "cast(if(id = 0, 0, 1) as int) as cell", "array(0.0D, 1.0D) as vec")
    asks = asks.withColumns({"bound": F.lit(None).cast("long"), "only": F.lit(False)})
    sent, asked = cells.dealt(rows, sizes, asks, chunk=300, block=100)
    by_cell = {r.cell: (r["count"], r.b) for r in sent.groupBy("cell").agg(F.count("*").alias("count"), F.countDistinct("block").alias("b")).collect()}
    assert by_cell == {0: (1_000, 1), 1: (5_000, 5)}
    # Every query meets every chunk of its cell once.
    assert {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()} == {0: 4, 1: 500 * 4}
