"""Count outcomes, sketches of quantiles, plans of scores, and what as-of plans shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mound.operators import asof, checks, sketches
from mound.plans import model
from mound.plans.catalog import MODEL_CATEGORIES, MODEL_NUMBERS, MODEL_RATES, _fitted
from tests.conftest import SF

TURN = ("inning", "top_bottom", "batter_id")
PITCH = "row_id string, game_id int, pitch_no int, inning int, top_bottom string, batter_id int, balls_before int, strikes_before int"


def pitches(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        game = rng.choice([None, 1, 1, 1, 2, 3])
        rows.append((f"r{i:04d}", game, i, 1, rng.choice("TTB"), rng.choice([5, 5, None]), rng.choice([0, 1, 1, 2, None]), rng.choice([0, 0, 1, 2])))
    return rows


@pytest.mark.parametrize("block_rows", [4096, 1, 7])
def test_count_outcome(spark, block_rows):
    rows = pitches(block_rows)
    want = {}
    for r in rows:
        later = [x for x in rows if x[1] == r[1] and x[2] > r[2]] if r[1] is not None else []
        nxt = min(later, key=lambda x: x[2], default=None)
        change = None
        if nxt and nxt[3:6] == r[3:6] and None not in (nxt[6], r[6]):
            change = {(1, 0): "ball", (0, 1): "strike", (0, 0): "same"}.get((nxt[6] - r[6], nxt[7] - r[7]))
        want[r[0]] = change
    out = asof.count_outcome(spark.createDataFrame(rows, PITCH), block_rows=block_rows)
    assert {r.row_id: r.count_outcome for r in out.collect()} == want
    assert len(set(want.values())) == 4
    assert [r.column for r in checks.forbid_columns(out).collect()] == ["count_outcome"]


@pytest.mark.parametrize("block_rows", [4096, 1, 7])
def test_appearances_without_a_game_or_a_batter(spark, block_rows):
    rows = pitches(30 + block_rows)
    out = {r.row_id: (r.pa_no, r.pitch_of_pa) for r in asof.pitch_of_pa(spark.createDataFrame(rows, PITCH), block_rows=block_rows).collect()}
    state = {}
    for r in rows:
        if r[1] is None:
            assert out[r[0]] == (None, None)
            continue
        pa, at, prev = state.get(r[1], (0, 0, None))
        pa, at = (pa, at + 1) if r[3:6] == prev else (pa + 1, 1)
        state[r[1]] = (pa, at, r[3:6])
        assert out[r[0]] == (pa, at)
    assert len(out) == len(rows)


def test_sketches_merge_for_any_cut_off(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(2000, 2005), rng.randrange(1, 13), rng.gauss(90, 5)) for _ in range(40_000)]
    rows += [(3, 2001, 1, float(v)) for v in range(7)] + [(3, 2001, 2, None), (3, 2001, 2, float("nan")), (None, 2001, 1, 5.0)]
    log = spark.createDataFrame(rows, "p int, season int, game_month int, v double")
    kept = sketches.monthly_sketches(log, ["p"], ["v"])
    for season in (2001, 2003, 2010):
        found = sketches.quantiles_before(kept, ["p"], season)
        past = log.filter(F.col("season") < season)
        errors = {r.p: r for r in sketches.rank_errors(past, found, ["p"], ["v"]).collect() if r.p is not None}
        for p, r in errors.items():
            values = [x for q, s, _, x in rows if q == p and s < season and x is not None and x == x]
            assert r.n == len(values)
            assert max(r.q10_error, r.q50_error, r.q90_error) <= (0.02 if len(values) > 400 else 0.5 / len(values) + 1e-9)
        assert {r.n for r in found.filter("p is null").collect()} <= {1}
    assert sketches.quantiles_before(kept, ["p"], 1990).count() == 0
    assert sketches.quantiles_before(kept, ["p"], 2010).filter("p = 3").first().q50 == 3.0


def test_scoring_plan(spark):
    fitted, test = _fitted(spark, SF)
    scored = model.score(fitted, test, MODEL_RATES)
    assert [tuple(r) for r in checks.check_scoring_plan(scored).collect()] == [("scoring_plan", "", 0)]
    assert set(MODEL_NUMBERS + MODEL_CATEGORIES) <= set(test.columns)
    from pyspark.sql import Window

    by_file = test.withColumn("inning", F.row_number().over(Window.partitionBy("pitcher_id").orderBy("row_id")))
    found = {r.column: r.violations for r in checks.check_scoring_plan(model.score(fitted, by_file, MODEL_RATES)).collect()}
    assert found.get("Window") == 1
    mean = test.groupBy("pitcher_id").agg(F.count("*").alias("seen"))
    joined = model.score(fitted, test.join(mean, "pitcher_id"), MODEL_RATES, keep=("row_id", "seen"))
    assert "Aggregate" in {r.column for r in checks.check_scoring_plan(joined).collect()}


def test_rows_are_shuffled_once(spark):
    """The carried sums meet the rows in the partitioning of their window."""
    log = spark.range(1_000).selectExpr(
        "concat('r', id) as row_id", "id % 7 as pitcher_id", "date_add(date '2020-01-01', cast(id % 9 as int)) as game_date",
        "id % 9 as game_id", "id as pitch_no", "cast(id % 2 as int) as control_success",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = asof.asof_rates(log, "pitcher_id", "pitcher", {"success": "control_success"})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert join.count("__spread") == 2 and "__spread" not in join.split("LeftOuter")[1]
    # Rows once; the totals for their sum, for being carried and for the join.
    assert plan.count("Exchange hashpartitioning") == 4


def test_history_is_shuffled_once(spark, monkeypatch):
    log = spark.range(1_000).selectExpr("id % 7 as pitcher_id", "cast(2000 + id % 5 as int) as season", "1 as k")
    seen = []
    monkeypatch.setattr(asof, "settle", lambda df: seen.append(df) or df)
    asof.fit_history(log, "pitcher_id", ["season"], {"k": F.col("k")})
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
