"""Rules for rows without a key, keys that repeat, values that are no numbers, and passes over the log."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from mound.functions import scalars
from mound.operators import aggregates, asof, checks, joins, scoring
from mound.operators.attach import pitch_group
from mound.plans.catalog import QUERIES
from tests.conftest import SF

LOG = "row_id string, game_date date, game_id int, pitch_no int, pitcher_id int, batter_id int, control_success int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        day = rng.randrange(1, 9)
        pitcher = rng.choice([None, 1, 1, 1, 2])
        rows.append((f"r{i:04d}", f"2020-01-0{day}", day * 10, i, pitcher, rng.choice([None, 5, 6]), rng.randrange(2)))
    return spark.createDataFrame(rows, LOG.replace("date date", "date string")).withColumn("game_date", F.to_date("game_date"))


def brute(rows, key):
    """Count and sum over the earlier rows of the key, by row id; None without a key."""
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.game_date, r.game_id, r.pitch_no, r.row_id)):
        k = r[key]
        n, s = seen.get(k, (0, 0))
        out[r.row_id] = None if k is None else (n, s)
        seen[k] = n + 1, s + r.control_success
    return out


@pytest.mark.parametrize("key,prefix", [("pitcher_id", "pitcher"), ("batter_id", "batter")])
def test_rows_without_a_player(log, key, prefix):
    want = brute(log.collect(), key)
    out = asof.asof_rates(log, key, prefix, {"success": "control_success"}).collect()
    assert len(out) == 600
    for r in out:
        n, rate = r[f"asof_{prefix}_n"], r[f"asof_{prefix}_success_rate"]
        if want[r.row_id] is None:
            assert n is None and rate is None
        else:
            assert (n, rate) == (want[r.row_id][0], want[r.row_id][1] / n if n else None)


def test_all_features_without_a_player(log):
    rows = log.withColumns({c: F.lit(0) for c in ("is_reverse", "is_middle", "is_ball", "is_strike")})
    out = asof.asof_features(rows.withColumn("pitch_type_group", F.lit("fastball"))).collect()
    pitchers, batters = brute(log.collect(), "pitcher_id"), brute(log.collect(), "batter_id")
    for r in out:
        for n, want in ((r.asof_pitcher_n, pitchers[r.row_id]), (r.asof_batter_n, batters[r.row_id])):
            assert n == (None if want is None else want[0])
    assert len(out) == 600


def test_neighbours_and_rolling_without_a_player(log):
    out = asof.rolling(log, "pitcher_id", 5, {"k": F.sum("control_success")})
    assert out.count() == 600
    assert out.filter("pitcher_id is null and k is not null").count() == 0


def test_repeated_keys_of_fitted_tables(spark):
    mapping = spark.createDataFrame([("x", "fastball"), ("x", "other")], "pitch_name string, pitch_group string")
    rows = spark.createDataFrame([("x", None)], "tagged_pitch_type string, auto_pitch_type string")
    with pytest.raises(ValueError):
        pitch_group(rows, mapping)
    priors = spark.createDataFrame([(1, 0.5), (1, 0.6)], "pitcher_id int, success_rate double")
    with pytest.raises(ValueError):
        joins.join_priors(spark.createDataFrame([(1,)], "pitcher_id int"), {"pitcher_id": priors})


def test_smoothing_nothing(spark):
    row = spark.range(1).select(scalars.smooth_rate(F.lit(0), F.lit(None).cast("double"), F.lit(0.3), 0.0).alias("r"))
    assert row.first().r is None


def test_values_that_are_no_numbers(spark):
    rows = spark.createDataFrame([(math.nan, 1), (None, 0), (0.05, 1), (0.95, 0)], "score double, control_success int")
    assert {r.bin: r.n for r in aggregates.histogram(rows, "score", 0.0, 0.1, 10).collect()} == {0: 1, 9: 1}
    assert {r.bin: r.n for r in scoring.reliability(rows).collect()} == {None: 1, 0: 1, 9: 1}


def test_row_independence_finds_what_depends_on_the_file(spark):
    test = spark.range(10).withColumnRenamed("id", "row_id")
    part = F.col("row_id") < 4
    alone = {r["check"]: r.violations for r in checks.check_row_independence(lambda d: d, test, part).collect()}
    assert alone == {"row_independence": 0, "rows_compared": 10}
    sized = checks.check_row_independence(lambda d: d.withColumn("n", F.lit(d.count())), test, part)
    assert {r["check"]: r.violations for r in sized.collect()} == {"row_independence": 20, "rows_compared": 10}


@pytest.mark.parametrize("name,most", [("w24_game_seq", 1), ("w9_asof_pitcher_prev5_game_success_rate", 2), ("w1_w19_asof_features", 2), ("q8_asof", 2), ("w21_pitch_of_pa", 2), ("q5_tracking_domains", 2)])
def test_passes_over_the_log(spark, monkeypatch, name, most):
    from pyspark.sql import DataFrame, DataFrameWriter

    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1].split("== Initial Plan ==")[0])

    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (keep(self._df), parquet(self, *a, **k))[1])
    out = QUERIES[name](spark, SF)
    assert isinstance(out, DataFrame)
    keep(out)
    assert sum(p.count("/lineitem.parquet") for p in plans) <= most
