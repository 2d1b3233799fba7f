from __future__ import annotations

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from mound.functions import scalars, state
from mound.operators.attach import pitch_group
from mound.sources.schema import BASE_STATES


def test_base_states_round_trip(spark):
    flags = list(itertools.product((0, 1), repeat=3))
    df = spark.createDataFrame(flags, "runner_on_1b int, runner_on_2b int, runner_on_3b int")
    coded = df.select("*", state.base_state().alias("base_state"))
    assert {r.base_state for r in coded.collect()} == set(BASE_STATES)
    back = coded.select(
        *[F.col(c).alias(f"was_{c}") for c in state.RUNNERS], "base_state"
    ).withColumns(state.decode_base_state())
    same = [F.col(c) == F.col(f"was_{c}") for c in state.RUNNERS]
    assert back.filter(same[0] & same[1] & same[2]).count() == 8


@pytest.mark.parametrize("half, home, pitcher", [("T", 2, 2), ("B", 2, -2)])
def test_score_side(spark, half, home, pitcher):
    df = spark.createDataFrame([(1, 3, half)], "run_top_before int, run_bot_before int, top_bottom string")
    out = df.select(state.score_diff_home(), state.score_diff_pitcher_team(), state.run_total()).first()
    assert tuple(out) == (home, pitcher, 4)


def test_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1),), (datetime.date(2024, 1, 7),)], "d date")
    out = df.select(scalars.game_dayofweek("d"), *scalars.season_month("d").values()).collect()
    assert [tuple(r) for r in out] == [(0, 2024, 1), (6, 2024, 1)]


def test_rates(spark):
    df = spark.createDataFrame(
        [(0, None), (100, 0.4)], "n long, rate double"
    )
    smooth = scalars.smooth_rate("n", "rate", F.lit(0.3), 100)
    assert [r[0] for r in df.select(smooth).collect()] == pytest.approx([0.3, 0.35])
    assert [r[0] for r in df.select(scalars.safe_rate(F.lit(1), "n")).collect()] == [None, 0.01]
    flags = df.withColumns(scalars.missing_flags(["rate"]))
    assert [r.rate_missing for r in flags.collect()] == [1, 0]
    assert [r[0] for r in df.select(scalars.fallback("rate", F.lit(0.2))).collect()] == [0.2, 0.4]


def test_clip_keeps_what_is_no_number(spark):
    df = spark.createDataFrame([(-0.5,), (0.2,), (1.5,), (None,), (float("nan"),)], "p double")
    got = [r[0] for r in df.select(scalars.clip_probability("p")).collect()]
    assert got[:4] == [0.0, 0.2, 1.0, None] and got[4] != got[4]


def test_pitch_group_prefers_the_tag(spark, rows):
    mapping = spark.createDataFrame(
        [("Four-Seam", "fastball"), ("Slider", "breaking")], "pitch_name string, pitch_group string"
    )
    log = spark.createDataFrame(
        [(1, "Slider", "Four-Seam"), (2, None, "Four-Seam"), (3, "?", "?"), (4, None, None)],
        "i int, tagged_pitch_type string, auto_pitch_type string",
    )
    got = rows(pitch_group(log, mapping), "i", "pitch_type_group")
    assert got == [(1, "breaking"), (2, "fastball"), (3, "other"), (4, "other")]


def test_platoon_and_count(spark):
    df = spark.createDataFrame(
        [("L", "L", 3, 2, 1), ("L", "R", 0, 0, 0), (None, "R", 0, 0, 0)],
        "pitcher_hand string, batter_hand string, balls_before int, strikes_before int, outs_before int",
    )
    got = [tuple(r) for r in df.select(state.platoon(), state.count_state()).collect()]
    assert got == [("same", "3-2-1"), ("opposite", "0-0-0"), (None, "0-0-0")]
