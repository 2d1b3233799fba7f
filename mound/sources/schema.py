"""Column contract of the four tables. Names, order, domains."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*groups: tuple[T.DataType, bool, tuple[str, ...]]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, dtype, nullable)
            for dtype, nullable, names in groups
            for name in names
        ]
    )


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

LABEL = "control_success"

TEST = _struct(
    (_S, False, ("row_id",)),
    (_I, False, ("season", "game_month", "game_dayofweek", "inning")),
    (_S, False, ("top_bottom", "game_type")),
    (_I, False, ("balls_before", "strikes_before", "outs_before")),
    (_I, False, ("run_top_before", "run_bot_before", "run_total_before")),
    (_I, False, ("score_diff_home", "score_diff_pitcher_team")),
    (_I, False, ("runner_on_1b", "runner_on_2b", "runner_on_3b", "num_runners_on")),
    (_S, False, ("base_state",)),
    (_D, True, ("home_win_expectancy", "away_win_expectancy", "li")),
    (_S, False, ("pitcher_id", "batter_id")),
    (_S, True, ("pitcher_hand", "batter_hand")),
    (_S, False, ("pitcher_team_id", "batter_team_id")),
    (_L, False, ("asof_pitcher_n",)),
    (_D, True, (
        "asof_pitcher_success_rate", "asof_pitcher_reverse_rate", "asof_pitcher_middle_rate",
        "asof_pitcher_ball_rate", "asof_pitcher_strike_rate",
        "asof_pitcher_prev1_game_success_rate", "asof_pitcher_prev3_game_success_rate",
        "asof_pitcher_prev5_game_success_rate", "asof_pitcher_prev1_game_middle_rate",
        "asof_pitcher_prev3_game_middle_rate", "asof_pitcher_prev5_game_middle_rate",
    )),
    (_L, False, ("asof_batter_n",)),
    (_D, True, ("asof_batter_success_rate", "asof_batter_middle_rate")),
    (_L, False, ("asof_pitcher_pitchmix_n",)),
    (_D, True, (
        "asof_pitcher_fastball_rate", "asof_pitcher_breaking_rate",
        "asof_pitcher_offspeed_rate",
    )),
)

TRAIN = T.StructType(TEST.fields + [T.StructField(LABEL, _I, False)])

MEASUREMENTS = (
    "rel_speed",
    "spin_rate",
    "induced_vert_break",
    "horz_break",
    "extension",
    "rel_height",
    "rel_side",
    "zone_speed",
)

TRACKMAN = _struct(
    (_S, False, ("trackman_id",)),
    (_I, False, ("season",)),
    (T.DateType(), False, ("game_date",)),
    (_I, False, ("game_month", "game_dayofweek")),
    (_S, False, ("trackman_game_id",)),
    (_I, False, ("pitch_no", "inning")),
    (_S, False, ("top_bottom",)),
    (_I, False, ("balls_before", "strikes_before", "outs_before", "pitch_of_pa")),
    (_S, False, ("pitcher_trackman_id", "batter_trackman_id")),
    (_S, True, ("pitcher_hand", "batter_hand", "pitcher_team", "batter_team")),
    (_S, True, ("tagged_pitch_type", "auto_pitch_type", "pitch_type_group")),
    (_D, True, MEASUREMENTS),
)

SUBMISSION = _struct((_S, False, ("row_id",)), (_D, False, (LABEL,)))

# Documented table sizes.
TRAIN_ROWS = 1_475_092
TRACKMAN_ROWS = 1_793_078
HISTORY_SEASONS = (2019, 2024)

# Documented codes.
BASE_STATES = ("___", "1__", "_2_", "__3", "12_", "1_3", "_23", "123")
HALVES = ("T", "B")
PITCH_GROUPS = ("fastball", "breaking", "offspeed", "other")

RATE_COLUMNS = tuple(n for n in TEST.names if n.startswith("asof_") and n.endswith("_rate"))

# What settles only with the current pitch: its label, type and measurements,
# and the outcome indicators a log may carry next to them.
BANNED = (
    LABEL,
    "is_reverse",
    "is_middle",
    "is_ball",
    "is_strike",
    "count_outcome",
    "tagged_pitch_type",
    "auto_pitch_type",
    "pitch_type_group",
) + MEASUREMENTS

# SQL conditions a row must satisfy, by column. A null never counts as a
# violation here; null_profile counts those.
PITCH_DOMAINS = {
    "game_dayofweek": "game_dayofweek between 0 and 6",
    "game_month": "game_month between 1 and 12",
    "inning": "inning >= 1",
    "top_bottom": "top_bottom in ('T', 'B')",
    "runner_on_1b": "runner_on_1b in (0, 1)",
    "runner_on_2b": "runner_on_2b in (0, 1)",
    "runner_on_3b": "runner_on_3b in (0, 1)",
    "base_state": "base_state in ('___', '1__', '_2_', '__3', '12_', '1_3', '_23', '123')",
    "home_win_expectancy": "home_win_expectancy between 0 and 100",
    "away_win_expectancy": "away_win_expectancy between 0 and 100",
}
TRAIN_DOMAINS = {**PITCH_DOMAINS, LABEL: f"{LABEL} in (0, 1)"}
# Soft: the scale of the rates is not documented.
RATE_DOMAINS = {c: f"{c} between 0 and 1" for c in RATE_COLUMNS}
TRACKMAN_DOMAINS = {
    "season": "season between 2019 and 2024",
    "game_dayofweek": "game_dayofweek between 0 and 6",
    "pitch_type_group": "pitch_type_group in ('fastball', 'breaking', 'offspeed', 'other')",
}
