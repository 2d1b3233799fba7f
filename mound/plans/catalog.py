"""Every operator as a query over the driver tables. All of them read whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mound.functions import scalars, state
from mound.operators import aggregates, asof, checks, filters, joins, ordered, scoring, sketches
from mound.operators.attach import pitch_group, settle, shared_folder
from mound.operators.ordered import GROUP_ROWS
from mound.plans import flows, model, streams
from mound.plans.pitch_view import pitch_view
from mound.sources import files, schema
from mound.sources.schema import LABEL

Query = Callable[[SparkSession, str], DataFrame]

ORDER = list(asof.ORDER)
TEST_SEASON = 2001
NUDGE = 1e-9
# Share of the rows by which a sketch's quantile may miss its rank.
RANK_ERROR = 0.02
STATE = [
    "inning", "top_bottom", "balls_before", "strikes_before", "outs_before", "run_top_before",
    "run_bot_before", "runner_on_1b", "runner_on_2b", "runner_on_3b",
]
SCORED = [*ORDER, "season", "pitcher_id", LABEL]

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _view(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: pitch_view(spark, sf, columns)


def _projection(name: str, columns: Sequence[str], derive: Callable[[], dict]) -> None:
    """A row-wise query: the id and the derived columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = derive()
        return pitch_view(spark, sf, ["row_id", *columns]).withColumns(out).select("row_id", *out)

    QUERIES[name] = run


# --- as-of columns -----------------------------------------------------------------

PITCHER_RATES = {
    "w2": "success", "w3": "reverse", "w4": "middle", "w5": "ball", "w6": "strike",
}


def _asof(name: str, key: str, prefix: str, column: str, outcomes=(), mix=()) -> None:
    table = {"pitcher": asof.PITCHER_OUTCOMES, "batter": asof.BATTER_OUTCOMES}[prefix]
    picked = {o: table[o] for o in outcomes}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        extra = ["pitch_type_group"] if mix else []
        log = pitch_view(spark, sf, [*ORDER, key, *picked.values(), *extra])
        return asof.asof_rates(log, key, prefix, picked, mix, limit=GROUP_ROWS).select("row_id", column)

    QUERIES[f"{name}_{column}"] = run


_asof("w1", "pitcher_id", "pitcher", "asof_pitcher_n")
for _id, _outcome in PITCHER_RATES.items():
    _asof(_id, "pitcher_id", "pitcher", f"asof_pitcher_{_outcome}_rate", [_outcome])
_asof("w13", "batter_id", "batter", "asof_batter_n")
_asof("w14", "batter_id", "batter", "asof_batter_success_rate", ["success"])
_asof("w15", "batter_id", "batter", "asof_batter_middle_rate", ["middle"])
_asof("w16", "pitcher_id", "pitcher", "asof_pitcher_pitchmix_n", mix=["fastball"])
for _id, _group in (("w17", "fastball"), ("w18", "breaking"), ("w19", "offspeed")):
    _asof(_id, "pitcher_id", "pitcher", f"asof_pitcher_{_group}_rate", mix=[_group])

PREV = {
    "w7": (1, "success"), "w8": (3, "success"), "w9": (5, "success"),
    "w10": (1, "middle"), "w11": (3, "middle"), "w12": (5, "middle"),
}


def _prev(name: str, k: int, outcome: str) -> None:
    column = f"asof_pitcher_prev{k}_game_{outcome}_rate"
    picked = {outcome: asof.PITCHER_OUTCOMES[outcome]}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        log = pitch_view(
            spark, sf, ["row_id", "game_date", "game_id", "pitcher_id", *picked.values()]
        )
        games = asof.prev_games(log, "pitcher_id", "pitcher", picked, ks=[k])
        return asof.game_features_to_pitches(log, games, "pitcher_id").select("row_id", column)

    QUERIES[f"{name}_{column}"] = run


for _id, (_k, _outcome) in PREV.items():
    _prev(_id, _k, _outcome)


@query("w1_w19_asof_features")
def _features(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(
        spark,
        sf,
        [*ORDER, "pitcher_id", "batter_id", "pitch_type_group", *asof.PITCHER_OUTCOMES.values()],
    )
    names = [c for c in schema.TEST.names if c.startswith("asof_")]
    return asof.asof_features(log).select("row_id", *names)


@query("w20_pitch_no")
def _pitch_no(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", "game_id", "pitch_no"])
    return asof.pitch_no(log, name="pitch_seq").select("row_id", "game_id", "pitch_seq")


@query("w21_pitch_of_pa")
def _pitch_of_pa(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(
        spark, sf, ["row_id", "game_id", "pitch_no", "inning", "top_bottom", "batter_id"]
    )
    return asof.pitch_of_pa(log).select("row_id", "pa_no", "pitch_of_pa")


@query("x6_count_outcome")
def _count_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """An appearance is a half here: synthetic batters seldom see two pitches in a row."""
    log = pitch_view(spark, sf, ["row_id", "game_id", "pitch_no", "top_bottom", "balls_before", "strikes_before"])
    return asof.count_outcome(log, turn=["top_bottom"]).select("row_id", "count_outcome")


@query("w_null_keys")
def _null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """As-of columns where every seventh part of the pitchers is unknown."""
    log = pitch_view(spark, sf, [*ORDER, "pitcher_id", LABEL])
    log = log.withColumn("pitcher_id", F.when(F.col("pitcher_id") % 7 != 0, F.col("pitcher_id")))
    out = asof.asof_rates(log, "pitcher_id", "pitcher", {"success": LABEL}, limit=GROUP_ROWS)
    return out.select("row_id", "asof_pitcher_n", "asof_pitcher_success_rate")


@query("w22_rolling")
def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, [*ORDER, "pitcher_id", "rel_speed", LABEL])
    frames = {
        "last20_n": F.count(LABEL),
        "last20_success": F.sum(LABEL),
        "last20_max_speed": F.max("rel_speed"),
        "last20_avg_speed": F.avg("rel_speed"),
    }
    return asof.rolling(log, "pitcher_id", 20, frames).select(
        "row_id",
        "last20_n",
        "last20_success",
        "last20_max_speed",
        F.round(F.col("last20_avg_speed") + NUDGE, 6).alias("last20_avg_speed"),
    )


@query("w23_expanding_by_period")
def _expanding(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["season", "game_month", "pitcher_team_id", LABEL])
    return asof.expanding_by_period(
        log, ["pitcher_team_id"], ["season", "game_month"], {"n": F.lit(1), "k": F.col(LABEL)}
    )


@query("w24_game_seq")
def _game_seq(spark: SparkSession, sf: str) -> DataFrame:
    return asof.game_seq(
        pitch_view(spark, sf, ["pitcher_id", "game_date", "game_id"]), "pitcher_id"
    )


# --- projections -------------------------------------------------------------------

_projection("p1_run_total", ["run_top_before", "run_bot_before"],
            lambda: {"run_total_before": state.run_total()})
_projection("p2_score_diff_home", ["run_top_before", "run_bot_before"],
            lambda: {"score_diff_home": state.score_diff_home()})
_projection("p3_score_diff_pitcher_team", ["run_top_before", "run_bot_before", "top_bottom"],
            lambda: {"score_diff_pitcher_team": state.score_diff_pitcher_team()})
_projection("p4_num_runners_on", state.RUNNERS, lambda: {"num_runners_on": state.num_runners_on()})
_projection("p5_encode_base_state", state.RUNNERS, lambda: {"base_state": state.base_state()})
_projection("p7_game_dayofweek", ["game_date"],
            lambda: {"game_dayofweek": scalars.game_dayofweek("game_date")})
_projection("p8_season_month", ["game_date"], lambda: scalars.season_month("game_date"))
_projection("p10_count_state", ["balls_before", "strikes_before", "outs_before"],
            lambda: {"count_state": state.count_state()})
_projection("p15_clip_probability", ["rel_speed"],
            lambda: {"p": scalars.clip_probability((F.col("rel_speed") - 20000.0) / 50000.0)})
_projection("p16_platoon", ["pitcher_hand", "batter_hand"], lambda: {"platoon": state.platoon()})
_projection("p17_speed_loss", ["rel_speed", "zone_speed"],
            lambda: {"speed_loss": F.round(scalars.speed_loss(), 4)})


@query("p6_decode_base_state")
def _decode(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", *state.RUNNERS])
    coded = log.select("row_id", state.base_state().alias("base_state"))
    return coded.withColumns(state.decode_base_state())


@query("p9_pitch_group")
def _pitch_group(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    names = part.select(F.col("p_type").alias("pitch_name")).distinct().unionByName(
        part.select(F.col("p_brand").alias("pitch_name")).distinct()
    )
    name = F.col("pitch_name")
    group = (
        F.when(name.isin("ECONOMY", "SMALL"), "fastball")
        .when(name.isin("MEDIUM", "PROMO") | name.startswith("Brand#2"), "breaking")
        .when((name == "LARGE") | name.startswith("Brand#1"), "offspeed")
    )
    mapping = names.withColumn("pitch_group", group).filter(F.col("pitch_group").isNotNull())
    log = pitch_view(spark, sf, ["row_id", "tagged_pitch_type", "auto_pitch_type"])
    return pitch_group(log, mapping).select("row_id", "pitch_type_group")


@query("p11_safe_rate")
def _safe_rate(spark: SparkSession, sf: str) -> DataFrame:
    games = pitch_view(spark, sf, ["game_id", "is_ball", LABEL]).groupBy("game_id").agg(
        F.sum(F.col(LABEL) * F.col("is_ball")).alias("k"), F.sum("is_ball").alias("n")
    )
    return games.select("game_id", scalars.safe_rate("k", "n").alias("rate"))


def _batter_asof(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, [*ORDER, "batter_id", LABEL])
    return asof.asof_rates(log, "batter_id", "batter", {"success": LABEL}, limit=GROUP_ROWS)


@query("p12_smooth_rate")
def _smooth(spark: SparkSession, sf: str) -> DataFrame:
    smoothed = scalars.smooth_rate(
        "asof_batter_n", "asof_batter_success_rate", F.lit(0.3), 100.0
    )
    return _batter_asof(spark, sf).select("row_id", F.round(smoothed, 9).alias("smoothed"))


@query("p14_missing_flags")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    flags = scalars.missing_flags(["asof_batter_success_rate"])
    return _batter_asof(spark, sf).withColumns(flags).select("row_id", *flags)


# --- filters, sorts, sets ----------------------------------------------------------


@query("f1_seasons")
def _seasons(spark: SparkSession, sf: str) -> DataFrame:
    return filters.seasons(pitch_view(spark, sf, ["row_id", "season"]), 1996, 1999)


@query("f2_before")
def _before(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", "season", "pitcher_id"])
    return filters.before(log, TEST_SEASON)


@query("f3_cold_start")
def _cold(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.cold_start(_batter_asof(spark, sf), "asof_batter_n")
    return rows.select("row_id", "batter_id", "asof_batter_success_rate")


@query("f4_allowed_features")
def _allowed(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", *STATE, "pitch_type_group", "rel_speed", LABEL])
    return filters.allowed_features(log)


@query("t1_chronological")
def _chronological(spark: SparkSession, sf: str) -> DataFrame:
    # The position shows the order in a comparison that ignores the order of rows.
    # Games are summed within dates, dates within the calendar: no window is longer.
    levels = [ORDER[:1], ORDER[1:2], ORDER[2:]]
    numbered = ordered.number_rows(pitch_view(spark, sf, ORDER), [], levels, "position")
    return asof.chronological(numbered.select(*ORDER, "position"))


@query("t2_format_sample")
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return model.format_sample(pitch_view(spark, sf, ["row_id", "season", "inning"]))


def _split(spark: SparkSession, sf: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Train seasons with the label, test season without it."""
    rows = pitch_view(spark, sf, ["row_id", "season", *columns, LABEL])
    train, test = scoring.season_split(rows, TEST_SEASON)
    return train, test.drop(LABEL)


@query("u1_stack_rows")
def _stack(spark: SparkSession, sf: str) -> DataFrame:
    both = joins.stack_rows(*_split(spark, sf, "run_top_before", "run_bot_before"))
    return both.select("row_id", "season", LABEL, state.run_total().alias("run_total_before"))


@query("u2_id_difference")
def _difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = pitch_view(spark, sf, ["row_id", "season"])
    return joins.id_difference(rows, filters.before(rows, 1999))


@query("u3_id_overlap")
def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = pitch_view(spark, sf, ["row_id", "season"])
    return joins.id_overlap(filters.before(rows, 2000), filters.seasons(rows, 1998, TEST_SEASON))


# --- joins -------------------------------------------------------------------------


def _submission_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Predictions lacking the last season against ids lacking the first one."""
    rows = pitch_view(spark, sf, ["row_id", "season", LABEL])
    pred = filters.before(rows, TEST_SEASON).select("row_id", F.col(LABEL).cast("double").alias(LABEL))
    return pred, filters.seasons(rows, 1996, TEST_SEASON).select("row_id")


@query("j1_fill_template")
def _fill(spark: SparkSession, sf: str) -> DataFrame:
    pred, template = _submission_pair(spark, sf)
    return joins.fill_template(template, pred)


@query("j2_id_mismatch")
def _mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return joins.id_mismatch(*_submission_pair(spark, sf))


@query("j3_join_history_lagged")
def _lagged(spark: SparkSession, sf: str) -> DataFrame:
    period = ["season", "game_month"]
    log = pitch_view(spark, sf, ["row_id", *period, "pitcher_id", LABEL])
    fitted = asof.fit_history(
        log, "pitcher_id", period, {"hist_n": F.lit(1), "hist_k": F.col(LABEL)}
    )
    rows = log.select("row_id", *period, "pitcher_id")
    return asof.join_history_lagged(rows, fitted, "pitcher_id", period).select(
        "row_id", "hist_n", "hist_k"
    )


def _with_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the test season with rates of all earlier ones."""
    keys = ["pitcher_id", "pitcher_team_id"]
    log = pitch_view(spark, sf, ["row_id", "season", *keys, LABEL])
    history, rows = scoring.season_split(log, TEST_SEASON)
    priors = {k: aggregates.rates(history, k, {"success": LABEL}) for k in keys}
    return joins.join_priors(rows.drop(LABEL), priors)


@query("j4_join_priors")
def _priors(spark: SparkSession, sf: str) -> DataFrame:
    return _with_priors(spark, sf).select("row_id", "prior_pitcher_id", "prior_pitcher_team_id")


@query("p13_fallback")
def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", "season", "batter_id", "batter_team_id", LABEL])
    history, rows = scoring.season_split(log, TEST_SEASON)
    priors = {
        k: aggregates.rates(history, k, {"success": LABEL}) for k in ("batter_id", "batter_team_id")
    }
    rows = joins.join_priors(rows.drop(LABEL), priors)
    league = aggregates.base_rate(history).select("base_rate").scalar()
    return rows.select(
        "row_id", scalars.fallback("prior_batter_id", "prior_batter_team_id", league).alias("rate")
    )


@query("j5_asof_join")
def _asof_join(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'click'").select(
        "event_id", "user_id", "ts", "value", F.col("event_id").alias("click_id")
    )
    return asof.asof_join(left, right, "user_id", "ts", ["click_id", "value"], "event_id")


@query("j6_id_coverage")
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["season", "batter_id"])
    rows = filters.seasons(log, TEST_SEASON, TEST_SEASON)
    return joins.id_coverage(rows, filters.before(log, TEST_SEASON), "batter_id", "batter_id")


@query("j7_game_features_to_pitches")
def _game_features(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", "game_date", "game_id", "pitcher_id", LABEL])
    games = asof.per_game(log, "pitcher_id", {"success": LABEL})
    return asof.game_features_to_pitches(log, games, "pitcher_id").select(
        "row_id", "n", "success_k"
    )


CONTEXT = [
    "inning", "top_bottom", "balls_before", "strikes_before", "outs_before",
    "pitcher_hand", "batter_hand",
]


@query("j8_join_context")
def _context(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", "season", *CONTEXT, LABEL])
    ctx = joins.fit_context(filters.before(log, TEST_SEASON), CONTEXT, LABEL, "context_rate")
    rows = filters.seasons(log, TEST_SEASON, TEST_SEASON).drop(LABEL)
    return joins.join_context(rows, ctx, CONTEXT).select(
        "row_id", "context_n", F.round("context_rate", 9).alias("context_rate")
    )


# --- aggregates --------------------------------------------------------------------


@query("a1_pitcher_rates")
def _pitcher_rates(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["pitcher_id", *asof.PITCHER_OUTCOMES.values()])
    return aggregates.rates(log, "pitcher_id", asof.PITCHER_OUTCOMES)


@query("a2_batter_rates")
def _batter_rates(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["batter_id", *asof.BATTER_OUTCOMES.values()])
    return aggregates.rates(log, "batter_id", asof.BATTER_OUTCOMES)


@query("a3_per_game")
def _per_game(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["pitcher_id", "game_date", "game_id", LABEL, "is_middle"])
    return asof.per_game(log, "pitcher_id", asof.BATTER_OUTCOMES)


@query("a4_pitch_mix")
def _mix(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.pitch_mix(
        pitch_view(spark, sf, ["pitcher_id", "pitch_type_group"]), "pitcher_id"
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits, nudged off exact halves: engines add doubles in different orders."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 6) for c in columns})


SPEEDS = ["rel_speed", "zone_speed"]


@query("a5_pitcher_profile")
def _pitcher_profile(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["pitcher_id", *SPEEDS])
    out = aggregates.pitcher_profile(log, "pitcher_id", SPEEDS)
    return _rounded(out, "mean", "stddev", "q10", "q50", "q90")


@query("a6_pitch_type_profile")
def _type_profile(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["pitch_type_group", *SPEEDS])
    out = aggregates.pitch_type_profile(log, SPEEDS)
    return _rounded(out, "mean", "stddev", "q10", "q50", "q90")


@query("a5_quantile_sketches")
def _sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sketches merged over earlier seasons: counts, and whether ranks are within the bound."""
    log = pitch_view(spark, sf, ["season", "game_month", "pitcher_id", *SPEEDS])
    kept = sketches.monthly_sketches(log, ["pitcher_id"], SPEEDS)
    found = sketches.quantiles_before(kept, ["pitcher_id"], TEST_SEASON)
    past = filters.before(log, TEST_SEASON)
    errors = sketches.rank_errors(past, settle(found), ["pitcher_id"], SPEEDS)
    within = [(F.col(f"{q}_error") <= RANK_ERROR).alias(f"{q}_within") for q in ("q10", "q50", "q90")]
    return errors.select("pitcher_id", "column", "n", *within)


@query("a7_arsenal")
def _arsenal(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["pitcher_id", "pitch_type_group", *SPEEDS])
    out = aggregates.arsenal(log, "pitcher_id", {"rel_speed": "speed", "zone_speed": "plate"})
    averages = [c for c in out.columns if c.endswith(("_speed", "_plate"))]
    return _rounded(out, *averages)


@query("a8_rate_hierarchy")
def _hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.rate_hierarchy(
        pitch_view(spark, sf, ["season", "pitcher_team_id", "pitcher_id", LABEL])
    )


@query("a9_monthly_rates")
def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["pitcher_id", "batter_id", "pitcher_team_id"]
    return aggregates.monthly_rates(
        pitch_view(spark, sf, ["season", "game_month", *keys, LABEL]), keys
    )


@query("a10_frequency_encode")
def _frequency(spark: SparkSession, sf: str) -> DataFrame:
    train = filters.before(pitch_view(spark, sf, ["season", "batter_id"]), TEST_SEASON)
    return aggregates.frequency_encode(train, "batter_id")


@query("a11_histogram")
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    train = filters.before(pitch_view(spark, sf, ["season", "rel_speed"]), TEST_SEASON)
    return aggregates.histogram(train, "rel_speed", 1000.0, 2500.0, 30)


@query("a11_quantiles")
def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    train = filters.before(pitch_view(spark, sf, ["season", *SPEEDS]), TEST_SEASON)
    return _rounded(aggregates.distribution_quantiles(train, SPEEDS), "q25", "q50", "q75")


@query("a12_target_encode")
def _target(spark: SparkSession, sf: str) -> DataFrame:
    rows = pitch_view(spark, sf, ["row_id", "season", "pitcher_id", LABEL])
    train = filters.before(rows, TEST_SEASON)
    fitted = aggregates.fit_target_encoding(train, "pitcher_id")
    out = aggregates.apply_target_encoding(rows.drop(LABEL), fitted, "pitcher_id", 100.0)
    return out.select("row_id", F.round("te_pitcher_id", 9).alias("te_pitcher_id"))


@query("a13_base_rate")
def _base_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = pitch_view(spark, sf, ["season", LABEL])
    return _rounded9(aggregates.base_rate(filters.before(rows, TEST_SEASON)), "base_rate")


def _rounded9(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


# --- checks ------------------------------------------------------------------------


@query("q3_row_count")
def _row_count(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_row_count(pitch_view(spark, sf, ["row_id"]), schema.TRAIN_ROWS)


@query("q4_unique")
def _unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = pitch_view(spark, sf, ["row_id", "game_id", "pitch_no"])
    return checks.check_unique(rows, "row_id").unionByName(
        checks.check_unique(rows, ["game_id", "pitch_no"])
    )


# One rule more than the documented ones, so that the report is not all zeros.
Q5_RULES = {**schema.TRAIN_DOMAINS, "balls_before": "balls_before <= 2"}


@query("q5_domains")
def _domains(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["game_dayofweek", "game_month", *STATE, LABEL])
    return checks.check_domains(state.with_game_state(log), Q5_RULES)


@query("q5_rate_domains")
def _rate_domains(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(
        spark, sf,
        [*ORDER, "pitcher_id", "batter_id", "pitch_type_group", *asof.PITCHER_OUTCOMES.values()],
    )
    return checks.check_domains(asof.asof_features(log), schema.RATE_DOMAINS)


@query("q5_tracking_domains")
def _tracking_domains(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_domains(flows.tracking_table(pitch_view(spark, sf)), schema.TRACKMAN_DOMAINS)


@query("q6_null_profile")
def _nulls(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(
        spark, sf, [*ORDER, "batter_id", "tagged_pitch_type", *asof.BATTER_OUTCOMES.values()]
    )
    out = asof.asof_rates(log, "batter_id", "batter", asof.BATTER_OUTCOMES, limit=GROUP_ROWS)
    columns = ["asof_batter_success_rate", "asof_batter_middle_rate", "tagged_pitch_type"]
    cold = (F.col("asof_batter_n") == 0).cast("int")
    return checks.null_profile(out, columns, cold)


# Derived columns that are wrong on purpose where other columns say so.
Q7_WRONG = {
    "run_total_before": "run_top_before + run_bot_before + case when inning = 9 then 1 else 0 end",
    "score_diff_home": "run_top_before - run_bot_before",
    "score_diff_pitcher_team": "run_bot_before - run_top_before",
    "num_runners_on": "balls_before",
    "base_state": "case when outs_before = 2 then '___' when runner_on_1b = 1 then '1__' else '__3' end",
}


@query("q7_game_state")
def _game_state(spark: SparkSession, sf: str) -> DataFrame:
    log = state.with_game_state(pitch_view(spark, sf, STATE))
    return checks.check_game_state(log.withColumns({c: F.expr(e) for c, e in Q7_WRONG.items()}))


@query("q8_asof")
def _check_asof(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, [*ORDER, "pitcher_id", "pitch_type_group", LABEL, "is_middle"])
    picked = {"success": LABEL, "middle": "is_middle"}
    return checks.check_asof(asof.asof_rates(log, "pitcher_id", "pitcher", picked, asof.MIX, limit=GROUP_ROWS))


@query("q9_validate_submission")
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    return checks.validate_submission(*_submission_pair(spark, sf))


@query("q11_cutoff")
def _cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_cutoff(pitch_view(spark, sf, ["season"]), TEST_SEASON)


# --- scoring -----------------------------------------------------------------------


@query("m1_constant_baseline")
def _constant(spark: SparkSession, sf: str) -> DataFrame:
    _, test = _split(spark, sf)
    return scoring.constant_baseline(test)


@query("m2_base_rate_baseline")
def _base_rate_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded9(scoring.base_rate_baseline(*_split(spark, sf)), LABEL)


@query("m6_season_split")
def _season_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = pitch_view(spark, sf, ["row_id", "season"])
    fit, valid = scoring.season_split(rows, 2000)
    return fit.withColumn("part", F.lit("fit")).unionByName(valid.withColumn("part", F.lit("valid")))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """The pitcher's earlier success rate as a score, one half without history."""
    log = pitch_view(spark, sf, SCORED)
    out = asof.asof_rates(log, "pitcher_id", "pitcher", {"success": LABEL}, limit=GROUP_ROWS)
    score = scalars.fallback("asof_pitcher_success_rate", F.lit(0.5))
    return out.select("row_id", "season", score.alias("score"), LABEL)


@query("m7_metrics")
def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded9(scoring.metrics(_scored(spark, sf)), "log_loss", "brier", "auc")


@query("m8_reliability")
def _reliability(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded9(scoring.reliability(_scored(spark, sf)), "predicted", "observed")


MODEL_NUMBERS = ["inning", "balls_before", "strikes_before", "outs_before"]
MODEL_RATES = ["asof_pitcher_success_rate", "asof_batter_success_rate"]
MODEL_CATEGORIES = ["top_bottom", "pitcher_hand", "batter_hand", "game_type"]


def _model_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    log = pitch_view(
        spark,
        sf,
        [*ORDER, "season", "pitcher_id", "batter_id", *MODEL_NUMBERS, *MODEL_CATEGORIES, LABEL],
    )
    pitchers, batters = ordered.busy(log, ["pitcher_id", "batter_id"])
    out = asof.asof_rates(log, "pitcher_id", "pitcher", {"success": LABEL}, few=[pitchers])
    out = asof.asof_rates(out, "batter_id", "batter", {"success": LABEL}, source=log, few=[batters])
    # Train and test season read the same feature table.
    return scoring.season_split(settle(out), TEST_SEASON)


@query("m3_feature_pipeline")
def _feature_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    log = pitch_view(spark, sf, ["row_id", "season", *MODEL_NUMBERS, *MODEL_CATEGORIES, LABEL])
    train, test = scoring.season_split(log, TEST_SEASON)
    fitted = model.fit_features(train, MODEL_NUMBERS, (), MODEL_CATEGORIES)
    features = fitted.transform(test).select("row_id", vector_to_array("features").alias("f"))
    return features.select("row_id", F.posexplode("f").alias("slot", "value"))


def _fitted(spark: SparkSession, sf: str):
    train, test = _model_rows(spark, sf)
    return model.fit(train, MODEL_NUMBERS, MODEL_RATES, MODEL_CATEGORIES), test


@query("m4_m5_fit_score")
def _fit_score(spark: SparkSession, sf: str) -> DataFrame:
    """One category alone: at the optimum a row scores the mean label of its group."""
    log = pitch_view(spark, sf, ["row_id", "season", "game_type", LABEL])
    train, test = scoring.season_split(log, TEST_SEASON)
    out = model.score(model.fit(train, [], categories=["game_type"]), test)
    return out.select("row_id", F.round("score", 3).alias("score"))


@query("m4_trees")
def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees on one feature of two values approach the rates of the two groups."""
    log = pitch_view(spark, sf, ["row_id", "season", "strikes_before", LABEL])
    log = log.withColumn("full", (F.col("strikes_before") == 2).cast("int"))
    train, test = scoring.season_split(log, TEST_SEASON)
    out = model.score(model.fit(train, ["full"], kind="trees", max_iter=40), test)
    return out.select("row_id", F.round("score", 2).alias("score"))


@query("m4_m5_optimum")
def _optimum(spark: SparkSession, sf: str) -> DataFrame:
    """All features: over train, errors times a feature sum to nothing for every slot."""
    train, _ = _model_rows(spark, sf)
    fitted = model.fit(train, MODEL_NUMBERS, MODEL_RATES, MODEL_CATEGORIES)
    out = fitted.transform(model.prepare(train, MODEL_RATES))
    error = vector_to_array("probability")[1] - F.col(LABEL)
    rows = out.select(error.alias("e"), F.posexplode(vector_to_array("features")).alias("slot", "x"))
    mean = F.avg(F.col("e") * F.col("x"))
    return rows.groupBy("slot").agg(F.count("*").alias("n"), (F.round(mean, 3) + F.lit(0.0)).alias("error"))


@query("m9_recalibrate")
def _recalibrate(spark: SparkSession, sf: str) -> DataFrame:
    valid, test = scoring.season_split(_scored(spark, sf), TEST_SEASON)
    fitted = scoring.fit_recalibration(valid)
    return _rounded9(scoring.apply_recalibration(fitted, test), "score").select("row_id", "score")


@query("q12_row_independence")
def _independence(spark: SparkSession, sf: str) -> DataFrame:
    fitted, test = _fitted(spark, sf)
    return checks.check_row_independence(
        lambda rows: model.score(fitted, rows, MODEL_RATES), test, F.col("top_bottom") == "T"
    )


# --- files -------------------------------------------------------------------------


def _fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("s1_read_train")
def _read_train(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark)
    files.write_csv(flows.training_table(pitch_view(spark, sf)), path, "gzip")
    return files.read_train(spark, path)


@query("s2_read_test")
def _read_test(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark)
    table = flows.training_table(pitch_view(spark, sf))
    files.write_csv(table.filter(F.col("season") == TEST_SEASON).drop(LABEL), path, "gzip")
    return files.read_test(spark, path)


@query("s3_read_trackman")
def _read_trackman(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark)
    files.write_csv(flows.tracking_table(pitch_view(spark, sf, last="orders")), path, "gzip")
    return files.read_trackman(spark, path)


@query("flow2_history_features")
def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking summaries of strictly earlier seasons on every row of the log."""
    log = pitch_view(spark, sf)
    rows = log.select("row_id", "season", "pitcher_id")
    out = flows.history_features(
        rows, flows.tracking_table(log), TEST_SEASON, "pitcher_id", "pitcher_trackman_id"
    )
    return _rounded(out, "hist_speed").select("row_id", "hist_n", "hist_speed")


@query("flow3_submission")
def _flow(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, predict, validate, write and read back; the category's mean label is the optimum."""
    log = pitch_view(spark, sf, ["row_id", "season", "game_type", LABEL])
    train, test = scoring.season_split(log, TEST_SEASON)
    pred = flows.predict(model.fit(train, [], categories=["game_type"]), test, ())
    path = _fresh(spark)
    files.write_submission(pred.withColumn(LABEL, F.round(LABEL, 3)), test, path)
    return files.read_template(spark, path)


@query("s4_s5_submission")
def _submission(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark)
    train, test = _split(spark, sf)
    pred = _rounded9(scoring.base_rate_baseline(train, test), LABEL)
    files.write_submission(pred, test, path)
    return files.read_template(spark, path)


# --- streams -----------------------------------------------------------------------

QUERIES.update(streams.QUERIES)
