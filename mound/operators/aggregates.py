"""Summaries of logs and of the labelled table. None of them belongs on test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.functions.scalars import safe_rate, smooth_rate
from mound.operators.asof import fit_history, join_history_lagged
from mound.operators.attach import attach, settle
from mound.operators.ordered import quantiles
from mound.sources.schema import LABEL, MEASUREMENTS, PITCH_GROUPS


def _counts(outcomes: dict[str, str]) -> list[Column]:
    return [F.count("*").alias("n")] + [
        F.sum(F.col(c).cast("int")).alias(f"{name}_k") for name, c in outcomes.items()
    ]


def _rates(df: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    return df.withColumns({f"{name}_rate": safe_rate(f"{name}_k", "n") for name in outcomes}).drop(
        *[f"{name}_k" for name in outcomes]
    )


def rates(log: DataFrame, key: str | Sequence[str], outcomes: dict[str, str]) -> DataFrame:
    """Pitch count and outcome rates per pitcher, batter or any key."""
    keys = [key] if isinstance(key, str) else list(key)
    return _rates(log.groupBy(*keys).agg(*_counts(outcomes)), outcomes)


def pitch_mix(log: DataFrame, key: str) -> DataFrame:
    """Pitches of known type and the share of each group; ``other`` is in the count."""
    group = F.col("pitch_type_group")
    named = PITCH_GROUPS[:3]
    table = log.groupBy(key).agg(
        F.count(group).alias("pitchmix_n"), *[F.count_if(group == g).alias(f"{g}_k") for g in named]
    )
    return table.select(
        key, "pitchmix_n", *[safe_rate(f"{g}_k", "pitchmix_n").alias(f"{g}_rate") for g in named]
    )


def profile(
    log: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] = MEASUREMENTS,
    probs: Sequence[float] = (0.1, 0.5, 0.9),
    exact: bool = True,
) -> DataFrame:
    """Count, mean, spread and quantiles of measurements per key, one row per column.

    ``exact=False`` uses Spark's mergeable quantile summary instead of counting values.
    """
    key = list(key)
    names = [f"q{round(p * 100):02d}" for p in probs]

    def stats(c: str) -> Column:
        parts = [
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("stddev"),
        ]
        if not exact:
            parts += [F.percentile_approx(c, p).alias(q) for p, q in zip(probs, names)]
        return F.struct(*parts).alias(c)

    wide = log.groupBy(*key).agg(*[stats(c) for c in columns])
    long = wide.select(*key, F.explode(F.array(*columns)).alias("__s")).select(*key, "__s.*")
    if not exact:
        return long
    exactly = quantiles(log, key, columns, probs)
    match = F.lit(True)
    left, right = long.alias("l"), exactly.alias("r")
    for c in (*key, "column"):
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, match, "left").select("l.*", *[f"r.{q}" for q in names])


def pitcher_profile(
    history: DataFrame,
    pitcher: str = "pitcher_trackman_id",
    columns: Sequence[str] = MEASUREMENTS,
    **options,
) -> DataFrame:
    """Measurement summary per pitcher."""
    return profile(history, [pitcher], columns, **options)


def pitch_type_profile(
    history: DataFrame, columns: Sequence[str] = MEASUREMENTS, **options
) -> DataFrame:
    """Measurement summary per pitch group."""
    return profile(history, ["pitch_type_group"], columns, **options)


def arsenal(
    history: DataFrame,
    pitcher: str = "pitcher_trackman_id",
    averages: dict[str, str] | None = None,
) -> DataFrame:
    """One row per pitcher: share and average measurements of each pitch group.

    ``averages`` maps measurement column to output suffix.
    """
    averages = averages or {"rel_speed": "speed", "spin_rate": "spin"}
    group = F.col("pitch_type_group")
    table = history.groupBy(pitcher).agg(
        F.count(group).alias("n"),
        *[F.count_if(group == g).alias(f"{g}_k") for g in PITCH_GROUPS],
        *[
            F.avg(F.when(group == g, F.col(c))).alias(f"{g}_{suffix}")
            for g in PITCH_GROUPS
            for c, suffix in averages.items()
        ],
    )
    shares = {f"{g}_share": safe_rate(f"{g}_k", "n") for g in PITCH_GROUPS}
    return table.withColumns(shares).drop(*[f"{g}_k" for g in PITCH_GROUPS])


def rate_hierarchy(
    log: DataFrame,
    levels: Sequence[str] = ("season", "pitcher_team_id", "pitcher_id"),
    label: str = LABEL,
) -> DataFrame:
    """Label rate of every level of a hierarchy up to the grand total, in one pass.

    ``level`` counts the columns summed away: 0 is the finest.
    """
    depth = F.bit_count(F.grouping_id(*levels)).cast("int").alias("level")
    return _rates(
        log.rollup(*levels).agg(depth, *_counts({"success": label})), {"success": label}
    )


def monthly_rates(
    log: DataFrame,
    keys: Sequence[str] = ("pitcher_id", "batter_id", "pitcher_team_id"),
    label: str = LABEL,
) -> DataFrame:
    """Label rate by month for several keys at once; ``key`` names the one a row is for.

    Only (key, month) groups reach the shuffle: each row is counted once per key before it.
    """
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("id")) for k in keys]
    )
    stacked = log.select("season", "game_month", label, F.explode(pairs).alias("__p"))
    return rates(
        stacked.select("season", "game_month", label, "__p.*"),
        ["key", "id", "season", "game_month"],
        {"success": label},
    )


def frequency_encode(train: DataFrame, column: str) -> DataFrame:
    """Count and share of each value of a train column."""
    counts = settle(train.groupBy(column).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("frequency", F.col("n") / total)


def histogram(train: DataFrame, column: str, lo: float, width: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; values outside go to the first or last bin, NaN and null to none."""
    place = F.floor((F.col(column) - F.lit(float(lo))) / F.lit(float(width)))
    place = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    return (
        train.filter(F.col(column).isNotNull() & ~F.isnan(column))
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def distribution_quantiles(
    train: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Exact quantiles over the whole table, one row per column."""
    return quantiles(train, [], columns, probs)


def base_rate(train: DataFrame, label: str = LABEL) -> DataFrame:
    return train.agg(F.count("*").alias("n"), F.avg(F.col(label)).alias("base_rate"))


def _league(seasons: DataFrame) -> DataFrame:
    """Rate of all earlier seasons, for each season up to one past the last.

    ``seasons`` has one row per season, so these windows are a handful of rows.
    """
    by_season = Window.orderBy("season")
    so_far = by_season.rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead("season").over(by_season), F.col("season") + 1)
    return settle(
        seasons.select(
            safe_rate(F.sum("k").over(so_far), F.sum("n").over(so_far)).alias("league_rate"),
            F.sequence(F.col("season") + 1, following).alias("__span"),
        ).select(F.explode("__span").alias("__for"), "league_rate")
    )


def fit_target_encoding(
    train: DataFrame, key: str, label: str = LABEL
) -> tuple[DataFrame, DataFrame]:
    """Season-cumulative label counts of the key, and the league rates to fall back on.

    Train is read once: the league's seasons are summed from the key's.
    """
    sums = {"__n": F.lit(1), "__k": F.col(label).cast("int")}
    by_key = fit_history(train, key, ["season"], sums, own=True)
    seasons = by_key.groupBy(F.col("period").alias("season")).agg(
        F.sum("own___n").alias("n"), F.sum("own___k").alias("k")
    )
    return by_key.drop("own___n", "own___k"), _league(seasons)


def apply_target_encoding(
    rows: DataFrame, fitted: tuple[DataFrame, DataFrame], key: str, m: float = 100.0
) -> DataFrame:
    """Add ``te_<key>``: the key's smoothed label rate over strictly earlier seasons."""
    by_key, league = fitted
    last = league.agg(F.max("__for")).first()[0]
    out = join_history_lagged(rows, by_key, key, ["season"])
    out = out.withColumn("__for", F.least(F.col("season"), F.lit(last)))
    out = attach(out, league, ["__for"], settled=True)
    encoded = smooth_rate(
        F.coalesce("__n", F.lit(0)), safe_rate("__k", "__n"), F.col("league_rate"), m
    )
    return out.withColumn(f"te_{key}", encoded).drop("__for", "__n", "__k", "league_rate")


def target_encode(train: DataFrame, key: str, m: float = 100.0, label: str = LABEL) -> DataFrame:
    """Encode the train rows themselves; a row never sees its own season."""
    return apply_target_encoding(train, fit_target_encoding(train, key, label), key, m)
