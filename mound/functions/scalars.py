"""Dates, rates and probabilities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def game_dayofweek(date: str | Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(date)


def season_month(date: str | Column) -> dict[str, Column]:
    return {"season": F.year(date), "game_month": F.month(date)}


def safe_rate(k: str | Column, n: str | Column) -> Column:
    """``k / n``, null where n is 0."""
    return F.try_divide(k, n)


def smooth_rate(n: str | Column, rate: str | Column, prior: str | Column, m: float) -> Column:
    """Pull a rate toward a prior worth ``m`` pitches; null where both weigh nothing."""
    n, rate, prior = (F.col(x) if isinstance(x, str) else x for x in (n, rate, prior))
    weight = F.lit(float(m))
    seen = F.coalesce(n * rate, F.lit(0.0))
    return F.try_divide(seen + weight * prior, F.coalesce(n, F.lit(0)) + weight)


def fallback(*columns: str | Column) -> Column:
    """First rate that is there: player, team, league."""
    return F.coalesce(*columns)


def missing_flags(columns: Iterable[str]) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}


def clip_probability(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p.isNull() | F.isnan(p), p).otherwise(
        F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    )


def speed_loss() -> Column:
    """Release speed minus speed near the plate; history rows only."""
    return F.col("rel_speed") - F.col("zone_speed")
