"""Quantile sketches kept per player and month, and merged for any cut-off.

A sketch holds some hundreds of values whatever it has seen, and sketches of disjoint rows merge into one of
all of them. So history is read once; a new month adds its own sketches, and summaries before any season
are merges of a few kilobytes per player and month, not a pass over the log. Quantiles come with a
bound on the rank error (about 1.33 % of the rows for a size of 200, less for larger ones) and are exact for players with
fewer values than the sketch holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mound.operators.attach import settle

SIZE = 400


def _stacked(columns: Sequence[str]) -> Column:
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    return F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]))


def monthly_sketches(
    history: DataFrame, key: Sequence[str], columns: Sequence[str], period: Sequence[str] = ("season", "game_month"), size: int = SIZE
) -> DataFrame:
    """``sketch`` and ``n`` per key, period and ``column``, settled; nulls and NaN are no values.

    Tasks sketch their own rows and Spark merges the sketches, so a busy player is a few kilobytes a task.
    """
    rows = history.select(*key, *period, _stacked(columns).alias("__v")).select(*key, *period, "__v.*")
    rows = rows.filter(F.col("value").isNotNull())
    return settle(rows.groupBy(*key, *period, "column").agg(F.kll_sketch_agg_double("value", size).alias("sketch"), F.count("*").alias("n")))


def merge(sketches: DataFrame, key: Sequence[str], size: int = SIZE) -> DataFrame:
    """One sketch per key and column from those of any periods."""
    return sketches.groupBy(*key, "column").agg(F.kll_merge_agg_double("sketch", size).alias("sketch"), F.sum("n").alias("n"))


def quantiles_before(sketches: DataFrame, key: Sequence[str], season: int, probs: Sequence[float] = (0.1, 0.5, 0.9), size: int = SIZE) -> DataFrame:
    """``n`` and quantiles per key and column over strictly earlier seasons."""
    merged = merge(sketches.filter(F.col("season") < season), key, size)
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{round(p * 100):02d}") for p in probs]
    return merged.select(*key, "column", "n", *found)


def rank_errors(values: DataFrame, estimates: DataFrame, key: Sequence[str], columns: Sequence[str], probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """How far, as a share of the rows, the wanted rank lies outside the ranks that each estimate has among the values."""
    rows = values.select(*key, _stacked(columns).alias("__v")).select(*key, "__v.*").filter(F.col("value").isNotNull())
    names = [f"q{round(p * 100):02d}" for p in probs]
    counted = rows.join(estimates.drop("n"), [*key, "column"]).groupBy(*key, "column").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("value") < F.col(q)).alias(f"__below_{q}") for q in names],
        *[F.count_if(F.col("value") <= F.col(q)).alias(f"__upto_{q}") for q in names],
    )
    errors = [
        F.greatest(F.lit(0.0), F.col(f"__below_{q}") / F.col("n") - p, p - F.col(f"__upto_{q}") / F.col("n")).alias(f"{q}_error")
        for p, q in zip(probs, names)
    ]
    return counted.select(*key, "column", "n", *errors)
