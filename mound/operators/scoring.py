"""Baselines, splits, metrics and calibration of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.functions.scalars import clip_probability, safe_rate
from mound.operators import isotonic
from mound.operators.aggregates import base_rate
from mound.operators.attach import attach, settle
from mound.operators.ordered import GROUP_ROWS, running, split_if_large
from mound.sources.schema import LABEL

SCORE = "score"
# Resolution of a calibration: steps of the score.
CALIBRATION_STEPS = 10_000


def constant_baseline(test: DataFrame, p: float = 0.5) -> DataFrame:
    return test.select("row_id", F.lit(float(p)).alias(LABEL))


def base_rate_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """The train mean for every row, read once as a scalar subquery."""
    rate = base_rate(train).select("base_rate").scalar()
    return test.select("row_id", rate.alias(LABEL))


def season_split(train: DataFrame, valid_season: int) -> tuple[DataFrame, DataFrame]:
    """Rows before a season to fit on, rows of that season to validate on."""
    return train.filter(F.col("season") < valid_season), train.filter(
        F.col("season") == valid_season
    )


def score_counts(scored: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Positives and negatives per distinct score, settled: all metrics need no more."""
    return settle(
        scored.groupBy(F.col(score).cast("double").alias("p")).agg(
            F.count("*").alias("n"),
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def auc(counts: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Area under the curve, exact, from ``score_counts``.

    Above ``limit`` distinct scores their running counts are taken in range blocks, so
    scores crowded into a narrow range still spread over tasks.
    """
    known = counts.filter(F.col("p").isNotNull())
    known, levels = split_if_large(known, [], ["p"], limit)
    ranked = running(known, [], levels, {"below": F.col("neg")})
    wins = F.col("pos").cast("double") * (F.col("below") + F.col("neg") / F.lit(2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(safe_rate(F.sum(wins), pairs).alias("auc"))


def losses(counts: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Row count, log-loss and Brier score from ``score_counts``."""
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    safe = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    known = F.sum(F.when(p.isNotNull(), pos + neg))
    log_loss = -F.sum(pos * F.ln(safe) + neg * F.ln(1.0 - safe))
    brier = F.sum(pos * (1.0 - p) * (1.0 - p) + neg * p * p)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        safe_rate(log_loss, known).alias("log_loss"),
        safe_rate(brier, known).alias("brier"),
    )


def metrics(scored: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Row count, log-loss, Brier score and AUC as one row; reads the rows once."""
    counts = score_counts(scored, score, label)
    area = auc(counts).scalar()
    return losses(counts).withColumn("auc", area)


def reliability(
    scored: DataFrame, bins: int = 10, score: str = SCORE, label: str = LABEL
) -> DataFrame:
    """Mean prediction against observed share per bin; held-out train only, NaN scores left out."""
    step = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    place = F.when(F.col(score).isNotNull(), step)
    scored = scored.filter(~F.isnan(F.coalesce(score, F.lit(0.0))))
    return scored.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def _step(score: str, steps: int) -> Column:
    return F.least(F.greatest(F.floor(F.col(score).cast("double") * steps), F.lit(0)), F.lit(steps)).cast("long")


def fit_recalibration(
    scored_valid: DataFrame, score: str = SCORE, label: str = LABEL, steps: int = CALIBRATION_STEPS
) -> DataFrame:
    """Monotone correction learned on held-out train rows: a settled table of a row per step.

    Every row with a score and a label of 0 or 1 counts, at the mean score of its step: there are
    ``steps`` of them between 0 and 1. Fitted values are isotonic means over the steps. A row says what holds
    around its step: the nearest seen steps below and above, and its own where it was seen.
    """
    y = F.col(label).cast("long")
    known = scored_valid.filter(F.col(score).isNotNull() & ~F.isnan(score) & y.isin(0, 1))
    points = known.groupBy(_step(score, steps).alias("at")).agg(
        F.count("*").alias("n"), F.sum(y).alias("k"), F.avg(F.col(score).cast("double")).alias("p")
    )
    fitted = isotonic.fit(points, steps).select("at", F.struct("p", F.col("fitted").alias("y")).alias("own"))
    every = scored_valid.sparkSession.range(steps + 1).select(F.col("id").alias("step"))
    table = every.join(fitted, F.col("step") == F.col("at"), "left").drop("at")
    order = Window.orderBy("step")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(1, Window.unboundedFollowing)
    return settle(
        table.withColumns(
            {"below": F.last("own", ignorenulls=True).over(below), "above": F.first("own", ignorenulls=True).over(above)}
        )
    )


def apply_recalibration(fitted: DataFrame, rows: DataFrame, score: str = SCORE) -> DataFrame:
    """Replace the score by its corrected value, row by row.

    Between seen steps the value goes in a straight line, beyond the last ones it stays. A null or NaN score gives null;
    a correction fitted to no row leaves scores as they are.
    """
    x = F.col(score).cast("double")
    steps = fitted.agg(F.max("step")).first()[0]
    known = F.when(x.isNotNull() & ~F.isnan(x), _step(score, steps)).alias("step")
    out = attach(rows.withColumn("step", known), fitted, ["step"], settled=True)
    low = F.when(F.col("own.p") <= x, F.col("own")).otherwise(F.col("below"))
    high = F.when(F.col("own.p") >= x, F.col("own")).otherwise(F.col("above"))
    way = F.try_divide(x - low["p"], high["p"] - low["p"])
    value = F.when(low["p"] < high["p"], low["y"] + (high["y"] - low["y"]) * way)
    value = F.coalesce(value, low["y"], high["y"], F.when(F.col("step").isNotNull(), x))
    return out.withColumn(score, F.when(F.col("step").isNotNull(), clip_probability(value))).drop("step", "own", "below", "above")
