"""Joins and set operations on ids, priors and context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mound.functions.scalars import safe_rate
from mound.operators.attach import attach
from mound.sources.schema import LABEL


def fill_template(template: DataFrame, pred: DataFrame) -> DataFrame:
    """Predictions on the template's ids; null where there is none."""
    return template.select("row_id").join(pred.select("row_id", LABEL), "row_id", "left")


def id_mismatch(pred: DataFrame, template: DataFrame, key: str = "row_id") -> DataFrame:
    """Ids on one side only, each once, labelled ``missing`` or ``extra``."""
    have, want = pred.select(key).distinct(), template.select(key).distinct()
    missing = want.join(have, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = have.join(want, key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def join_priors(
    rows: DataFrame, priors: dict[str, DataFrame], value: str = "success_rate"
) -> DataFrame:
    """Attach one prior table per key column as ``prior_<key>``."""
    for key, table in priors.items():
        rows = attach(rows, table.select(key, F.col(value).alias(f"prior_{key}")), [key])
    return rows


def id_coverage(rows: DataFrame, history: DataFrame, a: str, b: str) -> DataFrame:
    """How many distinct ids of ``rows`` the history knows."""
    ids = rows.select(F.col(a).alias("id")).distinct()
    known = history.select(F.col(b).alias("id")).distinct().withColumn("found", F.lit(True))
    table = ids.join(known, "id", "left").agg(
        F.count("*").alias("ids"), F.count("found").alias("found")
    )
    return table.withColumns(
        {"missing": F.col("ids") - F.col("found"), "share": safe_rate("found", "ids")}
    )


def fit_context(
    history: DataFrame, context: Sequence[str], value: str, name: str = "context_mean"
) -> DataFrame:
    """Mean of a column per combination of shared context columns."""
    return history.groupBy(*context).agg(
        F.count("*").alias("context_n"), F.avg(value).alias(name)
    )


def join_context(rows: DataFrame, ctx: DataFrame, context: Sequence[str]) -> DataFrame:
    """Attach context averages on the columns both logs have."""
    return attach(rows, ctx, context)


def stack_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both tables under one schema, for row-wise derivations only."""
    return train.unionByName(test, allowMissingColumns=True)


def id_difference(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Ids of ``a`` without those of ``b``, counting repeats."""
    return a.select(key).exceptAll(b.select(key))


def id_overlap(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Ids in both; distinct first, so a repeated id costs one row in the shuffle."""
    return a.select(key).distinct().intersect(b.select(key).distinct())
