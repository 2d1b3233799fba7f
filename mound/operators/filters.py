"""Row and column restrictions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mound.sources.schema import BANNED


def seasons(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Seasons lo to hi, both included; prunes directories of a season layout."""
    return df.filter(F.col("season").between(lo, hi))


def before(history: DataFrame, cutoff: int | datetime.date, column: str | None = None) -> DataFrame:
    """Rows strictly earlier than a season or a date."""
    if column is None:
        column = "game_date" if isinstance(cutoff, datetime.date) else "season"
    return history.filter(F.col(column) < F.lit(cutoff))


def cold_start(df: DataFrame, n: str = "asof_pitcher_n") -> DataFrame:
    """Rows of players without any earlier pitch."""
    return df.filter(F.col(n) == 0)


def allowed_features(df: DataFrame) -> DataFrame:
    """Feature columns: no id, no label, nothing settled with the current pitch."""
    return df.drop("row_id", *BANNED)
