"""Data contract as Spark jobs: every check returns ``(check, column, violations)``."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mound.functions import state
from mound.operators.attach import settle
from mound.operators.ordered import neighbour
from mound.sources.schema import BANNED, LABEL

REPORT = "check string, column string, violations bigint"
ORDINAL_BLOCK = 65_536


def _report(spark: SparkSession, rows: Sequence[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(list(rows), REPORT)


def _lines(counted: DataFrame, lines: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One report line per (check, column, counter) of a one-row or split frame."""
    counters = {counter for _, _, counter in lines}
    kept = [c for c in counted.columns if c not in counters]
    structs = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            F.col(counter).cast("long").alias("violations"),
        )
        for check, column, counter in lines
    ]
    return counted.select(*kept, F.explode(F.array(*structs)).alias("__line")).select(
        *kept, "__line.*"
    )


def _count_each(df: DataFrame, bad: dict[tuple[str, str], Column]) -> DataFrame:
    """Count every (check, column) condition in one pass over the data."""
    names = {pair: f"c{i}" for i, pair in enumerate(bad)}
    counted = df.agg(*[F.count_if(c).alias(names[pair]) for pair, c in bad.items()])
    return _lines(counted, [(*pair, name) for pair, name in names.items()])


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Column count, names, order and types; reads no data."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in expected.fields]
    types = dict(have)
    rows = [("column_count", "", int(len(have) != len(want)))]
    for i, (name, dtype) in enumerate(want):
        wrong = name not in types or types[name] != dtype or i >= len(have) or have[i][0] != name
        rows.append(("schema", name, int(wrong)))
    rows += [("schema", name, 1) for name, _ in have if name not in dict(want)]
    return _report(df.sparkSession, rows)


def check_feature_parity(train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    """Train without the label and test have the same columns."""
    odd = (set(train.columns) - {label}) ^ set(test.columns)
    odd |= {label} - set(train.columns)
    rows = [("feature_parity", c, 1) for c in sorted(odd)] or [("feature_parity", "", 0)]
    return _report(train.sparkSession, rows)


def check_row_count(df: DataFrame, expected: int) -> DataFrame:
    """Distance from the expected number of rows."""
    return df.agg(
        F.lit("row_count").alias("check"),
        F.lit("").alias("column"),
        F.abs(F.count("*") - F.lit(expected)).alias("violations"),
    )


def check_unique(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Number of key values that occur more than once."""
    keys = [key] if isinstance(key, str) else list(key)
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return repeated.agg(
        F.lit("unique").alias("check"),
        F.lit(",".join(keys)).alias("column"),
        F.count_if(F.col("n") > 1).alias("violations"),
    )


def check_domains(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows outside the domain of each column; rules are SQL conditions by column.

    A rule whose column is absent is a violation of its own, ``absent``.
    """
    lines = {("domain", c): ~F.expr(rule) for c, rule in rules.items() if c in df.columns}
    absent = [("absent", c, 1) for c in rules if c not in df.columns]
    counted = _count_each(df, lines)
    return counted.unionByName(_report(df.sparkSession, absent)) if absent else counted


def null_profile(df: DataFrame, columns: Sequence[str], by: Column | None = None) -> DataFrame:
    """Missing values per column, optionally split, e.g. by cold start."""
    missing = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    counted = df.agg(*missing) if by is None else df.groupBy(by.alias("split")).agg(*missing)
    return _lines(counted, [("null", c, c) for c in columns])


def check_game_state(df: DataFrame) -> DataFrame:
    """Derived columns that disagree with the columns they come from."""
    derived = {
        "run_total_before": state.run_total(),
        "score_diff_home": state.score_diff_home(),
        "score_diff_pitcher_team": state.score_diff_pitcher_team(),
        "num_runners_on": state.num_runners_on(),
        "base_state": state.base_state(),
    }
    bad = {("game_state", c): ~F.col(c).eqNullSafe(expr) for c, expr in derived.items()}
    return _count_each(df, bad)


# The count that each rate is a share of.
_RATE_COUNT = {
    "asof_pitcher_success_rate": "asof_pitcher_n",
    "asof_pitcher_reverse_rate": "asof_pitcher_n",
    "asof_pitcher_middle_rate": "asof_pitcher_n",
    "asof_pitcher_ball_rate": "asof_pitcher_n",
    "asof_pitcher_strike_rate": "asof_pitcher_n",
    "asof_batter_success_rate": "asof_batter_n",
    "asof_batter_middle_rate": "asof_batter_n",
    "asof_pitcher_fastball_rate": "asof_pitcher_pitchmix_n",
    "asof_pitcher_breaking_rate": "asof_pitcher_pitchmix_n",
    "asof_pitcher_offspeed_rate": "asof_pitcher_pitchmix_n",
}


def check_asof(train: DataFrame, label: str = LABEL, block: int = ORDINAL_BLOCK) -> DataFrame:
    """Consistency of the as-of columns of a labelled table.

    ``rate_null``: a rate missing although its count is positive. ``mix_sum``: mix rates
    above 1. Along each pitcher's ``asof_pitcher_n``: ``ordinal_repeat`` equal neighbours,
    ``success_drop`` a success count that falls, ``label_step`` a step of one pitch whose
    success count does not grow by the label of the pitch thrown.
    """
    bad = {
        ("rate_null", c): F.col(c).isNull() & (F.col(n) > 0)
        for c, n in _RATE_COUNT.items()
        if c in train.columns
    }
    mix = [c for c, n in _RATE_COUNT.items() if n == "asof_pitcher_pitchmix_n"]
    if all(c in train.columns for c in mix):
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in mix), F.lit(0.0))
        bad[("mix_sum", "asof_pitcher_pitchmix_n")] = total > 1 + 1e-9
    # Per-row faults ride along as flags, so all counts come from one pass.
    n, rate = F.col("asof_pitcher_n"), F.col("asof_pitcher_success_rate")
    steps = train.select(
        "pitcher_id",
        "row_id",
        n.alias("n"),
        F.coalesce(F.round(n * rate), F.lit(0.0)).cast("long").alias("k"),
        F.col(label).cast("int").alias("label"),
        F.floor(n / F.lit(block)).alias("__block"),
        *[c.alias(f"bad{i}") for i, c in enumerate(bad.values())],
    )
    # Read twice: for the edges of blocks and for the rows.
    steps = neighbour(
        settle(steps), ["pitcher_id"], [["__block"], ["n", "row_id"]], ["n", "k"], "__next", step=1
    )
    dn, dk = F.col("__next.n") - F.col("n"), F.col("__next.k") - F.col("k")
    along = {
        "ordinal_repeat": dn == 0,
        "success_drop": dk < 0,
        "label_step": (dn == 1) & (dk != F.col("label")),
    }
    flags = {pair: F.col(f"bad{i}") for i, pair in enumerate(bad)}
    return _count_each(steps, flags | {(name, "asof_pitcher_n"): c for name, c in along.items()})


def validate_submission(pred: DataFrame, template: DataFrame, label: str = LABEL) -> DataFrame:
    """Ids equal, none repeated, no nulls, values in [0, 1], same number of rows.

    Predictions are counted per id before the join, so repeats do not travel.
    """
    value = F.col(label).cast("double")
    have = pred.groupBy("row_id").agg(
        F.count("*").alias("p"),
        F.count_if(value.isNull()).alias("empty"),
        F.count_if(~value.between(0.0, 1.0)).alias("outside"),
    )
    want = template.groupBy("row_id").agg(F.count("*").alias("t"))
    both = have.join(want, "row_id", "full_outer")
    counted = both.agg(
        F.count_if(F.col("p").isNull()).alias("missing_id"),
        F.count_if(F.col("t").isNull()).alias("extra_id"),
        F.count_if(F.col("p") > 1).alias("duplicate_id"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("null_value"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("out_of_range"),
        F.abs(
            F.coalesce(F.sum("p"), F.lit(0)) - F.coalesce(F.sum("t"), F.lit(0))
        ).alias("row_count"),
    )
    lines = [
        ("missing_id", "row_id"),
        ("extra_id", "row_id"),
        ("duplicate_id", "row_id"),
        ("null_value", label),
        ("out_of_range", label),
        ("row_count", ""),
    ]
    return _lines(counted, [(check, column, check) for check, column in lines])


def forbid_columns(features: DataFrame, banned: Sequence[str] = BANNED) -> DataFrame:
    """Banned columns in a feature frame; reads no data."""
    found = [c for c in features.columns if c in set(banned)]
    rows = [("forbidden", c, 1) for c in found] or [("forbidden", "", 0)]
    return _report(features.sparkSession, rows)


def check_cutoff(history: DataFrame, season_before: int) -> DataFrame:
    """History rows of the cutoff season or later."""
    return _count_each(history, {("cutoff", "season"): F.col("season") >= season_before})


# Plan nodes that make a row depend on others.
MIXING = ("Window", "WindowGroupLimit", "Aggregate", "Distinct", "Deduplicate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Sample", "Expand", "Union")


def check_scoring_plan(scored: DataFrame) -> DataFrame:
    """Nodes in the plan of a scored frame that let a row depend on other rows; reads no data.

    Rows may be joined to settled tables of history, whose plan is a scan. A window, aggregate, sort, limit, sample or
    union anywhere in the plan is reported by its name.
    """
    spark, name = scored.sparkSession, f"scored_{uuid.uuid4().hex}"
    scored.createOrReplaceTempView(name)
    try:
        text = spark.sql(f"explain extended select * from {name}").first()[0]
    finally:
        spark.catalog.dropTempView(name)
    optimized = text.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    nodes = Counter(re.findall(r"^[\s:+|-]*([A-Z]\w+)", optimized, re.MULTILINE))
    rows = [("scoring_plan", n, nodes[n]) for n in MIXING if nodes[n]] or [("scoring_plan", "", 0)]
    return _report(spark, rows)


def check_row_independence(
    score_fn: Callable[[DataFrame], DataFrame], test: DataFrame, part: Column
) -> DataFrame:
    """Rows that score differently when the file is cut in two by ``part``.

    The file scored whole is compared with its two parts scored apart, all rows of it:
    signed counts of equal rows must cancel. ``rows_compared`` says how many rows there were.
    """
    inside = F.coalesce(part, F.lit(False))
    whole = score_fn(test).withColumn("__sign", F.lit(1))
    apart = score_fn(test.filter(inside)).unionByName(score_fn(test.filter(~inside)))
    both = whole.unionByName(apart.withColumn("__sign", F.lit(-1)))
    rows = [c for c in whole.columns if c != "__sign"]
    sums = both.groupBy(*rows).agg(
        F.sum("__sign").alias("__left"), F.count_if(F.col("__sign") == 1).alias("__whole")
    )
    counted = sums.agg(
        F.coalesce(F.sum(F.abs("__left")), F.lit(0)).alias("changed"),
        F.coalesce(F.sum("__whole"), F.lit(0)).alias("compared"),
    )
    lines = [("row_independence", "", "changed"), ("rows_compared", "", "compared")]
    return _lines(counted, lines)
