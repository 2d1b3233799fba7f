"""A pitch log over the star-schema tables, as one SQL text for Spark and DuckDB.

One line item is one pitch, an order a game, a supplier a pitcher, a part a batter. Only
the tables behind the wanted columns are joined.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mapping of pitch columns to driver columns.
EXPRESSIONS = {
    "row_id": "concat('P_', l_orderkey, '_', l_linenumber, '_', l_suppkey, '_', l_partkey, '_',"
    " cast(l_shipdate as date))",
    "season": "cast(year(o_orderdate) as int)",
    "game_month": "cast(month(o_orderdate) as int)",
    "game_dayofweek": "{weekday}",
    "game_date": "cast(o_orderdate as date)",
    "game_id": "l_orderkey",
    "pitch_no": "l_linenumber",
    "inning": "1 + cast(l_quantity as int) % 9",
    "top_bottom": "case when l_linestatus = 'F' then 'T' else 'B' end",
    "game_type": "o_orderpriority",
    "balls_before": "cast(l_quantity as int) % 4",
    "strikes_before": "cast(l_quantity as int) % 3",
    "outs_before": "l_linenumber % 3",
    "run_top_before": "cast(round(l_discount * 100) as int) % 10",
    "run_bot_before": "cast(round(l_tax * 100) as int)",
    "runner_on_1b": "cast(l_quantity as int) % 2",
    "runner_on_2b": "cast(floor(l_quantity / 2) as int) % 2",
    "runner_on_3b": "cast(floor(l_quantity / 4) as int) % 2",
    "pitcher_id": "l_suppkey",
    "batter_id": "l_partkey",
    "pitcher_team_id": "s_nationkey",
    "batter_team_id": "c_nationkey",
    "pitcher_hand": "case when l_suppkey % 4 = 0 then 'L' else 'R' end",
    "batter_hand": "case when l_partkey % 3 = 0 then 'L' else 'R' end",
    "tagged_pitch_type": "case when p_size % 5 = 0 then null else p_type end",
    "auto_pitch_type": "p_brand",
    "pitch_type_group": "case cast(l_quantity as int) % 4 when 0 then 'fastball'"
    " when 1 then 'breaking' when 2 then 'offspeed' else 'other' end",
    "rel_speed": "l_extendedprice",
    "zone_speed": "p_retailprice",
    "control_success": "case when l_returnflag = 'R' then 1 else 0 end",
    "is_reverse": "case when l_returnflag = 'A' then 1 else 0 end",
    "is_middle": "case when cast(l_quantity as int) % 5 = 0 then 1 else 0 end",
    "is_ball": "case when cast(round(l_tax * 100) as int) % 3 = 0 then 1 else 0 end",
    "is_strike": "case when cast(round(l_discount * 100) as int) % 2 = 0 then 1 else 0 end",
}

# Table, the column prefix that calls for it, and how it joins.
_JOINS = (
    ("orders", "o_", "l_orderkey = o_orderkey"),
    ("supplier", "s_", "l_suppkey = s_suppkey"),
    ("customer", "c_", "o_custkey = c_custkey"),
    ("part", "p_", "l_partkey = p_partkey"),
)
# A broadcast table is whole in the memory of every task, and files that compress well say little of its rows.
JOIN_ROWS = 500_000

_WEEKDAY = {
    "spark": "weekday(o_orderdate)",
    "duckdb": "cast(isodow(o_orderdate) - 1 as int)",
}


def _tables(text: str) -> list[str]:
    """Tables whose columns the text names."""
    words = set(re.findall(r"[a-z_]+", text))
    needed = {t for t, prefix, _ in _JOINS if any(w.startswith(prefix) for w in words)}
    if "customer" in needed:
        needed.add("orders")
    return ["lineitem", *[t for t, _, _ in _JOINS if t in needed]]


def view_sql(
    columns: Sequence[str], dialect: str = "duckdb", names: dict[str, str] | None = None, joined: Sequence[str] = (), last: str | None = None
) -> str:
    """``select`` text of the pitch log; ``names`` replaces table names, ``joined`` are part of another one already, ``last`` is joined last."""
    names = names or {}
    exprs = {c: EXPRESSIONS[c].format(weekday=_WEEKDAY[dialect]) for c in columns}
    listed = ", ".join(f"{e} as {c}" for c, e in exprs.items())
    tables = _tables(" ".join(exprs.values()))
    joins = "".join(f" join {names.get(t, t)} on {on}" for t, _, on in sorted(_JOINS, key=lambda j: j[0] == last) if t in tables and t not in joined)
    return f"select {listed} from {names.get('lineitem', 'lineitem')}{joins}"


def _large(table: DataFrame) -> bool:
    """True above ``JOIN_ROWS`` rows: Parquet's footers hold their number."""
    return table.count() > JOIN_ROWS


def pitch_view(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, last: str | None = None) -> DataFrame:
    """The pitch log as a DataFrame; only files of the tables it needs are opened.

    The rows of a large table joined ``last`` lie by its key: a window over that needs no further shuffle.
    """
    columns = list(columns or EXPRESSIONS)
    tables = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(" ".join(EXPRESSIONS[c] for c in columns))
    }
    large = [t for t, table in tables.items() if t != "lineitem" and _large(table)]
    customer = tables.pop("customer", None)
    if customer is not None:
        # An order has one customer: joined here, the many line items are not shuffled for it.
        customer = customer.hint("merge") if "customer" in large else customer
        tables["orders"] = tables["orders"].join(customer, F.col("o_custkey") == F.col("c_custkey"))
    tables |= {t: tables[t].hint("merge") for t in large if t in tables}
    sql = view_sql(columns, "spark", {t: f"{{{t}}}" for t in tables}, ["customer"], last)
    return spark.sql(sql, **tables)
