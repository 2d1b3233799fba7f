"""DuckDB text for the queries of the catalogue: plain windows and joins, no blocks."""

from __future__ import annotations

from collections.abc import Sequence

from mound.plans.catalog import CONTEXT, PREV, PITCHER_RATES, Q5_RULES, Q7_WRONG, STATE, TEST_SEASON
from mound.plans import streams
from mound.plans.pitch_view import view_sql
from mound.sources import schema

ORDER = ["game_date", "game_id", "pitch_no", "row_id"]
BY = ", ".join(ORDER)
BEFORE = "rows between unbounded preceding and 1 preceding"
OUTCOMES = {
    "success": "control_success",
    "reverse": "is_reverse",
    "middle": "is_middle",
    "ball": "is_ball",
    "strike": "is_strike",
}

RUN_TOTAL = "run_top_before + run_bot_before"
HOME = "run_bot_before - run_top_before"
PITCHER_SIDE = f"case when top_bottom = 'T' then {HOME} else -({HOME}) end"
RUNNERS = "runner_on_1b + runner_on_2b + runner_on_3b"
BASES = (
    "(case when runner_on_1b = 1 then '1' else '_' end) || "
    "(case when runner_on_2b = 1 then '2' else '_' end) || "
    "(case when runner_on_3b = 1 then '3' else '_' end)"
)


def _with(columns: Sequence[str], body: str, *steps: str) -> str:
    ctes = [f"p as ({view_sql(columns)})", *steps]
    return f"with {', '.join(ctes)} {body}"


def _window(key: str) -> str:
    return f"window w as (partition by {key} order by {BY} {BEFORE})"


def _share(k: str, n: str) -> str:
    return f"cast({k} as double) / nullif({n}, 0)"


def _hit(group: str) -> str:
    return f"case when pitch_type_group = '{group}' then 1 else 0 end"


def _asof_columns() -> dict[str, tuple[str, str]]:
    """As-of column to (key, expression over window w)."""
    out = {"asof_pitcher_n": ("pitcher_id", "count(*) over w")}
    for name, c in OUTCOMES.items():
        out[f"asof_pitcher_{name}_rate"] = (
            "pitcher_id", _share(f"sum({c}) over w", "count(*) over w")
        )
    out["asof_batter_n"] = ("batter_id", "count(*) over w")
    for name in ("success", "middle"):
        out[f"asof_batter_{name}_rate"] = (
            "batter_id", _share(f"sum({OUTCOMES[name]}) over w", "count(*) over w")
        )
    out["asof_pitcher_pitchmix_n"] = ("pitcher_id", "count(pitch_type_group) over w")
    for g in ("fastball", "breaking", "offspeed"):
        out[f"asof_pitcher_{g}_rate"] = (
            "pitcher_id", _share(f"sum({_hit(g)}) over w", "count(pitch_type_group) over w")
        )
    return out


ASOF = _asof_columns()
ASOF_INPUT = [*ORDER, "pitcher_id", "batter_id", "pitch_type_group", *OUTCOMES.values()]


def _asof(column: str) -> str:
    key, expr = ASOF[column]
    return _with(ASOF_INPUT, f"select row_id, {expr} as {column} from p {_window(key)}")


def _prev_cte(k: int, outcome: str) -> str:
    frame = f"rows between {k} preceding and 1 preceding"
    rate = _share(f"sum(k_{outcome}) over (w {frame})", f"sum(n) over (w {frame})")
    return f"{rate} as asof_pitcher_prev{k}_game_{outcome}_rate"


GAMES = (
    "g as (select pitcher_id, game_date, game_id, count(*) n, sum(control_success) k_success,"
    " sum(is_middle) k_middle from p group by all)"
)


def _prev_games(pairs: Sequence[tuple[int, str]]) -> str:
    columns = ", ".join(_prev_cte(k, outcome) for k, outcome in pairs)
    return (
        f"h as (select pitcher_id, game_date, game_id, {columns} from g"
        " window w as (partition by pitcher_id order by game_date, game_id))"
    )


def _prev(k: int, outcome: str) -> str:
    name = f"asof_pitcher_prev{k}_game_{outcome}_rate"
    return _with(
        ["row_id", "game_date", "game_id", "pitcher_id", "control_success", "is_middle"],
        f"select row_id, {name} from p join h using (pitcher_id, game_date, game_id)",
        GAMES,
        _prev_games([(k, outcome)]),
    )


def _all_features(columns: Sequence[str]) -> list[str]:
    """CTEs ending in ``f``: the view with all 19 as-of columns."""
    pitcher = ", ".join(f"{e} as {c}" for c, (key, e) in ASOF.items() if key == "pitcher_id")
    batter = ", ".join(f"{e} as {c}" for c, (key, e) in ASOF.items() if key == "batter_id")
    return [
        GAMES,
        _prev_games(list(PREV.values())),
        f"a as (select *, {pitcher} from p {_window('pitcher_id')})",
        f"b as (select *, {batter} from a {_window('batter_id')})",
        "f as (select * from b join h using (pitcher_id, game_date, game_id))",
    ]


def _typed(fields, expressions: dict[str, str]) -> str:
    names = {"string": "varchar", "int": "int", "bigint": "bigint", "double": "double", "date": "date"}
    return ", ".join(
        f"cast({expressions.get(f.name, f.name)} as {names[f.dataType.simpleString()]}) as {f.name}"
        for f in fields
    )


def _table(fields, where: str = "") -> str:
    expressions = {
        "run_total_before": RUN_TOTAL,
        "score_diff_home": HOME,
        "score_diff_pitcher_team": PITCHER_SIDE,
        "num_runners_on": RUNNERS,
        "base_state": BASES,
        "home_win_expectancy": "null",
        "away_win_expectancy": "null",
        "li": "null",
    }
    columns = list(dict.fromkeys([
        *ASOF_INPUT, "season", "game_month", "game_dayofweek", *STATE, "game_type",
        "pitcher_hand", "batter_hand", "pitcher_team_id", "batter_team_id",
    ]))
    return _with(columns, f"select {_typed(fields, expressions)} from f {where}", *_all_features(columns))


APPEARANCES = [
    "c as (select *, case when inning is distinct from lag(inning) over w"
    " or {extra} top_bottom is distinct from lag(top_bottom) over w then 1 else 0 end flag"
    " from p window w as (partition by game_id order by pitch_no, row_id))",
    "d as (select *, sum(flag) over (partition by game_id order by pitch_no, row_id"
    " rows unbounded preceding) pa from c)",
    "e as (select *, row_number() over (partition by game_id, pa order by pitch_no, row_id) pitch_of_pa"
    " from d)",
]


def _appearances(with_batter: bool) -> list[str]:
    extra = "batter_id is distinct from lag(batter_id) over w or" if with_batter else ""
    return [step.format(extra=extra) for step in APPEARANCES]


def _trackman() -> str:
    expressions = {
        "trackman_id": "row_id",
        "trackman_game_id": "game_id",
        "pitcher_trackman_id": "pitcher_id",
        "batter_trackman_id": "batter_id",
        "pitcher_team": "pitcher_team_id",
        "batter_team": "batter_team_id",
    }
    absent = set(schema.MEASUREMENTS) - {"rel_speed", "zone_speed"}
    expressions |= {c: "null" for c in absent}
    columns = [
        *ORDER, "season", "game_month", "game_dayofweek", "inning", "top_bottom", "balls_before",
        "strikes_before", "outs_before", "pitcher_id", "batter_id", "pitcher_hand", "batter_hand",
        "pitcher_team_id", "batter_team_id", "tagged_pitch_type", "auto_pitch_type",
        "pitch_type_group", "rel_speed", "zone_speed",
    ]
    body = f"select {_typed(schema.TRACKMAN.fields, expressions)} from e"
    return _with(columns, body, *_appearances(True))


def _line(check: str, column: str, expr: str, source: str = "p") -> str:
    return (
        f"select '{check}' as \"check\", '{column}' as \"column\","
        f" cast({expr} as bigint) as violations from {source}"
    )


def _count(condition: str) -> str:
    return f"count(*) filter (where {condition})"


def _report(columns: Sequence[str], lines: Sequence[str], *steps: str) -> str:
    return _with(columns, " union all ".join(lines), *steps)


def _select(columns: Sequence[str], body: str) -> str:
    return _with(["row_id", *columns], f"select row_id, {body} from p")


def _profile(key: str) -> str:
    lines = [
        f"select {key}, '{c}' as \"column\", count({c}) as n, round(avg({c}) + 1e-9, 6) as mean,"
        f" round(stddev_samp({c}) + 1e-9, 6) as stddev, round(quantile_cont({c}, 0.1) + 1e-9, 6) as q10,"
        f" round(quantile_cont({c}, 0.5) + 1e-9, 6) as q50, round(quantile_cont({c}, 0.9) + 1e-9, 6) as q90"
        f" from p group by {key}"
        for c in ("rel_speed", "zone_speed")
    ]
    return _with([key, "rel_speed", "zone_speed"], " union all ".join(lines))


def _arsenal() -> str:
    groups = schema.PITCH_GROUPS
    averages = ", ".join(
        f"round(avg({c}) filter (where pitch_type_group = '{g}') + 1e-9, 6) as {g}_{suffix}"
        for g in groups
        for c, suffix in (("rel_speed", "speed"), ("zone_speed", "plate"))
    )
    shares = ", ".join(
        f"{_share(f'sum({_hit(g)})', 'count(pitch_type_group)')} as {g}_share" for g in groups
    )
    return _with(
        ["pitcher_id", "pitch_type_group", "rel_speed", "zone_speed"],
        f"select pitcher_id, count(pitch_type_group) as n, {averages}, {shares} from p group by 1",
    )


def _rate_list(outcomes: Sequence[str]) -> str:
    return ", ".join(f"{_share(f'sum({OUTCOMES[o]})', 'count(*)')} as {o}_rate" for o in outcomes)


PAIR = ["row_id", "season", "control_success"]
PAIR_STEPS = (
    f"pred as (select row_id, cast(control_success as double) as control_success from p"
    f" where season < {TEST_SEASON})",
    f"template as (select row_id from p where season between 1996 and {TEST_SEASON})",
)

SCORED_COLUMNS = [*ORDER, "season", "pitcher_id", "control_success"]
SCORED = (
    "s as (select row_id, season, control_success as y, coalesce("
    f"{_share('sum(control_success) over w', 'count(*) over w')}, 0.5) as score from p "
    f"{_window('pitcher_id')})"
)

BATTER = [*ORDER, "batter_id", "control_success"]
BATTER_ASOF = (
    f"b as (select *, count(*) over w as n, {_share('sum(control_success) over w', 'count(*) over w')}"
    f" as rate from p {_window('batter_id')})"
)


def _model_features() -> str:
    onehot = [
        *[("top_bottom", v) for v in ("B", "T")],
        *[("pitcher_hand", v) for v in ("L", "R")],
        *[("batter_hand", v) for v in ("L", "R")],
        *[
            ("game_type", v)
            for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
        ],
    ]
    numbers = ["inning", "balls_before", "strikes_before", "outs_before"]
    cells = [f"cast({c} as double)" for c in numbers]
    cells += [f"case when {c} = '{v}' then 1.0::double else 0.0::double end" for c, v in onehot]
    return _with(
        ["row_id", "season", *numbers, "top_bottom", "pitcher_hand", "batter_hand", "game_type"],
        "select row_id, unnest(range(len(f)))::int as slot, unnest(f) as value from v",
        f"v as (select row_id, [{', '.join(cells)}] as f from p where season = {TEST_SEASON})",
    )


def _asof_check() -> str:
    mix = {g: f"asof_pitcher_{g}_rate" for g in ("fastball", "breaking", "offspeed")}
    rates = {f"asof_pitcher_{o}_rate": "n" for o in ("success", "middle")} | {
        c: "m" for c in mix.values()
    }
    rate_text = ", ".join(
        f"{ASOF[c][1]} as {c}" for c in rates
    )
    steps = (
        f"a as (select row_id, pitcher_id, control_success as y, count(*) over w as n,"
        f" count(pitch_type_group) over w as m, {rate_text} from p {_window('pitcher_id')})",
        "k as (select *, cast(coalesce(round(n * asof_pitcher_success_rate), 0) as bigint) as k from a)",
        "s as (select y, n, k, lead(n) over v as n2, lead(k) over v as k2 from k"
        " window v as (partition by pitcher_id order by n, row_id))",
    )
    total = " + ".join(f"coalesce({c}, 0)" for c in mix.values())
    lines = [_line("rate_null", c, _count(f"{c} is null and {n} > 0"), "a") for c, n in rates.items()]
    lines += [
        _line("mix_sum", "asof_pitcher_pitchmix_n", _count(f"{total} > 1 + 1e-9"), "a"),
        _line("ordinal_repeat", "asof_pitcher_n", _count("n2 = n"), "s"),
        _line("success_drop", "asof_pitcher_n", _count("k2 < k"), "s"),
        _line("label_step", "asof_pitcher_n", _count("n2 = n + 1 and k2 - k <> y"), "s"),
    ]
    return _report([*ORDER, "pitcher_id", "pitch_type_group", "control_success", "is_middle"], lines, *steps)


def _game_state_check() -> str:
    right = {
        "run_total_before": RUN_TOTAL,
        "score_diff_home": HOME,
        "score_diff_pitcher_team": PITCHER_SIDE,
        "num_runners_on": RUNNERS,
        "base_state": BASES,
    }
    lines = [
        _line("game_state", c, _count(f"({Q7_WRONG[c]}) is distinct from ({e})")) for c, e in right.items()
    ]
    return _report(STATE, lines)


def _domain_check() -> str:
    derived = f"q as (select *, {BASES} as base_state from p)"
    have = {"game_dayofweek", "game_month", *STATE, "base_state", "control_success"}
    lines = [
        _line("domain", c, _count(f"not ({rule})"), "q") for c, rule in Q5_RULES.items() if c in have
    ]
    lines += [_line("absent", c, "1", "(select 1)") for c in Q5_RULES if c not in have]
    return _report(["game_dayofweek", "game_month", *STATE, "control_success"], lines, derived)


def _histogram() -> str:
    place = "floor((rel_speed - 1000) / 2500)"
    return _with(
        ["season", "rel_speed"],
        f"select cast(greatest(least({place}, 29), 0) as int) as bin, count(*) as n from p"
        f" where season < {TEST_SEASON} group by 1",
    )


def build() -> dict[str, str]:
    out = {f"w1_asof_pitcher_n": _asof("asof_pitcher_n")}
    for i, outcome in PITCHER_RATES.items():
        out[f"{i}_asof_pitcher_{outcome}_rate"] = _asof(f"asof_pitcher_{outcome}_rate")
    for i, (k, outcome) in PREV.items():
        out[f"{i}_asof_pitcher_prev{k}_game_{outcome}_rate"] = _prev(k, outcome)
    for i, column in (
        ("w13", "asof_batter_n"),
        ("w14", "asof_batter_success_rate"),
        ("w15", "asof_batter_middle_rate"),
        ("w16", "asof_pitcher_pitchmix_n"),
        ("w17", "asof_pitcher_fastball_rate"),
        ("w18", "asof_pitcher_breaking_rate"),
        ("w19", "asof_pitcher_offspeed_rate"),
    ):
        out[f"{i}_{column}"] = _asof(column)
    asof_names = [c for c in schema.TEST.names if c.startswith("asof_")]
    out["w1_w19_asof_features"] = _with(
        ASOF_INPUT, f"select row_id, {', '.join(asof_names)} from f", *_all_features(ASOF_INPUT)
    )
    out["w20_pitch_no"] = _with(
        ["row_id", "game_id", "pitch_no"],
        "select row_id, game_id, row_number() over (partition by game_id"
        " order by pitch_no, row_id) as pitch_seq from p",
    )
    out["w21_pitch_of_pa"] = _with(
        ["row_id", "game_id", "pitch_no", "inning", "top_bottom", "batter_id"],
        "select row_id, cast(pa as bigint) as pa_no, pitch_of_pa from e",
        *_appearances(True),
    )
    out["x6_count_outcome"] = _with(
        ["row_id", "game_id", "pitch_no", "top_bottom", "balls_before", "strikes_before"],
        "select row_id, case when b = 1 and s = 0 then 'ball' when b = 0 and s = 1 then 'strike'"
        " when b = 0 and s = 0 then 'same' end as count_outcome from (select row_id,"
        " case when lead(top_bottom) over w = top_bottom then lead(balls_before) over w - balls_before end as b,"
        " case when lead(top_bottom) over w = top_bottom then lead(strikes_before) over w - strikes_before end as s"
        " from p window w as (partition by game_id order by pitch_no, row_id)) q",
    )
    out["w_null_keys"] = _with(
        [*ORDER, "pitcher_id", "control_success"],
        "select row_id, case when known then count(*) over w end as asof_pitcher_n,"
        f" case when known then {_share('sum(control_success) over w', 'count(*) over w')} end"
        " as asof_pitcher_success_rate from (select *, pitcher_id % 7 <> 0 as known from p)"
        f" window w as (partition by known, pitcher_id order by {BY} {BEFORE})",
    )
    last20 = f"(partition by pitcher_id order by {BY} rows between 20 preceding and 1 preceding)"
    out["w22_rolling"] = _with(
        [*ORDER, "pitcher_id", "rel_speed", "control_success"],
        f"select row_id, count(control_success) over {last20} as last20_n,"
        f" cast(sum(control_success) over {last20} as bigint) as last20_success,"
        f" max(rel_speed) over {last20} as last20_max_speed,"
        f" round(avg(rel_speed) over {last20} + 1e-9, 6) as last20_avg_speed from p",
    )
    out["w23_expanding_by_period"] = _with(
        ["season", "game_month", "pitcher_team_id", "control_success"],
        "select pitcher_team_id, season, game_month, n, k,"
        f" cast(coalesce(sum(n) over w, 0) as bigint) as before_n,"
        f" cast(coalesce(sum(k) over w, 0) as bigint) as before_k from g"
        f" window w as (partition by pitcher_team_id order by season, game_month {BEFORE})",
        "g as (select pitcher_team_id, season, game_month, count(*) as n,"
        " cast(sum(control_success) as bigint) as k from p group by all)",
    )
    out["w24_game_seq"] = _with(
        ["pitcher_id", "game_date", "game_id"],
        "select pitcher_id, game_date, game_id, count(*) as n, max(seq) as game_seq"
        " from (select *, dense_rank() over (partition by pitcher_id order by game_date, game_id)"
        " as seq from p) group by all",
    )

    out["p1_run_total"] = _select(STATE, f"{RUN_TOTAL} as run_total_before")
    out["p2_score_diff_home"] = _select(STATE, f"{HOME} as score_diff_home")
    out["p3_score_diff_pitcher_team"] = _select(STATE, f"{PITCHER_SIDE} as score_diff_pitcher_team")
    out["p4_num_runners_on"] = _select(STATE, f"{RUNNERS} as num_runners_on")
    out["p5_encode_base_state"] = _select(STATE, f"{BASES} as base_state")
    out["p6_decode_base_state"] = _select(
        STATE, f"{BASES} as base_state, runner_on_1b, runner_on_2b, runner_on_3b"
    )
    out["p7_game_dayofweek"] = _select(
        ["game_date"], "cast(isodow(game_date) - 1 as int) as game_dayofweek"
    )
    out["p8_season_month"] = _select(
        ["game_date"], "cast(year(game_date) as int) as season, cast(month(game_date) as int) as game_month"
    )

    def named(c: str) -> str:
        return (
            f"case when {c} in ('ECONOMY', 'SMALL') then 'fastball'"
            f" when {c} in ('MEDIUM', 'PROMO') or starts_with({c}, 'Brand#2') then 'breaking'"
            f" when {c} = 'LARGE' or starts_with({c}, 'Brand#1') then 'offspeed' end"
        )

    out["p9_pitch_group"] = _select(
        ["tagged_pitch_type", "auto_pitch_type"],
        f"coalesce({named('tagged_pitch_type')}, {named('auto_pitch_type')}, 'other')"
        " as pitch_type_group",
    )
    out["p10_count_state"] = _select(
        STATE, "concat_ws('-', balls_before, strikes_before, outs_before) as count_state"
    )
    out["p11_safe_rate"] = _with(
        ["game_id", "is_ball", "control_success"],
        f"select game_id, {_share('sum(control_success * is_ball)', 'sum(is_ball)')} as rate"
        " from p group by 1",
    )
    out["p12_smooth_rate"] = _with(
        BATTER,
        "select row_id, round((coalesce(n * rate, 0) + 100 * 0.3::double) / (n + 100), 9) as smoothed"
        " from b",
        BATTER_ASOF,
    )
    out["p13_fallback"] = _with(
        ["row_id", "season", "batter_id", "batter_team_id", "control_success"],
        "select row_id, coalesce(x.rate, t.rate, (select avg(control_success) from h)) as rate from p"
        f" left join x using (batter_id) left join t using (batter_team_id) where season = {TEST_SEASON}",
        f"h as (select * from p where season < {TEST_SEASON})",
        f"x as (select batter_id, {_share('sum(control_success)', 'count(*)')} as rate from h group by 1)",
        f"t as (select batter_team_id, {_share('sum(control_success)', 'count(*)')} as rate from h group by 1)",
    )
    out["p14_missing_flags"] = _with(
        BATTER,
        "select row_id, case when rate is null then 1 else 0 end as asof_batter_success_rate_missing"
        " from b",
        BATTER_ASOF,
    )
    out["p15_clip_probability"] = _select(
        ["rel_speed"], "least(greatest((rel_speed - 20000.0::double) / 50000.0::double, 0), 1) as p"
    )
    out["p16_platoon"] = _select(
        ["pitcher_hand", "batter_hand"],
        "case when pitcher_hand = batter_hand then 'same' else 'opposite' end as platoon",
    )
    out["p17_speed_loss"] = _select(
        ["rel_speed", "zone_speed"], "round(rel_speed - zone_speed, 4) as speed_loss"
    )

    out["f1_seasons"] = _with(
        ["row_id", "season"], "select * from p where season between 1996 and 1999"
    )
    out["f2_before"] = _with(
        ["row_id", "season", "pitcher_id"], f"select * from p where season < {TEST_SEASON}"
    )
    out["f3_cold_start"] = _with(
        BATTER,
        "select row_id, batter_id, rate as asof_batter_success_rate from b where n = 0",
        BATTER_ASOF,
    )
    out["f4_allowed_features"] = _with(STATE, "select * from p")
    out["t1_chronological"] = _with(
        ORDER, f"select *, row_number() over (order by {BY}) as position from p"
    )
    out["t2_format_sample"] = _with(
        ["row_id", "season", "inning"], "select * from p order by row_id limit 5"
    )
    out["u1_stack_rows"] = _with(
        ["row_id", "season", "run_top_before", "run_bot_before", "control_success"],
        f"select row_id, season, case when season < {TEST_SEASON} then control_success end"
        f" as control_success, {RUN_TOTAL} as run_total_before from p where season <= {TEST_SEASON}",
    )
    ids = ["row_id", "season"]
    out["u2_id_difference"] = _with(
        ids, "select row_id from p except all select row_id from p where season < 1999"
    )
    out["u3_id_overlap"] = _with(
        ids,
        "select row_id from p where season < 2000 intersect"
        f" select row_id from p where season between 1998 and {TEST_SEASON}",
    )

    out["j1_fill_template"] = _with(
        PAIR, "select row_id, control_success from template left join pred using (row_id)", *PAIR_STEPS
    )
    out["j2_id_mismatch"] = _with(
        PAIR,
        "select row_id, 'missing' as side from (select row_id from template except select row_id from pred)"
        " union all"
        " select row_id, 'extra' as side from (select row_id from pred except select row_id from template)",
        *PAIR_STEPS,
    )
    out["j3_join_history_lagged"] = _with(
        ["row_id", "season", "game_month", "pitcher_id", "control_success"],
        "select row_id, cast(sum(n) as bigint) as hist_n, cast(sum(k) as bigint) as hist_k"
        " from (select row_id, pitcher_id, season * 100 + game_month as period from p) r"
        " left join h on r.pitcher_id = h.pitcher_id and h.period < r.period group by row_id",
        "h as (select pitcher_id, season * 100 + game_month as period, count(*) n,"
        " sum(control_success) k from p group by all)",
    )
    prior = _share("sum(control_success)", "count(*)")
    out["j4_join_priors"] = _with(
        ["row_id", "season", "pitcher_id", "pitcher_team_id", "control_success"],
        "select row_id, a.r as prior_pitcher_id, b.r as prior_pitcher_team_id from p"
        f" left join a using (pitcher_id) left join b using (pitcher_team_id) where season = {TEST_SEASON}",
        f"a as (select pitcher_id, {prior} as r from p where season < {TEST_SEASON} group by 1)",
        f"b as (select pitcher_team_id, {prior} as r from p where season < {TEST_SEASON} group by 1)",
    )
    out["j5_asof_join"] = (
        "with l as (select event_id, user_id, ts from events where event_type = 'purchase'),"
        " r as (select event_id, user_id, ts, value from events where event_type = 'click')"
        " select l.event_id, l.user_id, l.ts, r.event_id as asof_click_id, r.value as asof_value"
        " from l asof left join r on l.user_id = r.user_id and l.ts > r.ts"
    )
    out["j6_id_coverage"] = _with(
        ["season", "batter_id"],
        "select count(*) as ids, count(f) as found, count(*) - count(f) as missing,"
        f" {_share('count(f)', 'count(*)')} as share from a left join b using (batter_id)",
        f"a as (select distinct batter_id from p where season = {TEST_SEASON})",
        f"b as (select distinct batter_id, 1 as f from p where season < {TEST_SEASON})",
    )
    out["j7_game_features_to_pitches"] = _with(
        ["row_id", "game_date", "game_id", "pitcher_id", "control_success"],
        "select row_id, count(*) over w as n, cast(sum(control_success) over w as bigint) as success_k"
        " from p window w as (partition by pitcher_id, game_date, game_id)",
    )
    context = ", ".join(CONTEXT)
    out["j8_join_context"] = _with(
        ["row_id", "season", *CONTEXT, "control_success"],
        "select row_id, context_n, context_rate from p"
        f" left join c using ({context}) where season = {TEST_SEASON}",
        f"c as (select {context}, count(*) as context_n, round(avg(control_success), 9) as context_rate"
        f" from p where season < {TEST_SEASON} group by all)",
    )

    out["a1_pitcher_rates"] = _with(
        ["pitcher_id", *OUTCOMES.values()],
        f"select pitcher_id, count(*) as n, {_rate_list(list(OUTCOMES))} from p group by 1",
    )
    out["a2_batter_rates"] = _with(
        ["batter_id", "control_success", "is_middle"],
        f"select batter_id, count(*) as n, {_rate_list(['success', 'middle'])} from p group by 1",
    )
    out["a3_per_game"] = _with(
        ["pitcher_id", "game_date", "game_id", "control_success", "is_middle"],
        "select pitcher_id, game_date, game_id, count(*) as n,"
        " cast(sum(control_success) as bigint) as success_k, cast(sum(is_middle) as bigint) as middle_k"
        " from p group by 1, 2, 3",
    )
    mix = ", ".join(
        f"{_share(f'sum({_hit(g)})', 'count(pitch_type_group)')} as {g}_rate"
        for g in ("fastball", "breaking", "offspeed")
    )
    out["a4_pitch_mix"] = _with(
        ["pitcher_id", "pitch_type_group"],
        f"select pitcher_id, count(pitch_type_group) as pitchmix_n, {mix} from p group by 1",
    )
    out["a5_pitcher_profile"] = _profile("pitcher_id")
    out["a6_pitch_type_profile"] = _profile("pitch_type_group")
    out["a5_quantile_sketches"] = _with(
        ["season", "pitcher_id", "rel_speed", "zone_speed"],
        "select pitcher_id, c as \"column\", count(*) as n, true as q10_within, true as q50_within, true as q90_within"
        " from (select pitcher_id, season, unnest(['rel_speed', 'zone_speed']) as c from p) q"
        f" where season < {TEST_SEASON} group by 1, 2",
    )
    out["a7_arsenal"] = _arsenal()
    hierarchy = ["season", "pitcher_team_id", "pitcher_id"]
    out["a8_rate_hierarchy"] = _with(
        [*hierarchy, "control_success"],
        f"select {', '.join(hierarchy)}, cast({' + '.join(f'grouping({c})' for c in hierarchy)} as int)"
        f" as level, count(*) as n, {_share('sum(control_success)', 'count(*)')} as success_rate"
        f" from p group by rollup ({', '.join(hierarchy)})",
    )
    monthly = " union all ".join(
        f"select '{k}' as key, cast({k} as varchar) as id, season, game_month, count(*) as n,"
        f" {_share('sum(control_success)', 'count(*)')} as success_rate from p group by all"
        for k in ("pitcher_id", "batter_id", "pitcher_team_id")
    )
    out["a9_monthly_rates"] = _with(
        ["season", "game_month", "pitcher_id", "batter_id", "pitcher_team_id", "control_success"], monthly
    )
    out["a10_frequency_encode"] = _with(
        ["season", "batter_id"],
        "select batter_id, n, cast(n as double) / (select sum(n) from c) as frequency from c",
        f"c as (select batter_id, count(*) as n from p where season < {TEST_SEASON} group by 1)",
    )
    out["a11_histogram"] = _histogram()
    out["a11_quantiles"] = _with(
        ["season", "rel_speed", "zone_speed"],
        " union all ".join(
            f"select '{c}' as \"column\", round(quantile_cont({c}, 0.25) + 1e-9, 6) as q25,"
            f" round(quantile_cont({c}, 0.5) + 1e-9, 6) as q50, round(quantile_cont({c}, 0.75) + 1e-9, 6) as q75"
            f" from p where season < {TEST_SEASON}"
            for c in ("rel_speed", "zone_speed")
        ),
    )
    out["a12_target_encode"] = _with(
        ["row_id", "season", "pitcher_id", "control_success"],
        "select row_id, round((coalesce(k, 0) + 100 * (lk::double / ln)) / (coalesce(n, 0) + 100), 9)"
        " as te_pitcher_id from p"
        " left join h on p.pitcher_id = h.pitcher_id and p.season = h.season"
        " left join l on p.season = l.season",
        f"t as (select * from p where season < {TEST_SEASON})",
        "y as (select distinct season from p)",
        "x as (select distinct pitcher_id, season from p)",
        "h as (select x.pitcher_id, x.season, count(*) n, sum(control_success) k from x join t"
        " on t.pitcher_id = x.pitcher_id and t.season < x.season group by all)",
        "l as (select y.season, count(*) ln, sum(control_success) lk from y join t"
        " on t.season < y.season group by all)",
    )
    out["a13_base_rate"] = _with(
        ["season", "control_success"],
        "select count(*) as n, round(avg(control_success), 9) as base_rate from p"
        f" where season < {TEST_SEASON}",
    )

    out["q3_row_count"] = _report(
        ["row_id"], [_line("row_count", "", f"abs(count(*) - {schema.TRAIN_ROWS})")]
    )
    out["q4_unique"] = _report(
        ["row_id", "game_id", "pitch_no"],
        [
            _line("unique", "row_id", "count(*)", "(select row_id from p group by 1 having count(*) > 1)"),
            _line(
                "unique", "game_id,pitch_no", "count(*)",
                "(select game_id from p group by game_id, pitch_no having count(*) > 1)",
            ),
        ],
    )
    out["q5_domains"] = _domain_check()
    out["q5_rate_domains"] = _report(
        ASOF_INPUT,
        [_line("domain", c, _count(f"not ({rule})"), "f") for c, rule in schema.RATE_DOMAINS.items()],
        *_all_features(ASOF_INPUT),
    )
    out["q5_tracking_domains"] = _report(
        ["season", "game_dayofweek", "pitch_type_group"],
        [_line("domain", c, _count(f"not ({rule})")) for c, rule in schema.TRACKMAN_DOMAINS.items()],
    )
    nulls = " union all ".join(
        f"select cast(n = 0 as int) as split, 'null' as \"check\", '{name}' as \"column\","
        f" count(*) - count({c}) as violations from b group by 1"
        for name, c in (
            ("asof_batter_success_rate", "rate"),
            ("asof_batter_middle_rate", "middle"),
            ("tagged_pitch_type", "tagged_pitch_type"),
        )
    )
    out["q6_null_profile"] = _with(
        [*BATTER, "is_middle", "tagged_pitch_type"],
        nulls,
        f"b as (select *, count(*) over w as n,"
        f" {_share('sum(control_success) over w', 'count(*) over w')} as rate,"
        f" {_share('sum(is_middle) over w', 'count(*) over w')} as middle from p {_window('batter_id')})",
    )
    out["q7_game_state"] = _game_state_check()
    out["q8_asof"] = _asof_check()
    sizes = "(select count(*) from pred) - (select count(*) from template)"
    out["q9_validate_submission"] = _report(
        PAIR,
        [
            _line("missing_id", "row_id", "count(*)",
                  "(select row_id from template except select row_id from pred)"),
            _line("extra_id", "row_id", "count(*)",
                  "(select row_id from pred except select row_id from template)"),
            _line("duplicate_id", "row_id", "count(*)",
                  "(select row_id from pred group by 1 having count(*) > 1)"),
            _line("null_value", "control_success", _count("control_success is null"), "pred"),
            _line("out_of_range", "control_success", _count("not control_success between 0 and 1"), "pred"),
            _line("row_count", "", f"abs({sizes})", "(select 1)"),
        ],
        *PAIR_STEPS,
    )
    out["q11_cutoff"] = _report(
        ["season"], [_line("cutoff", "season", _count(f"season >= {TEST_SEASON}"))]
    )
    out["q12_row_independence"] = _report(
        ["season"],
        [
            _line("row_independence", "", "0", "(select 1)"),
            _line("rows_compared", "", _count(f"season = {TEST_SEASON}")),
        ],
    )

    out["m1_constant_baseline"] = _with(
        ids, f"select row_id, 0.5::double as control_success from p where season = {TEST_SEASON}"
    )
    rate = f"(select round(avg(control_success), 9) from p where season < {TEST_SEASON})"
    out["m2_base_rate_baseline"] = _with(
        PAIR, f"select row_id, {rate} as control_success from p where season = {TEST_SEASON}"
    )
    out["m3_feature_pipeline"] = _model_features()
    out["m4_m5_fit_score"] = _with(
        ["row_id", "season", "game_type", "control_success"],
        f"select row_id, g.score from p join g using (game_type) where season = {TEST_SEASON}",
        "g as (select game_type, round(avg(control_success), 3) as score from p"
        f" where season < {TEST_SEASON} group by 1)",
    )
    out["m4_trees"] = _with(
        ["row_id", "season", "strikes_before", "control_success"],
        "select row_id, g.score from p join g on (strikes_before = 2) = g.f"
        f" where season = {TEST_SEASON}",
        "g as (select strikes_before = 2 as f, round(avg(control_success), 2) as score from p"
        f" where season < {TEST_SEASON} group by 1)",
    )
    # Four numbers, two rates, their two flags, and 2 + 2 + 2 + 5 category values.
    out["m4_m5_optimum"] = _with(
        ["season"],
        "select slot::int as slot, count(*) as n, 0.0::double as error from p, range(19) s(slot)"
        f" where season < {TEST_SEASON} group by 1",
    )
    out["m6_season_split"] = _with(
        ids,
        "select row_id, season, 'fit' as part from p where season < 2000 union all"
        " select row_id, season, 'valid' as part from p where season = 2000",
    )
    out["m7_metrics"] = _with(
        SCORED_COLUMNS,
        "select n, log_loss, brier, round((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 9) as auc"
        " from (select count(*) as n, sum(y)::double as pos, sum(rk) filter (where y = 1) as ranks,"
        " round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 9) as log_loss,"
        " round(avg((score - y) * (score - y)), 9) as brier from r)",
        SCORED,
        "r as (select *, least(greatest(score, 1e-15), 1 - 1e-15) as q, rank() over (order by score)"
        " + (count(*) over (partition by score) - 1) / 2.0::double as rk from s)",
    )
    out["m8_reliability"] = _with(
        SCORED_COLUMNS,
        "select cast(least(floor(score * 10), 9) as int) as bin, count(*) as n,"
        " round(avg(score), 9) as predicted, round(avg(y), 9) as observed from s group by 1",
        SCORED,
    )
    # The textbook form: the largest mean from earlier steps of the smallest to later ones.
    out["m9_recalibrate"] = _with(
        SCORED_COLUMNS,
        "select row_id, round(case when l.p < h.p then l.f + (h.f - l.f) * (score - l.p) / (h.p - l.p)"
        " else coalesce(l.f, h.f) end, 9) as score"
        " from (select row_id, score from s where season = 2001) t"
        " asof left join fit l on t.score >= l.p asof left join fit h on t.score <= h.p",
        SCORED,
        "v as (select least(floor(score * 10000), 10000) as step, avg(score) as p, count(*)::bigint as n, sum(y)::bigint as k"
        " from s where season < 2001 group by 1)",
        "c as (select *, sum(n) over o as w, sum(k) over o as t from v window o as (order by step))",
        "m as (select a.step as a, b.step as b, min((b.t - a.t + a.k)::double / (b.w - a.w + a.n))"
        " over (partition by a.step order by b.step desc) as low from c a join c b on a.step <= b.step)",
        "fit as (select c.step, c.p, max(low) as f from c join m on m.b = c.step group by all)",
    )
    out["flow2_history_features"] = _with(
        ["row_id", "season", "pitcher_id", "rel_speed"],
        "select row_id, h.n as hist_n, round(h.speed + 1e-9, 6) as hist_speed from p left join h using (pitcher_id, season)",
        "x as (select distinct pitcher_id, season from p)",
        "h as (select x.pitcher_id, x.season, count(*) as n, avg(t.rel_speed) as speed from x join p t"
        f" on t.pitcher_id = x.pitcher_id and t.season < x.season and t.season < {TEST_SEASON} group by all)",
    )
    out["flow3_submission"] = out["m4_m5_fit_score"].replace("g.score from", "g.score as control_success from")
    out["s1_read_train"] = _table(schema.TRAIN.fields)
    out["s2_read_test"] = _table(schema.TEST.fields, f"where season = {TEST_SEASON}")
    out["s3_read_trackman"] = _trackman()
    out["s4_s5_submission"] = out["m2_base_rate_baseline"]
    out.update(streams.oracles(_with))
    return out
