"""As-of features by hand, as properties, and with one key holding most rows."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mound.operators import asof
from mound.operators.ordered import neighbour, number_rows, quantiles, running, split_if_large

COLUMNS = (
    "row_id string, game_date date, game_id int, pitch_no int, pitcher_id string, batter_id string,"
    " season int, game_month int, control_success int, is_reverse int, is_middle int, is_ball int,"
    " is_strike int, pitch_type_group string, rel_speed double, inning int, top_bottom string"
)


def pitch(i, day, game, no, label, pitcher="a", batter="x", group="fastball", season=2020, inning=1):
    return (
        f"r{i:05d}", datetime.date(season, 1, 1) + datetime.timedelta(days=day), game, no, pitcher,
        batter, season, 1, label, 1 - label, label, i % 2, 1 - i % 2, group, 90.0 + i % 7, inning, "T",
    )


def make_log(spark, pitches):
    return spark.createDataFrame(pitches, COLUMNS)


def random_log(n=400, seed=3, hot=0.5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        pitcher = "hot" if rng.random() < hot else f"p{rng.randrange(4)}"
        out.append(
            pitch(
                i, rng.randrange(25), rng.randrange(3), rng.randrange(20), rng.randrange(2), pitcher,
                f"b{rng.randrange(3)}", rng.choice(["fastball", "breaking", "offspeed", "other", None]),
                2019 + rng.randrange(4), rng.randrange(3),
            )
        )
    return out


def by_hand(pitches, key, value):
    """Count and sum of ``value`` over earlier pitches of the key, in plain Python."""
    seen, out = {}, {}
    for p in sorted(pitches, key=lambda p: (p[1], p[2], p[3], p[0])):
        n, k = seen.get(p[key], (0, 0))
        out[p[0]] = (n, k)
        seen[p[key]] = (n + 1, k + value(p))
    return out


def test_current_pitch_is_excluded(spark, rows):
    log = make_log(spark, [pitch(0, 0, 1, 1, 1), pitch(1, 0, 1, 2, 0), pitch(2, 1, 2, 1, 1)])
    out = asof.asof_rates(log, "pitcher_id", "pitcher", {"success": "control_success"})
    got = rows(out, "row_id", "asof_pitcher_n", "asof_pitcher_success_rate")
    assert got == [("r00000", 0, None), ("r00001", 1, 1.0), ("r00002", 2, 0.5)]


def games_log(spark):
    labels = {1: [1, 0], 2: [0], 3: [1, 1, 0], 4: [0]}
    pitches = [
        pitch(10 * g + i, g, g, i, label) for g, ls in labels.items() for i, label in enumerate(ls)
    ]
    return make_log(spark, pitches)


@pytest.mark.parametrize("bucket_rows", [1, 2, 4096])
def test_previous_games(spark, rows, bucket_rows):
    out = asof.prev_games(
        games_log(spark), "pitcher_id", "pitcher", {"success": "control_success"}, (1, 3),
        bucket_rows=bucket_rows,
    )
    names = [f"asof_pitcher_prev{k}_game_success_rate" for k in (1, 3)]
    assert rows(out, "game_id", *names) == [
        (1, None, None), (2, 0.5, 0.5), (3, 0.0, 1 / 3), (4, 2 / 3, 0.5),
    ]


def test_previous_games_mean(spark, rows):
    out = asof.prev_games(
        games_log(spark), "pitcher_id", "pitcher", {"success": "control_success"}, (3,), how="mean"
    )
    last = rows(out, "game_id", "asof_pitcher_prev3_game_success_rate")[-1]
    assert last == (4, pytest.approx((0.5 + 0.0 + 2 / 3) / 3))


def test_double_header(spark, rows):
    log = make_log(spark, [pitch(0, 0, 1, 1, 1), pitch(1, 0, 2, 1, 0)])
    out = asof.prev_games(log, "pitcher_id", "pitcher", {"success": "control_success"}, (1,))
    assert rows(out, "game_id", "asof_pitcher_prev1_game_success_rate") == [(1, None), (2, 1.0)]


def test_mix_counts_other(spark, rows):
    log = make_log(
        spark, [pitch(0, 0, 1, 1, 1), pitch(1, 0, 1, 2, 1, group="other"), pitch(2, 0, 1, 3, 1)]
    )
    out = asof.asof_rates(log, "pitcher_id", "pitcher", {}, asof.MIX)
    names = ["pitchmix_n", "fastball_rate", "breaking_rate", "offspeed_rate"]
    assert rows(out, "row_id", *[f"asof_pitcher_{n}" for n in names])[-1] == ("r00002", 2, 0.5, 0.0, 0.0)


def test_hot_pitcher_matches_plain_python(spark):
    pitches = random_log()
    log = make_log(spark, pitches)
    got = {r.row_id: r for r in asof.asof_features(log, bucket_rows=2).collect()}
    assert len(got) == len(pitches)
    pitcher = by_hand(pitches, 4, lambda p: p[8])
    batter = by_hand(pitches, 5, lambda p: p[10])
    for i, r in got.items():
        n, k = pitcher[i]
        assert r.asof_pitcher_n == n
        assert r.asof_pitcher_success_rate == (k / n if n else None)
        n, k = batter[i]
        assert r.asof_batter_n == n
        assert r.asof_batter_middle_rate == (k / n if n else None)


def test_input_order_does_not_matter(spark, rows):
    pitches = random_log(120)
    shuffled = random.Random(1).sample(pitches, len(pitches))
    names = ["row_id", "asof_pitcher_n", "asof_pitcher_success_rate", "asof_batter_n",
             "asof_pitcher_prev3_game_middle_rate"]
    one, two = (rows(asof.asof_features(make_log(spark, p)), *names) for p in (pitches, shuffled))
    assert one == two


def test_later_rows_change_nothing_before_them(spark, rows):
    pitches = random_log(120)
    later = [pitch(900 + i, 400, 9, i, i % 2, "hot", "b1", season=2023) for i in range(30)]
    names = ["row_id", "asof_pitcher_n", "asof_pitcher_middle_rate", "asof_batter_success_rate",
             "asof_pitcher_prev5_game_success_rate"]
    known = {p[0] for p in pitches}
    alone = rows(asof.asof_features(make_log(spark, pitches)), *names)
    both = rows(asof.asof_features(make_log(spark, pitches + later)), *names)
    assert [r for r in both if r[0] in known] == alone


def test_rolling_over_bucket_ends(spark):
    pitches = random_log(200)
    frames = {"n": F.count("*"), "k": F.sum("control_success"), "top": F.max("rel_speed")}
    log = make_log(spark, pitches)
    wide = asof.rolling(log, "pitcher_id", 5, frames)
    narrow = asof.rolling(log, "pitcher_id", 5, frames, bucket_rows=5)
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))
    history = {}
    want = {}
    for p in sorted(pitches, key=lambda p: (p[1], p[2], p[3], p[0])):
        last = history.setdefault(p[4], [])
        want[p[0]] = (len(last[-5:]), sum(q[8] for q in last[-5:]) if last else None)
        last.append(p)
    assert {r.row_id: (r.n, r.k) for r in narrow.collect()} == want


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_pitch_numbers_of_a_large_game(spark, block_rows):
    pitches = [
        pitch(i, 0, 1 if i % 3 else 2, i // 2, 1, batter=f"b{i // 7 % 3}", inning=i // 40)
        for i in range(150)
    ]
    log = make_log(spark, pitches)
    numbered = {r.row_id: r.seq for r in asof.pitch_no(log, name="seq", block_rows=block_rows).collect()}
    turns = {
        r.row_id: (r.pa_no, r.pitch_of_pa)
        for r in asof.pitch_of_pa(log, block_rows=block_rows).collect()
    }
    state = {}
    for p in sorted(pitches, key=lambda p: (p[2], p[3], p[0])):
        game, turn = p[2], (p[15], p[16], p[5])
        n, pa, at, prev = state.get(game, (0, 0, 0, None))
        pa, at = (pa, at + 1) if turn == prev else (pa + 1, 1)
        state[game] = (n + 1, pa, at, turn)
        assert numbered[p[0]] == n + 1
        assert turns[p[0]] == (pa, at)


@pytest.mark.parametrize("limit, block", [(10**6, ["game_date"]), (3, ["__part"])])
def test_levels_of_a_crowded_day(spark, limit, block):
    log = make_log(spark, random_log(150))
    split, levels = split_if_large(log, ["pitcher_id"], asof.ORDER, limit, block=["game_date"])
    assert levels[0] == block
    names = ["row_id", "asof_pitcher_n", "asof_pitcher_success_rate"]
    picked = {"success": "control_success"}
    got = asof.asof_rates(split, "pitcher_id", "pitcher", picked, levels=levels).select(names)
    want = asof.asof_rates(log, "pitcher_id", "pitcher", picked).select(names)
    assert got.count() == 150 and got.exceptAll(want).count() == 0


def test_range_blocks_cut_a_large_key(spark):
    df = spark.range(4000).selectExpr("1 as k", "id % 50 as v", "id")
    split, levels = split_if_large(df, ["k"], ["v", "id"], limit=100)
    assert levels[0] == ["__part"] and split.select("__part").distinct().count() > 1
    got = number_rows(split, ["k"], levels, "at")
    assert got.agg(F.countDistinct("at"), F.min("at"), F.max("at")).first()[:] == (4000, 1, 4000)
    assert got.filter("at = 1").first().id == 0


def test_three_levels_equal_one(spark):
    log = make_log(spark, random_log(150))
    sums = {"n": F.lit(1), "k": F.col("control_success")}
    deep = running(log, ["pitcher_id"], [["game_date"], ["game_id"], ["pitch_no", "row_id"]], sums)
    flat = running(log, ["pitcher_id"], [["game_date", "game_id", "pitch_no", "row_id"]], sums)
    key = ["row_id", "n", "k"]
    assert deep.select(key).exceptAll(flat.select(key)).count() == 0


def test_neighbour_over_empty_blocks(spark, rows):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 5, 3), ("b", 5, 4)], "k string, b int, o int")
    back = neighbour(df, ["k"], [["b"], ["o"]], ["o"], "prev")
    assert rows(back, "o", "prev.o") == [(1, None), (2, 1), (3, 2), (4, None)]
    ahead = neighbour(df, ["k"], [["b"], ["o"]], ["o"], "next", step=1)
    assert rows(ahead, "o", "next.o") == [(1, 2), (2, 3), (3, None), (4, None)]


def test_lagged_history(spark, rows):
    history = make_log(spark, [pitch(0, 0, 1, 1, 1, season=2019), pitch(1, 0, 2, 1, 0, season=2021)])
    fitted = asof.fit_history(
        history, "pitcher_id", ["season"], {"hist_n": F.lit(1), "hist_k": F.col("control_success")}
    )
    asked = spark.createDataFrame(
        [(1, "a", 2019), (2, "a", 2020), (3, "a", 2021), (4, "a", 2022), (5, "zz", 2022)],
        "i int, pitcher_id string, season int",
    )
    out = asof.join_history_lagged(asked, fitted, "pitcher_id", ["season"])
    assert rows(out, "i", "hist_n", "hist_k") == [
        (1, None, None), (2, 1, 1), (3, 1, 1), (4, 2, 1), (5, None, None),
    ]


def test_lagged_history_by_month(spark):
    periods = [(2019, 4), (2019, 9), (2021, 3), (2021, 12)]
    history = spark.createDataFrame(
        [("a", y, m, 1) for y, m in periods], "pitcher_id string, season int, game_month int, k int"
    )
    by = ["season", "game_month"]
    fitted = asof.fit_history(history, "pitcher_id", by, {"hist_k": F.col("k")})
    asked = [("a", y, m) for y in range(2018, 2026) for m in range(1, 13)]
    rows = spark.createDataFrame(asked, "pitcher_id string, season int, game_month int")
    out = asof.join_history_lagged(rows, fitted, "pitcher_id", by).collect()
    assert len(out) == len(asked)
    for r in out:
        assert (r.hist_k or 0) == sum(p < (r.season, r.game_month) for p in periods)


def test_no_history_at_all(spark):
    rows = make_log(spark, [pitch(0, 0, 1, 1, 1)])
    fitted = asof.fit_history(
        rows.filter("false"), "pitcher_id", ["season"], {"k": F.col("control_success")}
    )
    assert asof.join_history_lagged(rows, fitted, "pitcher_id", ["season"]).first().k is None


def test_asof_join_is_strict(spark, rows):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 20), (3, "v", 20)], "event_id int, k string, t int")
    right = spark.createDataFrame(
        [(7, "u", 10, 1.0), (8, "u", 15, 2.0), (9, "u", 20, 3.0)], "event_id int, k string, t int, v double"
    )
    for width in (1, 7, 1000):
        block = F.floor(F.col("t") / width)
        out = asof.asof_join(left, right, "k", "t", ["v"], "event_id", block)
        assert rows(out, "event_id", "asof_v") == [(1, None), (2, 2.0), (3, None)]


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, -rng.expovariate(1), rng.expovariate(1), 1e12]) for _ in range(500)]
    data = [("a" if i % 3 else None, v) for i, v in enumerate(values)] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r for r in quantiles(df, ["g"], ["v"], probs).collect()}
    for g in ("a", None):
        xs = sorted(v for h, v in data if h == g and v is not None and v == v)
        for p in probs:
            at = p * (len(xs) - 1)
            lo = int(at)
            hi = min(lo + 1, len(xs) - 1)
            want = xs[lo] + (xs[hi] - xs[lo]) * (at - lo)
            assert got[g][f"q{round(p * 100):02d}"] == pytest.approx(want)


def test_rows_without_a_player_are_kept(spark):
    pitches = random_log(60)
    lost = [("n" + p[0], *p[1:4], None, None, *p[6:]) for p in pitches[:10]]
    log = make_log(spark, pitches + lost)
    out = asof.asof_features(log)
    assert out.count() == 70 and out.select("row_id").distinct().count() == 70
    names = ["row_id", "asof_pitcher_n", "asof_batter_n", "asof_pitcher_prev1_game_success_rate"]
    known = out.filter("pitcher_id is not null").select(names)
    assert known.exceptAll(asof.asof_features(make_log(spark, pitches)).select(names)).count() == 0


def test_unknown_pooling(spark):
    with pytest.raises(ValueError):
        asof.prev_games(games_log(spark), "pitcher_id", "pitcher", {"success": "control_success"}, how="x")


def small_and_large(spark, **limits):
    """As-of columns by default limits and by others."""
    odd = [p[:1] + (None,) + p[2:] if i % 37 == 0 else p for i, p in enumerate(random_log())]
    odd = [p[:4] + (None,) + p[5:] if i % 29 == 0 else p for i, p in enumerate(odd)]
    log = make_log(spark, [p[:5] + (None,) + p[6:] if i % 31 == 0 else p for i, p in enumerate(odd)])
    found = []
    for more in ({}, limits):
        out = asof.asof_features(log, **more)
        found.append(sorted(map(str, out.select(sorted(out.columns)).collect())))
    return found


@pytest.mark.parametrize("limit", [0, 50])
def test_features_of_busy_players_are_those_of_one_window(spark, limit):
    want, got = small_and_large(spark, limit=limit)
    assert got == want and len(want) == 400


@pytest.mark.parametrize("limit", [0, 3])
def test_games_of_busy_players(spark, rows, limit):
    log = make_log(spark, random_log())
    picked = {"success": "control_success"}
    for make in (
        lambda **more: asof.prev_games(log, "pitcher_id", "pitcher", picked, **more),
        lambda **more: asof.game_seq(log, "pitcher_id", **more),
    ):
        want, got = make(), make(limit=limit)
        assert rows(got, *want.columns) == rows(want, *want.columns)


def test_rows_of_all_features_are_shuffled_once_a_player(spark):
    log = make_log(spark, random_log())
    plan = asof.asof_features(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_counting_games_holds_a_bounded_number_of_rows(spark, monkeypatch):
    log = make_log(spark, random_log())
    monkeypatch.setattr(asof, "TASK_ROWS", 20)
    games = asof.per_game(log, "pitcher_id", {"success": "control_success"})
    assert games.agg(F.sum("n")).first()[0] == 400
    plan = games._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pitcher_id" in plan and ", 20), REPARTITION_BY_NUM" in plan


def test_appearances_of_small_games_read_the_log_once(spark, rows):
    rng = random.Random(21)
    data = []
    for i in range(400):
        game = rng.choice([None, 1, 2, 3, 4])
        pitch = None if i % 50 == 7 else i
        data.append((game, pitch, f"r{i}", rng.randrange(1, 4), rng.choice("TB"), rng.choice([None, 7, 8])))
    log = spark.createDataFrame(data, "game_id long, pitch_no int, row_id string, inning int, top_bottom string, batter_id long")
    columns = ("row_id", "pa_no", "pitch_of_pa")
    want = rows(asof.pitch_of_pa(log, block_rows=40), *columns)
    plain, mixed = asof.pitch_of_pa(log, limit=1_000), asof.pitch_of_pa(log, limit=80)
    assert rows(plain, *columns) == want and rows(mixed, *columns) == want
    assert plain.schema == asof.pitch_of_pa(log).schema
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
