"""Files, checks, joins and aggregates on small tables."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mound.operators import aggregates, asof, checks, filters, joins
from mound.operators.attach import attach, settle, shared_folder
from mound.plans import flows
from mound.plans.pitch_view import pitch_view
from mound.sources import files, schema
from mound.sources.schema import LABEL
from tests.conftest import SF


def report(df):
    return {(r.check, r.column): r.violations for r in df.collect()}


def submission(spark, pairs):
    return spark.createDataFrame(pairs, schema.SUBMISSION.simpleString()[7:-1].replace(":", " "))


TEMPLATE = [(f"TEST_{i:06d}", 0.5) for i in (1, 17, 213)]


def test_documented_sizes():
    assert [len(s) for s in (schema.TRAIN, schema.TEST, schema.TRACKMAN, schema.SUBMISSION)] == [
        49, 48, 30, 2,
    ]
    assert len(schema.RATE_COLUMNS) == 16


def test_template_with_mark_and_crlf(spark, tmp_path):
    path = tmp_path / "template.csv"
    path.write_bytes(b"\xef\xbb\xbfrow_id,control_success\r\nTEST_000001,0.5\r\nTEST_000017,0.5\r\n")
    got = files.read_template(spark, str(path))
    assert got.columns == ["row_id", LABEL]
    assert [tuple(r) for r in got.collect()] == [("TEST_000001", 0.5), ("TEST_000017", 0.5)]


@pytest.mark.parametrize("text", ["control_success,row_id\n0.5,TEST_1\n", "row_id,control_success\nTEST_1,abc\n"])
def test_bad_files_fail(spark, tmp_path, text):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(Exception):
        files.read_template(spark, str(path)).collect()


def test_submission_round_trip(spark, tmp_path):
    pred = submission(spark, [(i, 0.25) for i, _ in TEMPLATE])
    path = str(tmp_path / "out")
    files.write_submission(pred, submission(spark, TEMPLATE), path)
    back = files.read_template(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted((i, 0.25) for i, _ in TEMPLATE)
    assert report(checks.check_schema(back, schema.SUBMISSION))[("column_count", "")] == 0


FAULTS = {
    "missing_id": lambda rows: rows[1:],
    "extra_id": lambda rows: [*rows, ("TEST_9", 0.5)],
    "duplicate_id": lambda rows: [*rows, rows[0]],
    "null_value": lambda rows: [(rows[0][0], None), *rows[1:]],
    "out_of_range": lambda rows: [(rows[0][0], 1.2), *rows[1:]],
}


@pytest.mark.parametrize("fault", FAULTS)
def test_submission_faults(spark, tmp_path, fault):
    pred = spark.createDataFrame(FAULTS[fault](TEMPLATE), f"row_id string, {LABEL} double")
    template = submission(spark, TEMPLATE)
    got = {c: v for (c, _), v in report(checks.validate_submission(pred, template)).items() if c != "row_count"}
    assert got == {c: int(c == fault) for c in FAULTS}
    with pytest.raises(ValueError):
        files.write_submission(pred, template, str(tmp_path / "never"))


def test_not_a_number_is_out_of_range(spark):
    pred = submission(spark, [(TEMPLATE[0][0], float("nan")), *TEMPLATE[1:]])
    got = report(checks.validate_submission(pred, submission(spark, TEMPLATE)))
    assert got[("out_of_range", LABEL)] == 1


def test_schema_checks(spark):
    train = spark.createDataFrame([], schema.TRAIN)
    test = spark.createDataFrame([], schema.TEST)
    assert set(report(checks.check_schema(train, schema.TRAIN)).values()) == {0}
    assert report(checks.check_feature_parity(train, test)) == {("feature_parity", ""): 0}
    assert report(checks.check_feature_parity(train, test.drop("li"))) == {("feature_parity", "li"): 1}
    wrong = test.withColumn("li", F.col("li").cast("string"))
    assert report(checks.check_schema(wrong, schema.TEST))[("schema", "li")] == 1
    assert report(checks.forbid_columns(test)) == {("forbidden", ""): 0}
    found = report(checks.forbid_columns(train.withColumn("rel_speed", F.lit(1.0))))
    assert found == {("forbidden", LABEL): 1, ("forbidden", "rel_speed"): 1}
    assert set(filters.allowed_features(train).columns) == set(schema.TEST.names) - {"row_id"}


def test_cutoff(spark):
    history = spark.createDataFrame([(2024,), (2025,)], "season int")
    assert report(checks.check_cutoff(history, 2025)) == {("cutoff", "season"): 1}
    assert filters.before(history, 2025).count() == 1


@pytest.mark.parametrize("block", [2, 65_536])
def test_asof_check_finds_faults(spark, block):
    good = [
        ("a", "r0", 0, None, 1), ("a", "r1", 1, 1.0, 0), ("a", "r2", 2, 0.5, 1), ("a", "r3", 3, 2 / 3, 1),
    ]
    columns = f"pitcher_id string, row_id string, asof_pitcher_n long, asof_pitcher_success_rate double, {LABEL} int"

    def faults(data):
        got = report(checks.check_asof(spark.createDataFrame(data, columns), block=block))
        return {c: v for (c, _), v in got.items()}

    assert set(faults(good).values()) == {0}
    assert faults(good[:2] + [("a", "r2", 2, 0.5, 0)] + good[3:])["label_step"] == 1
    assert faults([*good, ("a", "r4", 3, 2 / 3, 1)])["ordinal_repeat"] == 1
    assert faults([*good, ("a", "r4", 4, 0.25, 1)])["success_drop"] == 1
    assert faults([*good, ("a", "r4", 4, None, 1)])["rate_null"] == 1


def test_domains_count_only_what_breaks_them(spark):
    df = spark.createDataFrame([(0, "T"), (7, "X"), (None, "B")], "game_dayofweek int, top_bottom string")
    found = report(checks.check_domains(df, schema.TRAIN_DOMAINS))
    absent = {k: n for k, n in found.items() if k[0] == "absent"}
    assert absent == {("absent", c): 1 for c in schema.TRAIN_DOMAINS if c not in df.columns}
    got = {k: n for k, n in found.items() if k not in absent}
    assert got == {("domain", "game_dayofweek"): 1, ("domain", "top_bottom"): 1}


def test_row_independence_sees_a_leak(spark):
    test = spark.createDataFrame([(f"r{i}", i) for i in range(6)], "row_id string, x int")
    part = F.col("x") < 3
    honest = checks.check_row_independence(lambda d: d.withColumn("score", F.col("x") / 6), test, part)
    assert honest.first().violations == 0
    whole_file = Window.partitionBy(F.lit(1))
    leaky = checks.check_row_independence(
        lambda d: d.withColumn("score", F.avg("x").over(whole_file)), test, part
    )
    assert leaky.first().violations == 12


def test_target_encoding_never_sees_its_season(spark):
    rows = [(f"r{i}", 2019 + i // 4, "a" if i % 2 else "b", i % 3 == 0) for i in range(16)]
    train = spark.createDataFrame(
        [(r, s, p, int(y)) for r, s, p, y in rows], f"row_id string, season int, pitcher_id string, {LABEL} int"
    )
    got = {r.row_id: r.te_pitcher_id for r in aggregates.target_encode(train, "pitcher_id", 10.0).collect()}
    for r, s, p, _ in rows:
        past = [y for _, s2, _, y in rows if s2 < s]
        own = [y for _, s2, p2, y in rows if s2 < s and p2 == p]
        want = (sum(own) + 10 * sum(past) / len(past)) / (len(own) + 10) if past else None
        assert got[r] == (pytest.approx(want) if past else None)


def test_target_encoding_of_later_seasons(spark):
    train = spark.createDataFrame(
        [("r1", 2019, "a", 1), ("r2", 2020, "a", 0)], f"row_id string, season int, pitcher_id string, {LABEL} int"
    )
    later = spark.createDataFrame([("t", 2025, "new")], "row_id string, season int, pitcher_id string")
    fitted = aggregates.fit_target_encoding(train, "pitcher_id")
    assert aggregates.apply_target_encoding(later, fitted, "pitcher_id").first().te_pitcher_id == 0.5


def test_large_tables_join_by_shuffle(spark):
    """Above the broadcast limit the same rows come out of a shuffle join."""
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) as k")
    table = spark.range(50).selectExpr("id as k", "id * 2 as v")
    small = attach(rows, table, ["k"])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = attach(rows, table, ["k"]).select("id", "k", "v")
        assert large.count() == 3000 and large.exceptAll(small.select("id", "k", "v")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_many_rows_are_not_broadcast(spark, monkeypatch, capsys):
    monkeypatch.setattr("mound.operators.attach.BROADCAST_ROWS", 10)
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) as k")
    table = spark.range(50).selectExpr("id as k", "id * 2 as v")
    joined = attach(rows, table, ["k"])
    joined.explain()
    assert "SortMergeJoin" in capsys.readouterr().out
    assert joined.filter("v = 2 * k").count() == 3000


def test_many_rows_behind_the_pitch_view_are_not_broadcast(spark, monkeypatch, tmp_path):
    order = spark.range(40).selectExpr("id as o_orderkey", "id % 3 as o_custkey", "timestamp_ntz'2001-04-01 00:00:00' as o_orderdate")
    order.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("id as c_custkey", "cast(id as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(90).selectExpr("id % 45 as l_orderkey", "cast(id as int) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    columns = ["game_id", "pitch_no", "game_date", "batter_team_id"]
    few = pitch_view(spark, str(tmp_path), columns)
    monkeypatch.setattr("mound.plans.pitch_view.JOIN_ROWS", 10)
    many = pitch_view(spark, str(tmp_path), columns)
    plan = many._jdf.queryExecution().executedPlan().toString()
    # Orders meet line items by shuffle; three customers may still be broadcast.
    assert plan.count("SortMergeJoin [l_orderkey") == 1 and plan.count("SortMergeJoin") == 1
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.count() == 80


def test_shared_folder_comes_from_the_session():
    def session(named, master):
        context = SimpleNamespace(
            master=master, applicationId="app-x", getCheckpointDir=lambda: None
        )
        conf = SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": named}[name])
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_folder(session("hdfs://shared/x", "yarn")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        shared_folder(session(None, "yarn"))


def test_settled_rows_survive(spark, rows):
    data = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    back = settle(data)
    assert back.schema == data.schema and rows(back, "v", "k") == [(1, "a"), (2, None)]


def test_season_layout_prunes(spark, tmp_path, capsys):
    log = pitch_view(spark, SF, ["row_id", "season", "inning"])
    landed = files.land_by_season(log, str(tmp_path / "log"))
    pruned = filters.seasons(landed, 1996, 1997)
    assert pruned.count() == filters.seasons(log, 1996, 1997).count()
    pruned.explain()
    assert "PartitionFilters: [isnotnull(season" in capsys.readouterr().out


def test_profiles_agree(spark):
    log = pitch_view(spark, SF, ["pitcher_id", "rel_speed"])
    exact = aggregates.pitcher_profile(log, "pitcher_id", ["rel_speed"])
    close = aggregates.pitcher_profile(log, "pitcher_id", ["rel_speed"], exact=False)
    both = exact.alias("e").join(close.alias("c"), "pitcher_id")
    assert both.filter(F.abs(F.col("e.q50") / F.col("c.q50") - 1) > 0.05).count() == 0


def test_history_features(spark, rows):
    log = flows.tracking_table(pitch_view(spark, SF))
    asked = spark.createDataFrame([("7", 1996), ("7", 1995), ("none", 1996)], "pitcher_id string, season int")
    out = flows.history_features(asked, log, 1998, "pitcher_id", "pitcher_trackman_id")
    got = {(r.pitcher_id, r.season): r for r in out.collect()}
    past = log.filter("season = 1995 and pitcher_trackman_id = '7'")
    assert got["7", 1996].hist_n == past.count()
    assert got["7", 1996].hist_speed == pytest.approx(past.agg(F.avg("rel_speed")).first()[0])
    assert got["7", 1995].hist_n is None and got["none", 1996].hist_n is None


def test_ids(spark, rows):
    a = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "row_id string")
    b = spark.createDataFrame([("x",), ("y",), ("w",)], "row_id string")
    assert rows(joins.id_difference(a, b), "row_id") == [("x",), ("z",)]
    assert rows(joins.id_overlap(a, b), "row_id") == [("x",), ("y",)]
    assert rows(joins.id_mismatch(a, b), "row_id", "side") == [("w", "missing"), ("z", "extra")]
    assert joins.id_coverage(a, b, "row_id", "row_id").first()[:] == (3, 2, 1, 2 / 3)


def test_expanding_and_game_seq_columns(spark):
    log = pitch_view(spark, SF, ["pitcher_id", "game_date", "game_id"])
    seq = asof.game_seq(log, "pitcher_id")
    tops = seq.groupBy("pitcher_id").agg(F.max("game_seq").alias("m"), F.count("*").alias("n"))
    assert tops.filter("m <> n").count() == 0


def test_written_tables_may_be_compressed(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('r', id) as row_id", "id / 50 as control_success")
    files.write_csv(rows.repartition(3), str(tmp_path / "t"), "gzip")
    assert list((tmp_path / "t").glob("*.csv.gz")) and not list((tmp_path / "t").glob("*.csv"))
    assert files.read_template(spark, str(tmp_path / "t")).exceptAll(rows).count() == 0
