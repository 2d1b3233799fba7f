from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mound.operators import checks, isotonic, scoring
from mound.plans import flows, model
from mound.plans.pitch_view import pitch_view
from mound.sources.schema import LABEL
from tests.conftest import SF


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(11)
    data = []
    for i in range(600):
        x, rate = rng.gauss(0, 1), rng.random() if i % 5 else None
        hand = rng.choice(["L", "R"])
        z = 0.8 * x + (0.0 if rate is None else rate) - (0.5 if hand == "L" else 0)
        data.append((f"r{i}", 2018 + i % 3, x, rate, hand, int(rng.random() < 1 / (1 + math.exp(-z)))))
    return spark.createDataFrame(
        data, f"row_id string, season int, x double, rate double, hand string, {LABEL} int"
    ).cache()


@pytest.fixture(scope="module")
def fitted(train):
    return model.fit(train, ["x"], ["rate"], ["hand"], max_iter=100)


def test_logistic_coefficients(train, fitted):
    """Against Newton steps in numpy on the same design matrix."""
    pdf = train.toPandas()
    mean = pdf.rate.mean()
    design = np.column_stack(
        [np.ones(len(pdf)), pdf.x, pdf.rate.fillna(mean), pdf.rate.isna(), pdf.hand == "L"]
    ).astype(float)
    y, beta = pdf[LABEL].to_numpy(float), np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    want = dict(zip(pdf.row_id, 1 / (1 + np.exp(-design @ beta))))
    got = {r.row_id: r.score for r in model.score(fitted, train, ["rate"]).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_unseen_category_and_missing_rate_still_score(spark, fitted):
    rows = spark.createDataFrame(
        [("n", 0.0, None, "S"), ("m", 0.0, 0.5, None)],
        "row_id string, x double, rate double, hand string",
    )
    assert model.score(fitted, rows, ["rate"]).filter("score between 0 and 1").count() == 2


def test_rows_score_alone_as_in_the_file(train, fitted):
    out = checks.check_row_independence(
        lambda rows: model.score(fitted, rows, ["rate"]), train.drop(LABEL), F.col("hand") == "L"
    )
    assert out.first().violations == 0


def test_scoring_plan_has_no_group_or_window(train, fitted, capsys):
    model.score(fitted, train.drop(LABEL), ["rate"]).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_refuses_what_settles_with_the_pitch(train):
    with pytest.raises(ValueError):
        model.feature_stages(["rel_speed"], [], [])
    with pytest.raises(ValueError):
        model.fit(train, ["x"], kind="other")


def test_many_values_are_hashed(spark):
    ids = spark.range(6000).selectExpr("cast(id % 3000 as string) as pitcher_id", f"cast(id % 2 as int) as {LABEL}")
    fitted = model.fit(ids, [], hashed=["pitcher_id"])
    scored = model.score(fitted, ids, keep=("pitcher_id",))
    assert scored.filter("score between 0 and 1").count() == 6000
    # Two rows of one value share label and score; most values have a slot of their own.
    right = scored.filter("(score > 0.5) = (cast(pitcher_id as int) % 2 = 1)").count()
    assert right > 0.7 * 6000


def test_given_values_need_no_index(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("a", 1), ("b", 0), (None, 0)], f"hand string, {LABEL} int")
    fitted = model.fit_features(rows, [], categories={"hand": ["b", "a"]})
    got = [list(r.features.toArray()) for r in fitted.transform(rows).collect()]
    # The slot after the given values, for others, is the one that the codes leave out.
    assert got[:3] == [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]] and got[5] == [0.0, 0.0]


def test_rates_without_a_value(spark):
    rows = spark.createDataFrame([(i, None, i % 2) for i in range(40)], f"x int, rate double, {LABEL} int")
    fitted = model.fit(rows, ["x"], ["rate"])
    assert model.score(fitted, rows, ["rate"], keep=("x",)).filter("score between 0 and 1").count() == 40


def test_trees(train):
    trees = model.fit(train, ["x"], ["rate"], ["hand"], kind="trees", max_iter=3)
    assert model.score(trees, train, ["rate"]).filter("score between 0 and 1").count() == 600


def test_metrics_by_hand(spark):
    data = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1), (0.1, 0)]
    got = scoring.metrics(spark.createDataFrame(data, f"score double, {LABEL} int")).first()
    pairs = [(p, q) for p, y in data if y for q, z in data if not z]
    assert got.auc == pytest.approx(sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs))
    assert got.brier == pytest.approx(sum((p - y) ** 2 for p, y in data) / 6)
    assert got.log_loss == pytest.approx(-sum(math.log(p if y else 1 - p) for p, y in data) / 6)
    assert got.n == 6


@pytest.mark.parametrize("limit", [10**6, 7])
def test_auc_of_crowded_scores(spark, limit):
    rng = random.Random(4)
    data = [(0.5 + rng.randrange(60) * 1e-9, rng.randrange(2)) for _ in range(300)]
    counts = scoring.score_counts(spark.createDataFrame(data, f"score double, {LABEL} int"))
    pairs = [(p, q) for p, y in data if y for q, z in data if not z]
    want = sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)
    assert scoring.auc(counts, limit).first().auc == pytest.approx(want)


def test_isotonic_matches_pooling(spark):
    rng = random.Random(2)
    data = [(rng.randrange(40) / 40, int(rng.random() < 0.3 + 0.01 * rng.randrange(40))) for _ in range(400)]
    fitted = scoring.fit_recalibration(spark.createDataFrame(data, f"score double, {LABEL} int"))
    # Highest block mean from the left below lowest from the right: the textbook min-max form.
    xs = sorted({p for p, _ in data})
    n = [sum(p == x for p, _ in data) for x in xs]
    k = [sum(y for p, y in data if p == x) for x in xs]
    want = {
        x: max(
            min(sum(k[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(xs))) for a in range(i + 1)
        )
        for i, x in enumerate(xs)
    }
    rows = spark.createDataFrame([(x, x) for x in xs], "at double, score double")
    got = {r.at: r.score for r in scoring.apply_recalibration(fitted, rows).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("block", "fan"), [(256, 64), (1, 2), (3, 2), (7, 3)])
def test_minorant_in_blocks(spark, block, fan):
    """Hulls of blocks, merged in any shape, against the min-max form in fractions."""
    rng = random.Random(block)
    cases = [[(rng.randint(1, 5), None) for _ in range(30)] for _ in range(3)]
    cases = [[(n, rng.randint(0, n)) for n, _ in c] for c in cases]
    cases += [[(1, 0), (1, 1)] * 8, [(2, 2)] * 5 + [(3, 0)] * 5, [(9, k) for k in range(10)], [(4, 1)], []]
    for case in cases if block == 3 else cases[1:6:2]:
        at = sorted(rng.sample(range(60), len(case)))
        rows = [(a, n, k) for a, (n, k) in zip(at, case)]
        want = {
            a: max(
                min(Fraction(sum(k for _, k in case[i:j]), sum(n for n, _ in case[i:j])) for j in range(m + 1, len(case) + 1))
                for i in range(m + 1)
            )
            for m, a in enumerate(at)
        }
        frame = spark.createDataFrame(rows, "at long, n long, k long")
        got = {r["at"]: r.fitted for r in isotonic.fit(frame, 60, block, fan).collect()}
        assert got == {a: pytest.approx(float(v), abs=1e-12) for a, v in want.items()}


def test_recalibration_of_odd_scores(spark):
    valid = [(0.2, 0), (0.2, 1), (0.6, 1), (None, 1), (float("nan"), 0), (0.9, None)]
    fitted = scoring.fit_recalibration(spark.createDataFrame(valid, f"score double, {LABEL} int"))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.2, 0.4, 0.6, 1.0, None, float("nan"), 7.0])], "i int, score double")
    got = {r.i: r.score for r in scoring.apply_recalibration(fitted, rows).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.5, 0.5, 0.75, 1.0, 1.0])
    assert got[5] is None and got[6] is None and got[7] == 1.0
    nothing = scoring.fit_recalibration(spark.createDataFrame([], f"score double, {LABEL} int"))
    assert [r.score for r in scoring.apply_recalibration(nothing, rows.filter("i < 3")).orderBy("i").collect()] == [0.0, 0.2, 0.4]


def test_training_flow(spark):
    table = flows.training_table(pitch_view(spark, SF))
    train, test = scoring.season_split(table, 2001)
    fitted, scores = flows.train_model(train, 2000)
    assert 0 < scores.first().log_loss < 1
    pred = flows.predict(fitted, test.drop(LABEL))
    assert {r.violations for r in checks.validate_submission(pred, test).collect()} == {0}


def test_fit_deals_rows_to_bounded_tasks(spark, monkeypatch):
    rows = spark.range(600).selectExpr("cast(id % 2 as int) as x", "cast(id % 3 = 0 as int) as control_success").coalesce(1)
    seen = []
    monkeypatch.setattr(model, "TASK_ROWS", 100)
    prepare = model.prepare
    monkeypatch.setattr(model, "prepare", lambda used, *more: seen.append(used.rdd.getNumPartitions()) or prepare(used, *more))
    model.fit(rows, ["x"])
    assert seen == [1, 6]


def test_trees_take_equal_rows_once(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    rng = random.Random(5)
    data = [(rng.randrange(4), rng.choice([0.5, 1.5, None]), rng.choice("LR")) for _ in range(900)]
    data = [(x, r, h, int(rng.random() < 0.2 + 0.15 * x + (0.1 if h == "L" else 0))) for x, r, h in data]
    rows = spark.createDataFrame(data, f"x int, rate double, hand string, {LABEL} int")
    settled, write = [], model.settle

    def watched(df):
        settled.append(write(df))
        return settled[-1]

    monkeypatch.setattr(model, "settle", watched)
    fitted = model.fit(rows, ["x"], ["rate"], ["hand"], "trees", 6)
    assert settled[0].count() == len(set(data)) < 60
    ready = fitted.transform(model.prepare(rows, ["rate"])).withColumnRenamed("probability", "p")
    plain = GBTClassifier(labelCol=LABEL, maxIter=6, seed=7).fit(ready.select("features", LABEL))
    both = plain.transform(ready.drop("prediction", "rawPrediction")).select("p", "probability").collect()
    assert len(both) == 900 and max(abs(r.p[1] - r.probability[1]) for r in both) < 1e-9
