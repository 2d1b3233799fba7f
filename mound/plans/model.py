"""Probability model: features, fit on train only, row-wise scoring."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mound.functions.scalars import clip_probability, missing_flags
from mound.operators.attach import settle
from mound.operators.scoring import SCORE
from mound.sources.schema import BANNED, LABEL

# Slots of a hashed category column.
HASH_WIDTH = 4_096
# Number of equal rows.
WEIGHT = "__n"
# Rows of a task that fits.
TASK_ROWS = 500_000
# Stands in for a missing rate; its flag carries the information.
MISSING_RATE = 0.0

Categories = Sequence[str] | Mapping[str, Sequence[str]]


def _flagged(rates: Sequence[str]) -> list[str]:
    return [f"{c}_missing" for c in rates]


def prepare(rows: DataFrame, rates: Sequence[str]) -> DataFrame:
    """Missing flags and filled doubles; row-wise, so train and test go the same way."""
    flagged = rows.withColumns(missing_flags(rates)) if rates else rows
    filled = {f"{c}_filled": F.coalesce(F.col(c).cast("double"), F.lit(MISSING_RATE)) for c in rates}
    return flagged.withColumns(filled)


def _indexer(categories: Categories, indexed: list[str]) -> Transformer | Estimator:
    """Codes of given values, or of those seen in train; either way others share a slot."""
    if isinstance(categories, Mapping):
        return StringIndexerModel.from_arrays_of_labels(
            [list(v) for v in categories.values()], list(categories), indexed, handleInvalid="keep"
        )
    return StringIndexer(
        inputCols=list(categories), outputCols=indexed, handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )


def feature_stages(
    numbers: Sequence[str],
    rates: Sequence[str],
    categories: Categories = (),
    hashed: Sequence[str] = (),
    width: int = HASH_WIDTH,
) -> list:
    """Numbers, rates with flags, one-hot codes and hashed columns, assembled.

    ``categories`` are columns of few values, as a mapping from column to its values or
    as names whose values train shows; their index lives on the driver and in every
    task. ``hashed`` are columns of any number of values, which share ``width`` slots.
    """
    banned = set(BANNED) & {*numbers, *rates, *categories, *hashed}
    if banned:
        raise ValueError(f"not known before the pitch: {', '.join(sorted(banned))}")
    stages: list = []
    if categories:
        indexed = [f"{c}_index" for c in categories]
        stages += [
            _indexer(categories, indexed),
            OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_onehot" for c in categories]),
        ]
    if hashed:
        stages.append(
            FeatureHasher(
                inputCols=list(hashed), outputCol="hashed", numFeatures=width, categoricalCols=list(hashed)
            )
        )
    inputs = [
        *numbers,
        *[f"{c}_filled" for c in rates],
        *_flagged(rates),
        *[f"{c}_onehot" for c in categories],
        *(["hashed"] if hashed else []),
    ]
    return stages + [VectorAssembler(inputCols=inputs, outputCol="features")]


def fit_features(
    train: DataFrame,
    numbers: Sequence[str],
    rates: Sequence[str] = (),
    categories: Categories = (),
    hashed: Sequence[str] = (),
) -> PipelineModel:
    """Learn codes from train only."""
    stages = feature_stages(numbers, rates, categories, hashed)
    return Pipeline(stages=stages).fit(prepare(train, rates))


def fit(
    train: DataFrame,
    numbers: Sequence[str],
    rates: Sequence[str] = (),
    categories: Categories = (),
    kind: str = "logistic",
    max_iter: int | None = None,
    hashed: Sequence[str] = (),
) -> PipelineModel:
    """Fit features and classifier on train; nothing of the test table goes in.

    The columns used are settled first: the fit passes over them many times and must
    not compute them again each time, nor when an executor is lost. A logistic fit that has
    not converged after ``max_iter`` rounds (200 unless given) is an error; trees are
    as many as asked for (20).
    """
    if kind == "logistic":
        learner = LogisticRegression(labelCol=LABEL, maxIter=max_iter or 200)
    elif kind == "trees":
        learner = GBTClassifier(labelCol=LABEL, maxIter=max_iter or 20, seed=7)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    used = train.select(*numbers, *rates, *categories, *hashed, LABEL)
    if kind == "trees":
        # To a split equal rows are one of their number: each tree passes over different rows only.
        used = used.groupBy(*used.columns).agg(F.count("*").cast("double").alias(WEIGHT))
        learner.setWeightCol(WEIGHT)
    used = settle(used)
    features = fit_features(used, numbers, rates, categories, hashed)
    # A settled file of few columns is small and its rows many: dealt anew, a task holds a bounded number of them.
    size = used.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("largest"), F.sum("count").alias("n")).first()
    if (size.largest or 0) > TASK_ROWS:
        used = used.repartition(math.ceil(size.n / TASK_ROWS))
    classifier = learner.fit(features.transform(prepare(used, rates)))
    if kind == "logistic" and classifier.summary.totalIterations >= learner.getMaxIter():
        raise RuntimeError(f"no convergence in {learner.getMaxIter()} rounds")
    return PipelineModel(stages=[*features.stages, classifier])


def score(
    model: PipelineModel, rows: DataFrame, rates: Sequence[str] = (), keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Probability of success per row; no row looks at another."""
    out = model.transform(prepare(rows, rates))
    p = vector_to_array("probability")[1]
    return out.select(*keep, clip_probability(p).alias(SCORE))


def format_sample(df: DataFrame, n: int = 5, by: str = "row_id") -> DataFrame:
    """First rows by id for a look at the format."""
    return df.orderBy(by).limit(n)
