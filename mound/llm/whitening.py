"""Whitening of vectors by the leading components of their covariance.

Entries become whole numbers ``floor(SCALE * c)``, so means and deviations are exact. Components
come from Chebyshev-filtered subspace iteration. One pass over the vectors gives VQ for a block
Q of ``components + GUARD`` directions: tasks centre their rows, multiply by Q and by the
transposed rows, and Spark adds up the tasks' dims x block sums. A few Lanczos steps bound the
spectrum from below; every round then applies a Chebyshev polynomial of V (``DEGREE`` passes of
the three-term recurrence) that damps everything between that bound and the block's last
Ritz value, and a QR and a Rayleigh-Ritz step follow. Rounds end when the residual of every
wanted pair is at rounding level, which certifies eigenvalues and directions. What is whitened is
passed over once more for the covariance it really has.

Only sums of dims x block numbers reach the driver, whatever the number of rows. A constant
added to all entries (the contract has 1,000,000) changes neither deviations from the mean nor
covariances, so whole numbers are kept without it and stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mound.llm.tables import settle

SCALE = 64
COMPONENTS = 32
GUARD = 16
DEGREE = 10
LANCZOS = 12
ROUNDS = 100
# Directions with less than this share of the largest eigenvalue count as without variance.
FLAT = 1e-12
# Whole numbers below this stay exact in sums of a batch and as doubles.
SAFE = 2**40


@dataclass
class Whitening:
    """Of vectors of one length: their number, sums, and components with their eigenvalues."""

    dims: int
    n: int
    totals: list[int]
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    residual: float = 0.0
    passes: int = 0
    identity_error: float = 0.0

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n*y - sums, exact: as longs, or as Python's whole numbers where those might not do."""
        if self.n * (int(abs(y).max(initial=0)) + 1) + max(map(abs, self.totals), default=0) < 2**62:
            return y * self.n - np.array(self.totals, dtype=np.int64)
        return y.astype(object) * self.n - np.array(self.totals, dtype=object)

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (self.deviations(y) / self.n).astype(np.float64)

    def projection(self) -> np.ndarray:
        """What a centred row is multiplied by."""
        return self.vectors / np.sqrt(self.values)


def whole(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``dims``, ``y`` of rows whose vector is neither null nor empty and has only finite entries."""
    vec = F.col(vector).cast("array<double>")
    rows = rows.select("vec_id", vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec is not null and size(vec) > 0").filter(fine)
    return rows.select("vec_id", F.size("vec").alias("dims"), F.transform("vec", lambda c: F.floor(c * SCALE)).alias("y"))


def _block(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(table: DataFrame) -> list[Whitening]:
    """Number and sums of the vectors of each length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths):
                y = _block(batch.filter(pa.array(lengths == dims)), int(dims))
                exact = y if abs(y).max() < SAFE and len(y) < 2**20 else y.astype(object)
                yield pa.RecordBatch.from_pydict(
                    {
                        "dims": pa.array(np.full(dims, dims), pa.int32()),
                        "i": pa.array(np.arange(dims), pa.int32()),
                        "n": pa.array(np.full(dims, len(y)), pa.int64()),
                        "s": pa.array([Decimal(int(v)) for v in exact.sum(axis=0)], pa.decimal128(38, 0)),
                    }
                )

    parts = table.select("dims", "y").mapInArrow(each, "dims int, i int, n long, s decimal(38,0)")
    found = parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dims", "i").collect()
    out: dict[int, Whitening] = {}
    for r in found:
        out.setdefault(r.dims, Whitening(r.dims, r.n, [])).totals.append(int(r.s))
    return list(out.values())


def _pass(table: DataFrame, model: Whitening, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of ``work(centred rows)``, a matrix of fixed size."""
    height, width = work(np.zeros((0, model.dims))).shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            if len(batch):
                total += work(model.centred(_block(batch, model.dims)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height * width), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    rows = table.filter(F.col("dims") == model.dims).select("y")
    got = rows.mapInArrow(each, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(height * width)
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(height, width)


def _floor(product: Callable[[np.ndarray], np.ndarray], dims: int, steps: int, rng: np.random.Generator) -> float:
    """A bound below the whole spectrum: the last Ritz value of Lanczos steps less the residual."""
    q = rng.standard_normal(dims)
    basis = [q / np.linalg.norm(q)]
    a, b = [], []
    for _ in range(min(steps, dims)):
        w = product(basis[-1][:, None])[:, 0]
        a.append(float(w @ basis[-1]))
        for _ in range(2):
            for v in basis:
                w = w - (w @ v) * v
        b.append(float(np.linalg.norm(w)))
        if b[-1] <= 1e-12 * max(a):
            break
        basis.append(w / b[-1])
    ritz = np.linalg.eigvalsh(np.diag(a) + np.diag(b[: len(a) - 1], 1) + np.diag(b[: len(a) - 1], -1))
    return max(0.0, float(ritz[0]) - b[-1])


def _filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times q that stays within 1 on [low, cut] and is 1 at ``top``, by its recurrence."""
    half, centre = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - centre)
    before, now = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1.0 / (2.0 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2.0 * new / half) - sigma * new * before
        sigma = new
    return now


def _solve(table: DataFrame, model: Whitening, components: int, guard: int, degree: int, rounds: int) -> None:
    """Components of ``model`` by filtered subspace iteration."""
    dims, rng = model.dims, np.random.default_rng(11)
    wanted, size = min(components, dims), min(components + guard, dims)

    def product(q: np.ndarray) -> np.ndarray:
        model.passes += 1
        return _pass(table, model, lambda x: x.T @ (x @ q)) / model.n

    model.trace = float(_pass(table, model, lambda x: np.array([[(x * x).sum()]]))[0, 0]) / model.n
    if model.trace == 0.0:
        return
    q = np.linalg.qr(rng.standard_normal((dims, size)))[0]
    low = _floor(product, dims, LANCZOS, rng) if size < dims else 0.0
    best, stale = np.inf, 0
    for _ in range(rounds):
        vq = product(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        away = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        # At rounding level residuals stop falling: that, or a few units in the last place, is the certificate.
        stale = stale + 1 if away > best / 2 else 0
        best = min(best, away)
        if away < 4 * np.finfo(float).eps or (away < 1e-13 and stale) or size == dims:
            break
        cut = max(float(values[-1]), values[0] * 1e-8)
        damped = _filtered(product, q, min(low, cut * (1 - 1e-6)), cut, max(float(values[0]), cut * (1 + 1e-6)), degree)
        q = np.linalg.qr(damped / np.maximum(np.linalg.norm(damped, axis=0), np.finfo(float).tiny))[0]
    if away > 1e-12:
        raise ArithmeticError(f"residual {away:.1e} of the largest eigenvalue after {rounds} rounds")
    keep = [i for i in range(wanted) if values[i] > FLAT * values[0]]
    model.values, model.vectors, model.residual = values[keep], q[:, keep], float(away)
    # Signs are free: the largest entry of every component is positive.
    model.vectors *= np.sign(model.vectors[abs(model.vectors).argmax(axis=0), range(len(keep))])


def _deviates(table: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of what is whitened, less the identity."""
    onto = model.projection()

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _pass(table, model, moments) / model.n
    mean = got[-1]
    return float(abs(got[:-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def fit(table: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> list[Whitening]:
    """A whitening for each length of vectors in a settled table of ``whole``.

    Vectors of one length are one list with its own mean and covariance; an empty table has
    none. Repeated vectors count as often as they occur. Components are numbered by falling
    eigenvalue; directions without variance (all of them for a single vector, or equal
    ones) are no components. Raises ``ArithmeticError`` if ``rounds`` do not certify the pairs.
    """
    models = _sums(table)
    for model in models:
        _solve(table, model, components, guard, degree, rounds)
        if len(model.values):
            model.identity_error = _deviates(table, model)
    return models


def apply(table: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (an entry for each component) of the vectors of the model's length.

    ``deviation`` is null where it does not fit into a long. Null and repeated ids stay, a row each.
    """
    kind = table.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto = model.projection() if len(model.values) else np.zeros((model.dims, 0))
        for batch in batches:
            d = model.deviations(_block(batch, model.dims))
            w = (d / model.n).astype(np.float64) @ onto
            if d.dtype != object and model.dims * int(abs(d).max(initial=0)) ** 2 >= 2**62:
                d = d.astype(object)
            total = (d * d).sum(axis=1)
            longs = pa.array([int(v) if v < 2**63 else None for v in total], pa.int64())
            starts = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), longs, pa.ListArray.from_arrays(starts, w.ravel())], ["vec_id", "deviation", "whitened"])

    rows = table.filter(F.col("dims") == model.dims).select("vec_id", "y")
    return rows.mapInArrow(each, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each of its components.

    Columns ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``. Other columns of ``rows`` are not read, whatever their names.
    """
    table = settle(whole(rows, vector))
    out = None
    for model in fit(table, components):
        share = F.array(*[F.lit(float(v) / model.trace) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
        each = apply(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        part = each.select(
            "vec_id",
            (F.col("at") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(share, F.col("at")).alias("explained"),
            F.lit(model.identity_error).alias("identity_error"),
        )
        out = part if out is None else out.unionByName(part)
    kind = table.schema["vec_id"].dataType.simpleString()
    empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.sparkSession.createDataFrame([], empty) if out is None else out
