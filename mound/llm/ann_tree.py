"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted to a bounded sample of about ``SAMPLE`` vectors; every vector is then
placed into a leaf by descending it. A query walks the tree best bin first: a priority queue holds nodes by the
distance to their centre, leaves come out in that order, and their rows are measured exactly.
How many leaves to visit is calibrated: about ``CALIBRATE`` vectors are answered by brute force over
all rows, and the visits are widened until the mean share of their true neighbours reaches ``RECALL``.

Vectors of different lengths never meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mound.llm import cells
from mound.llm.tables import settle

K = 10
EVERY = 100
SAMPLE = 16_384
BRANCH = 16
DEPTH = 2
ROUNDS = 8
CALIBRATE = 128
RECALL = 0.97


def _centres(v: np.ndarray, branch: int, seed: int) -> np.ndarray:
    """Centres of at most ``branch`` clusters by Lloyd's rounds."""
    different = np.unique(v, axis=0)
    rng = np.random.default_rng(seed)
    c = different[rng.permutation(len(different))[:branch]]
    for _ in range(ROUNDS):
        near = _nearest(v, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (np.square(c).sum(1)[None, :] - 2 * v @ c.T).argmin(1)


class Tree:
    """Centres by node; a node without children is a leaf with a number."""

    def __init__(self, v: np.ndarray, branch: int, depth: int):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(v, branch, depth)

    def _grow(self, v: np.ndarray, branch: int, depth: int) -> int:
        at = len(self.children)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        if depth and len(v) > branch:
            c = _centres(v, branch, at)
            near = _nearest(v, c)
            if len(c) > 1:
                self.centres[at] = c
                self.children[at] = [self._grow(v[near == i], branch, depth - 1) for i in range(len(c))]
        if not self.children[at]:
            self.leaf[at] = self.leaves
            self.leaves += 1
        return at

    def place(self, v: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        out = np.zeros(len(v), dtype=np.int32)
        stack = [(0, np.arange(len(v)))]
        while stack:
            at, rows = stack.pop()
            if not self.children[at]:
                out[rows] = self.leaf[at]
            elif len(rows):
                near = _nearest(v[rows], self.centres[at])
                stack += [(child, rows[near == i]) for i, child in enumerate(self.children[at])]
        return out

    def bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of a query, best bin first."""
        out: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(out) < visits:
            _, at = heapq.heappop(queue)
            if self.leaf[at] >= 0:
                out.append(self.leaf[at])
                continue
            away = np.square(self.centres[at] - q).sum(1)
            for far, child in zip(away.tolist(), self.children[at]):
                heapq.heappush(queue, (far, child))
        return out


def _measured(v: np.ndarray, ids: np.ndarray, query: int, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of some rows: ids and distances, ties to the smaller id."""
    other = ids != query
    far = np.sqrt(np.square(v[other] - vec).sum(1))
    own = ids[other]
    if len(far) > 4 * k:
        some = far <= np.partition(far, k - 1)[k - 1]
        far, own = far[some], own[some]
    first = np.lexsort((own, far))[:k]
    return own[first], far[first]


def search(rows: pd.DataFrame, asked: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The ``k`` nearest of ``rows`` for each query."""
    v, ids = cells.stacked(rows.vec), rows.vec_id.to_numpy()
    out = [(q, *_measured(v, ids, q, x, k)) for q, x in zip(asked.vec_id, asked.vec)]
    return pd.DataFrame(
        {
            "query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]),
            "vec_id": np.concatenate([o[1] for o in out]),
            "score": np.concatenate([o[2] for o in out]),
        }
    )


def brute_force(points: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    """Exact answers of a bounded set of queries, with the ``cell`` of every neighbour."""
    byte = {d: g for d, g in asked.groupby("dims")}
    fields = "query_id long, vec_id long, score double, cell int"

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, part in b.groupby("dims"):
                if dims in byte:
                    part = part.reset_index(drop=True)
                    found = search(part, byte[dims], k)
                    cell = part.drop_duplicates("vec_id").set_index("vec_id").cell
                    yield found.assign(cell=cell.loc[found.vec_id].to_numpy())

    found = points.mapInPandas(partly, fields)
    best = cells.best(found, k, F.col("score")).join(found.select("query_id", "vec_id", "cell").distinct(), ["query_id", "vec_id"])
    return best.select("query_id", "rank", "cell")


def calibrated(trees: dict[int, Tree], truth: pd.DataFrame, asked: pd.DataFrame, recall: float) -> int:
    """The fewest leaf visits whose mean recall over ``asked`` reaches ``recall``."""
    most = max((t.leaves for t in trees.values()), default=1)
    hits = np.zeros(most + 1)
    n = 0
    for _, q in asked.iterrows():
        own = truth[truth.query_id == q.vec_id]
        if len(own):
            place = {leaf: i + 1 for i, leaf in enumerate(trees[q.dims].bins(q.vec, most))}
            # A copy of an id may lie in several leaves: a place is a place.
            np.add.at(hits, own.cell.map(place).to_numpy(), 1 / len(own))
            n += 1
    share = np.cumsum(hits) / max(1, n)
    enough = np.flatnonzero(share >= recall - 1e-9)
    return int(enough[0]) if len(enough) and n else most


def nearest(rows: DataFrame, every: int = EVERY, k: int = K, sample: int = SAMPLE, branch: int = BRANCH, depth: int = DEPTH, recall: float = RECALL, calibrate: int = CALIBRATE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each id divisible by ``every`` its ``k`` nearest found rows.

    Distances are Euclidean in double precision, ties go to the smaller ``vec_id``. A query that has not met
    ``k`` candidates in the calibrated leaves goes on through all leaves. Null ids and vectors that
    are null, empty, zero or hold a null or non-finite component take no part. A repeated id is asked once; among
    candidates every repeated row counts.
    """
    given = cells.vectors(rows).filter(F.exists("vec", lambda x: x != 0))
    n = given.count()
    trees = {int(d): Tree(cells.stacked(g.vec), branch, depth) for d, g in cells.sampled(given, sample, n).groupby("dims")}
    place = lambda dims, v: trees[dims].place(v) if dims in trees else np.zeros(len(v), np.int32)
    points = settle(cells.placed(given, place, lambda v: v))
    sizes = settle(points.groupBy("dims", "cell").agg(F.count("*").alias("n")))
    some = cells.sampled(points, calibrate, n)
    some = some[some.dims.isin(list(trees))].drop_duplicates("vec_id")
    visits = calibrated(trees, brute_force(points, some, k).toPandas(), some, recall) if len(some) else 1
    asked = settle(cells.queries_of(points, every).drop("cell"))

    def walk(queries: DataFrame, first: int | None) -> DataFrame:
        """A row for each query and leaf to ask: the first ones, or all."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                leaves = [trees[d].bins(v, first or trees[d].leaves) if d in trees else [0] for d, v in zip(b.dims, b.vec)]
                at = np.repeat(np.arange(len(b)), [len(x) for x in leaves])
                out = b.iloc[at]
                yield pd.DataFrame({"vec_id": out.vec_id, "dims": out.dims, "vec": out.vec, "cell": [c for x in leaves for c in x]})

        rows = queries.mapInPandas(each, "vec_id long, dims int, vec array<double>, cell int")
        return rows.withColumns({"bound": F.lit(None).cast("double"), "only": F.lit(False)})

    find = lambda a, b: search(a, b, k)
    found = settle(cells.best(cells.meet(points, sizes, walk(asked, visits), find, "double"), k, F.col("score")))
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = settle(asked.join(full, "vec_id", "left_anti"))
    n_short = short.count()
    if n_short and visits < max((t.leaves for t in trees.values()), default=1):
        again = cells.best(cells.meet(points, sizes, walk(short, None), find, "double"), k, F.col("score"))
        kept = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        return kept.unionByName(again)
    return found
