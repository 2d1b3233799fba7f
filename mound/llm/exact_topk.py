"""Exact top-k by inner product of integer vectors, with KD-trees per shard.

A median-split tree over a bounded sample deals the vectors to ``REGIONS`` regions, whose
tight boxes come from all their rows. Every query first searches one shard of its own
region; the kth score found there goes with it as a bound, and it asks only the
regions whose box can reach the bound. A shard is a chunk of a region. Its task builds a
KD-tree of median splits with tight boxes and visits nodes best first by the greatest
inner product a box allows, until that is below the kth score so far. All bounds are met with
equality too, so ties are kept and the answer is exact.

Vectors of different lengths never meet. A score that leaves 64 bits is held at their end.
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
SCALE = 1024.0
SAMPLE = 8_192
REGIONS = 32
LEAF = 128
EXACT = 2.0**52


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(1024 x) of every component, whole numbers held as doubles."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * v), posinf=np.finfo(float).max, neginf=-np.finfo(float).max)


def split(v: np.ndarray, leaf: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """KD-tree: nodes (from, to, left, right; -1 for a leaf), row order, and boxes of all nodes."""
    order = np.arange(len(v))
    nodes: list[list[int]] = []
    low, high = [], []

    def add(a: int, b: int) -> int:
        own = v[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        nodes.append([a, b, -1, -1])
        return len(nodes) - 1

    stack = [add(0, len(v))]
    while stack:
        at = stack.pop()
        a, b = nodes[at][:2]
        wide = high[at] / 2 - low[at] / 2
        axis = int(wide.argmax())
        if b - a <= leaf or wide[axis] == 0:
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(v[order[a:b], axis], middle)]
        nodes[at][2], nodes[at][3] = add(a, a + middle), add(a + middle, b)
        stack += nodes[at][2:]
    return [tuple(n) for n in nodes], order, np.array(low), np.array(high)


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest inner product of each query with any point of each box, never too small."""
    with np.errstate(over="ignore", invalid="ignore"):
        up = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        size = abs(queries) @ np.maximum(abs(low), abs(high)).T
    return np.where(size < EXACT, up, np.where(np.isfinite(size), up + size * 1e-12, np.inf))


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, exact, held at the ends of the range."""
    with np.errstate(over="ignore"):
        small = np.abs(v).sum(1).max(initial=0) * np.abs(q).max(initial=0) < EXACT
    if small:
        return (v @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in v]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], dtype=np.int64)


def search(rows: pd.DataFrame, asked: pd.DataFrame, k: int = K, leaf: int = LEAF) -> pd.DataFrame:
    """Best first over the KD-tree of ``rows``: what can be among the ``k`` best of each query."""
    v, ids = cells.stacked(rows.vec), rows.vec_id.to_numpy()
    nodes, order, low, high = split(v, leaf)
    q = cells.stacked(asked.vec)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for query, vec, bound, up in zip(asked.vec_id.to_numpy(), q, asked.bound.to_numpy(dtype=object), reach(q, low, high)):
        kth = None if bound is None or bound != bound else int(bound)
        got_s, got_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        queue = [(-up[0], 0)]
        while queue:
            top, at = heapq.heappop(queue)
            if kth is not None and -top < kth:
                break
            a, b, left, right = nodes[at]
            if left >= 0:
                heapq.heappush(queue, (-up[left], left))
                heapq.heappush(queue, (-up[right], right))
                continue
            own = order[a:b]
            own = own[ids[own] != query]
            s = products(v[own], vec)
            if kth is not None:
                own, s = own[s >= kth], s[s >= kth]
            got_s, got_i = np.concatenate([got_s, s]), np.concatenate([got_i, ids[own]])
            if len(got_s) > k:
                first = np.lexsort((got_i, -got_s.astype(object)))[:k] if (got_s == -(2**63)).any() else np.lexsort((got_i, -got_s))[:k]
                got_s, got_i = got_s[first], got_i[first]
            if len(got_s) == k:
                kth = max(int(got_s.min()), kth if kth is not None else -(2**63))
        out.append((got_s, got_i, query))
    return pd.DataFrame(
        {
            "query_id": np.repeat([o[2] for o in out], [len(o[0]) for o in out]),
            "vec_id": np.concatenate([o[1] for o in out]),
            "score": np.concatenate([o[0] for o in out]),
        }
    )


class Regions:
    """Median splits over a sample, one tree for each vector length."""

    def __init__(self, sample: pd.DataFrame, regions: int):
        self.trees = {int(d): self._grow(quantised(cells.stacked(g.vec)), regions) for d, g in sample.groupby("dims")}

    @staticmethod
    def _grow(v: np.ndarray, regions: int) -> list[list[tuple[int, float]]]:
        """By level: the axis and the value that part each node's rows."""
        levels, parts = [], [v]
        while len(parts) < regions:
            cuts, halves = [], []
            for p in parts:
                axis = int((p.max(0) / 2 - p.min(0) / 2).argmax()) if len(p) else 0
                value = float(np.median(p[:, axis])) if len(p) else 0.0
                cuts.append((axis, value))
                halves += [p[p[:, axis] < value], p[p[:, axis] >= value]]
            levels.append(cuts)
            parts = halves
        return levels

    def place(self, dims: int, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), dtype=np.int32)
        for cuts in self.trees.get(dims, []):
            axis = np.array([c[0] for c in cuts])[at]
            value = np.array([c[1] for c in cuts])[at]
            at = 2 * at + (v[np.arange(len(v)), axis] >= value)
        return at.astype(np.int32)


def _boxes(rows: DataFrame) -> DataFrame:
    """Tight box of each region: ``low`` and ``high`` of every component ``pos``."""

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for key, part in b.groupby(["dims", "cell"]):
                v = cells.stacked(part.vec)
                low, high = v.min(0), v.max(0)
                if key in found:
                    low, high = np.minimum(low, found[key][0]), np.maximum(high, found[key][1])
                found[key] = low, high
        for (dims, cell), (low, high) in found.items():
            yield pd.DataFrame({"dims": dims, "cell": cell, "pos": np.arange(dims), "low": low, "high": high})

    each = rows.select("dims", "cell", "vec").mapInPandas(partly, "dims int, cell int, pos int, low double, high double")
    return each.groupBy("dims", "cell", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def top_k(rows: DataFrame, every: int = EVERY, k: int = K, regions: int = REGIONS, sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each id divisible by ``every`` the ``k`` best other rows.

    Ties go to the smaller ``vec_id``. Null ids, and vectors that are null, empty or hold a null or
    non-finite component, take no part. A repeated id is asked once, and all rows of that id are its own; among
    candidates every repeated row counts. Without candidates or queries the result is empty.
    """
    given = cells.vectors(rows)
    tree = Regions(cells.sampled(given, sample, given.count()), regions)
    points = settle(cells.placed(given, tree.place, quantised))
    sizes = settle(points.groupBy("dims", "cell").agg(F.count("*").alias("n")))
    asked = settle(cells.queries_of(points, every))
    none, one = F.lit(None).cast("long").alias("bound"), F.lit(True).alias("only")
    home = cells.meet(points, sizes, asked.select("*", none, one), lambda a, b: search(a, b, k), "long")
    # A kth score exists only where k were found.
    bounds = cells.best(home, k, F.desc("score")).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = settle(asked.drop("cell").join(bounds, "vec_id", "left"))
    found = sorted(tuple(r) for r in _boxes(points).collect())
    boxes: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
    for dims in {r[0] for r in found}:
        own = [r for r in found if r[0] == dims]
        shape = (-1, dims)
        boxes[dims] = [r[1] for r in own[::dims]], np.array([r[3] for r in own]).reshape(shape), np.array([r[4] for r in own]).reshape(shape)

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, part in b.groupby("dims"):
                names, low, high = boxes[dims]
                up = reach(cells.stacked(part.vec), low, high)
                kth = part.bound.astype(float).fillna(-np.inf).to_numpy()
                row, cell = np.nonzero(up >= (kth - abs(kth) * 1e-15)[:, None])
                out = part.iloc[row]
                yield pd.DataFrame({"vec_id": out.vec_id, "dims": dims, "vec": out.vec, "bound": out.bound, "cell": np.array(names)[cell], "only": False})

    fields = "vec_id long, dims int, vec array<double>, bound long, cell int, only boolean"
    everywhere = cells.meet(points, sizes, bounded.mapInPandas(reachable, fields), lambda a, b: search(a, b, k), "long")
    return cells.best(everywhere, k, F.desc("score"))


# DuckDB: every pair of query and candidate.
ORACLE = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= {K}
"""
