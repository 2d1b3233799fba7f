"""Vectors in cells: what the two vector searches share.

A cell (a region of an index) with more than ``CHUNK`` rows is dealt into chunks by hash, so
a cell that holds a third of all rows is many tasks. Queries meet a chunk in blocks of about
``BLOCK``. A task therefore holds a bounded number of candidates and queries, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.llm.tables import row_hash, settle

CHUNK = 8_192
BLOCK = 2_048
KEY = ("dims", "cell", "chunk", "block")
VECTOR = "vec_id long, dims int, cell int, vec array<double>"
FOUND = "query_id long, vec_id long, score {}"


def vectors(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``dims`` and ``vec`` (doubles) of rows that take part.

    Rows with a null id, a null or empty vector, or a null or non-finite component do not.
    """
    vec = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id is not null and size(vec) > 0").filter(fine)
    return rows.select("vec_id", F.size("vec").alias("dims"), "vec")


def sampled(rows: DataFrame, most: int, n: int) -> pd.DataFrame:
    """About ``most`` rows by hash, on the driver; all of them if ``n``, their count, is not above it."""
    return rows.filter(F.pmod(row_hash(29, "vec_id"), F.lit(max(1, n))) < most).toPandas()


def stacked(vec: pd.Series) -> np.ndarray:
    return np.stack(list(vec)) if len(vec) else np.zeros((0, 0))


def placed(rows: DataFrame, place: Callable[[int, np.ndarray], np.ndarray], change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows with their vector changed and their cell, found by ``place(dims, vectors)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, part in b.groupby("dims"):
                v = change(stacked(part.vec))
                yield pd.DataFrame({"vec_id": part.vec_id.to_numpy(), "dims": dims, "cell": place(dims, v), "vec": list(v)})

    return rows.mapInPandas(each, VECTOR)


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """One row for each ``vec_id`` divisible by ``every``; of a repeated id the smallest vector."""
    some = rows.filter(F.col("vec_id") % every == 0)
    return some.groupBy("vec_id").agg(F.min(F.struct("dims", "vec", "cell")).alias("q")).select("vec_id", "q.*")


def dealt(rows: DataFrame, sizes: DataFrame, asked: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows and queries by ``dims``, ``cell``, ``chunk`` and ``block``.

    A cell has as many blocks as the queries that ask it fill, so a row is copied to those blocks alone and a row of a
    cell that nothing asks goes nowhere.
    """
    asks = asked.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = sizes.select("dims", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    sizes = settle(sizes.join(asks, ["dims", "cell"]))
    hashed = row_hash(31, "vec_id")
    rows = rows.join(sizes, ["dims", "cell"]).withColumn("chunk", F.pmod(hashed, F.col("chunks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.join(sizes, ["dims", "cell"])
    own = F.pmod(hashed, F.col("chunks")).cast("int")
    all_chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    asked = asked.withColumn("chunk", F.explode(F.when(F.col("only"), F.array(own)).otherwise(all_chunks)))
    asked = asked.withColumn("block", F.pmod(row_hash(37, "vec_id"), F.col("blocks")).cast("int"))
    return rows.select(*KEY, "vec_id", "vec"), asked.select(*KEY, "vec_id", "vec", "bound")


def meet(rows: DataFrame, sizes: DataFrame, asked: DataFrame, search: Callable, kind: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Answers of ``search(candidates, queries)`` wherever a query meets a chunk of a cell it asks.

    ``sizes`` has the rows of each ``dims``, ``cell``; ``asked`` a row for each query and cell with ``only``,
    null to ask all chunks of the cell or true to ask a single one.
    """
    rows, asked = dealt(rows, sizes, asked, chunk, block)
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search(left, right) if len(left) and len(right) else empty

    return rows.groupBy(*KEY).cogroup(asked.groupBy(*KEY)).applyInPandas(both, FOUND.format(kind))


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The first ``k`` of each query in the order of ``score``, then of ``vec_id``, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(score, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
