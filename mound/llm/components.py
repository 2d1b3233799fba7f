"""Connected components of a table of links, by large and small stars.

Every round replaces links by links to the smallest neighbour, first of all larger
neighbours and then of all smaller ones, until a round changes nothing. Minima are partial
aggregates and hubs are met by joins, so no node's neighbours are gathered anywhere. Each
round is written to the shared folder: later rounds depend on files, not on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mound.llm.tables import settle


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node with a link to another.

    ``links`` has columns ``a`` and ``b`` of one orderable type; direction, repeats and
    loops do not matter, and rows with a null are left out.
    """
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    links = settle(links.filter("a != b").select(*ordered).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours of a node go to the node's smallest.
        large = both.filter("b >= a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.filter("m != a").select("a", F.col("m").alias("b"))
        large = settle(large.unionByName(own).filter("a != b").distinct())
        # Smaller neighbours and the node itself go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        new = _state(links)
        if new == state:
            break
        state = new
    ends = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
