"""Monotone fit as the greatest convex minorant of cumulative sums.

Points in the order of the score have weights ``n`` and sums ``k``. The fitted value of a point is
the slope there of the lower convex hull of the cumulative (n, k). Blocks of points have hulls
of their own, built by an aggregate over a sorted array; the hull of all is the hull of the
blocks' hulls, merged ``FAN`` at a time. Sums are whole numbers and slopes are compared by
products, so pooling does not depend on rounding or on the order of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.operators.attach import settle
from mound.operators.ordered import running

BLOCK = 256
FAN = 64
_HULL = "array<struct<w:bigint,s:bigint>>"


def _turns_up(a: Column, b: Column, c: Column) -> Column:
    """True where the slope from a to b is below that from b to c."""
    d = lambda x, y: (y - x).cast("decimal(19,0)")
    return d(a["s"], b["s"]) * d(b["w"], c["w"]) < d(b["s"], c["s"]) * d(a["w"], b["w"])


def hull(points: Column) -> Column:
    """Lower convex hull of an array of (w, s) sorted by w.

    Of the hull so far a new point keeps the vertices from which the way on to it turns up: these are the first ones.
    """

    def add(kept: Column, p: Column) -> Column:
        stay = F.filter(kept, lambda v, i: (i == 0) | _turns_up(F.get(kept, i - 1), v, p))
        return F.concat(stay, F.array(p)).cast(_HULL)

    return F.aggregate(points.cast(_HULL), F.array().cast(_HULL), add)


def fit(points: DataFrame, most: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Add ``fitted``, the isotonic mean ``k / n``, to rows of ``at``, ``n`` and ``k``.

    ``at`` is unique and from 0 to ``most``, ``n`` above 0. Rows are one a value of ``at``, so ``most``
    bounds all that is ever in one place.
    """
    spark = points.sparkSession
    points = points.withColumn("__block", F.floor(F.col("at") / block).cast("long"))
    summed = running(points, [], [["__block"], ["at"]], {"w": F.col("n"), "s": F.col("k")})
    summed = settle(summed.withColumns({"w": F.col("w") + F.col("n"), "s": F.col("s") + F.col("k")}))
    origin = spark.createDataFrame([(-1, 0, 0)], "__block long, w long, s long")
    every = origin.unionByName(summed.select("__block", "w", "s"))
    hulls = every.groupBy("__block").agg(hull(F.sort_array(F.collect_list(F.struct("w", "s")))).alias("h"))
    parts = most // block + 2
    while parts > 1:
        merged = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__block", "h"))), lambda x: x["h"]))
        hulls = hulls.groupBy(F.floor((F.col("__block") + 1) / fan).cast("long").alias("__next")).agg(hull(merged).alias("h"))
        hulls = hulls.withColumnRenamed("__next", "__block")
        parts = -(-parts // fan)
        if parts > 1:
            hulls = hulls.withColumn("__block", F.col("__block") - 1)
    ends = hulls.select(F.posexplode("h").alias("i", "v"), "h").filter("i > 0")
    before = F.get("h", F.col("i") - 1)
    slope = (F.col("v.s") - before["s"]).cast("double") / (F.col("v.w") - before["w"]).cast("double")
    ends = ends.select(F.col("v.w").alias("w"), slope.alias("slope"))
    on = Window.orderBy("w").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = summed.join(ends, "w", "left").withColumn("fitted", F.first("slope", ignorenulls=True).over(on))
    return out.drop("__block", "w", "s", "slope")
