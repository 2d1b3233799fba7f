"""Ordered operators that keep one busy key off one task.

A plain window puts every row of a key into one task. Here the rows of a key are cut
into consecutive blocks. Windows run inside (key, block); what a block needs from the
blocks before it comes from one summary row per (key, block), made by a partially
aggregated ``groupBy`` and carried by a window over those summaries.

``levels`` is the order, coarse to fine: the columns of all but the last level name the
block, e.g. ``[["game_date"], ["game_id", "pitch_no", "row_id"]]``. The whole order must
be unique within a key. Block columns are not null by contract. A row with a null in its key
belongs to no key: it is kept, what is carried along the key is null for it, and it is
spread over tasks by hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.operators.attach import attach, settle

Levels = Sequence[Sequence[str]]

# Above this many rows the rows of one key are cut into range blocks.
GROUP_ROWS = 1_000_000
# Rows of one key that a sliding window handles in one group.
BUCKET_ROWS = 4096

# Tasks that rows without a key are spread over, per block.
SPREAD = 1_024

_BEFORE = (Window.unboundedPreceding, -1)


def _block(levels: Levels) -> list[str]:
    return [c for level in levels[:-1] for c in level]


def known(key: Sequence[str]) -> Column:
    """True where no column of the key is null."""
    return reduce(lambda a, c: a & F.col(c).isNotNull(), key, F.lit(True))


def spread(key: Sequence[str], order: Sequence[str]) -> Column:
    """0 for rows with a key, a hash for rows without, to be one more partition column."""
    return F.when(known(key), 0).otherwise(F.pmod(F.xxhash64(*order), F.lit(SPREAD)).cast("int"))


def unspread(columns: Sequence[str]) -> Column:
    """0 for every row, but made of columns, not a literal.

    A literal would be folded into the join's condition and leave its keys, and rows that stand
    dealt out by key, block and ``__spread`` would be shuffled and sorted once more.
    """
    return F.pmod(F.xxhash64(*columns), F.lit(1)).cast("int")


def running(
    df: DataFrame,
    key: Sequence[str],
    levels: Levels,
    sums: dict[str, Column],
    source: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Add sums over the strictly earlier rows of the key; 0 on its first row.

    ``source`` may name a cheaper frame with the same rows for the block totals, ``totals``
    a table of them: key, block and ``__<name>`` for each sum.
    """
    key, block = list(key), _block(levels)
    inside = Window.partitionBy(*key, *block, "__spread").orderBy(*levels[-1]).rowsBetween(*_BEFORE)
    out = df.withColumn("__spread", spread(key, levels[-1])).withColumns(
        {
            name: F.when(known(key), F.coalesce(F.sum(value).over(inside), F.lit(0)))
            for name, value in sums.items()
        }
    )
    if not block:
        return out.drop("__spread")
    if totals is None:
        totals = (df if source is None else source).groupBy(*key, *block).agg(
            *[F.coalesce(F.sum(value), F.lit(0)).alias(f"__{name}") for name, value in sums.items()]
        )
    carried = running(
        totals.filter(known(key)), key, levels[:-1], {f"__before_{name}": F.col(f"__{name}") for name in sums}
    ).select(*key, *block, unspread([*key, *block]).alias("__spread"), *[f"__before_{name}" for name in sums])
    return out.join(carried, [*key, *block, "__spread"], "left").select(
        *[c for c in out.columns if c not in sums and c != "__spread"],
        *[
            (F.col(name) + F.coalesce(f"__before_{name}", F.lit(0))).alias(name)
            for name in sums
        ],
    )


def busy(df: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS) -> list[DataFrame | None]:
    """For each key column the settled values that more than ``limit`` rows have; None if there are none.

    All columns are counted in one pass. A table has ``rows / limit`` values at most.
    """
    counted = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("__n"))
    found = settle(counted.filter(F.col("__n") > limit))
    values = [found.filter(F.col(k).isNotNull()).select(k) for k in keys]
    return [None if v.isEmpty() else v for v in values]


def by_size(
    df: DataFrame,
    key: str,
    found: DataFrame | None,
    plain: Callable[[DataFrame], DataFrame],
    cut: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``plain`` on the rows of keys that one task can take, ``cut`` on those of the ``busy`` ones.

    Rows without a key go with ``plain``.
    """
    if found is None:
        return plain(df)
    few = F.broadcast(found)
    return plain(df.join(few, key, "left_anti")).unionByName(cut(df.join(few, key, "left_semi")))


def neighbour(
    df: DataFrame,
    key: Sequence[str],
    levels: Levels,
    columns: Sequence[str],
    name: str,
    step: int = -1,
) -> DataFrame:
    """Add a struct of ``columns`` from the row before (-1) or after (1) in the key."""
    key, block, order = list(key), _block(levels), list(levels[-1])
    shift = F.lag if step < 0 else F.lead
    inside = Window.partitionBy(*key, *block, "__spread").orderBy(*order)
    out = df.withColumn("__spread", spread(key, order))
    out = out.withColumn(name, F.when(known(key), shift(F.struct(*columns)).over(inside)))
    if not block:
        return out.drop("__spread")
    edge = F.max_by if step < 0 else F.min_by
    edges = df.filter(known(key)).groupBy(*key, *block).agg(
        edge(F.struct(*columns), F.struct(*order)).alias("__edge")
    )
    across = Window.partitionBy(*key).orderBy(*block)
    beyond = edges.select(
        *key, *block, unspread([*key, *block]).alias("__spread"), shift("__edge").over(across).alias("__beyond")
    )
    return out.join(beyond, [*key, *block, "__spread"], "left").select(
        *[c for c in out.columns if c not in (name, "__spread")],
        F.coalesce(name, "__beyond").alias(name),
    )


def last_before(
    df: DataFrame, key: Sequence[str], levels: Levels, value: str, name: str
) -> DataFrame:
    """Add the last non-null ``value`` of the strictly earlier rows of the key."""
    key, block, order = list(key), _block(levels), list(levels[-1])
    inside = Window.partitionBy(*key, *block, "__spread").orderBy(*order).rowsBetween(*_BEFORE)
    out = df.withColumn("__spread", spread(key, order))
    out = out.withColumn(name, F.when(known(key), F.last(value, ignorenulls=True).over(inside)))
    if not block:
        return out.drop("__spread")
    lasts = df.filter(known(key)).groupBy(*key, *block).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last")
    )
    across = Window.partitionBy(*key).orderBy(*block).rowsBetween(*_BEFORE)
    carried = lasts.select(
        *key, *block, unspread([*key, *block]).alias("__spread"),
        F.last("__last", ignorenulls=True).over(across).alias("__carried"),
    )
    return out.join(carried, [*key, *block, "__spread"], "left").select(
        *[c for c in out.columns if c not in (name, "__spread")],
        F.coalesce(name, "__carried").alias(name),
    )


def sliding(
    df: DataFrame,
    key: Sequence[str],
    ordinal: str,
    width: int,
    frames: Callable[[Window], dict[str, Column]],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Windows over at most ``width`` preceding rows, exact for any aggregate.

    ``ordinal`` numbers the rows of a key from 0. Rows are cut into buckets of it; the
    last ``width`` rows of a bucket are sent to the next one as well, and dropped there
    after the window. ``frames`` gets the bucket's window and returns the new columns.
    """
    size = max(bucket_rows, width)
    own = F.floor(F.col(ordinal) / F.lit(size))
    tail = F.pmod(F.col(ordinal), F.lit(size)) >= size - width
    copies = df.withColumn("__own", own).withColumn(
        "__bucket",
        F.explode(F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))),
    )
    window = Window.partitionBy(*key, "__bucket").orderBy(ordinal)
    return (
        copies.withColumns(frames(window))
        .filter(F.col("__bucket") == F.col("__own"))
        .drop("__own", "__bucket")
    )


def split_if_large(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    limit: int = GROUP_ROWS,
    block: Sequence[str] = (),
) -> tuple[DataFrame, list[list[str]]]:
    """Levels for a key without a coarse order column, or with one that may not do.

    The largest group of key and ``block`` (leading order columns) is counted first. If
    one task can take it, that block stands. Otherwise rows are range-partitioned by key
    and order, which cuts a large key wherever a partition ends, and the partition number
    becomes the block. Range bounds come from a sample, so the placed rows are settled
    before anything reads them twice.
    """
    sizes = df.groupBy(*key, *block).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    if largest <= limit:
        rest = [c for c in order if c not in block]
        return df, [list(block), rest] if block else [rest]
    # A given number of parts: adaptive execution would merge small ones again.
    parts = math.ceil(total / limit)
    placed = df.repartitionByRange(parts, *key, *order)
    return settle(placed.withColumn("__part", F.spark_partition_id())), [["__part"], list(order)]


def number_rows(df: DataFrame, key: Sequence[str], levels: Levels, name: str) -> DataFrame:
    """Add the position of a row in its key, first = 1."""
    counted = running(df, key, levels, {name: F.lit(1)})
    return counted.withColumn(name, F.col(name) + 1)


# Quantile blocks per doubling of a value.
OCTAVE_BLOCKS = 256


def quantiles(
    df: DataFrame, group: Sequence[str], columns: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Exact interpolated quantiles, one row per group and column.

    The first pass counts values per block of their logarithm, whatever their range. Only
    the few blocks that hold a wanted rank are looked into by the second pass, where equal
    values collapse before the shuffle. No group is sorted as a whole, and a block with too
    many different values is cut again.
    """
    # As one struct the group also matches itself in joins where a column is null.
    labels = [F.struct(*group).alias("__group")] if group else []
    key = (["__group"] if group else []) + ["column"]
    block = ["sign", "size"]
    stacked = F.array(
        *[
            # NaN is not a value here.
            F.struct(
                F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")
            )
            for c in columns
        ]
    )
    # Logarithm and floor never change the order of two values of one sign.
    octave = F.log2(F.abs("value")) * OCTAVE_BLOCKS
    values = (
        df.select(*labels, F.explode(stacked).alias("__c"))
        .select(*key[:-1], "__c.*")
        .dropna(subset="value")
        .withColumn("sign", F.signum("value").cast("int"))
        .withColumn("size", F.when(F.col("sign") == 0, 0).otherwise(F.col("sign") * F.floor(octave)))
    )

    def ranks(p: float) -> tuple[Column, Column, Column]:
        position = F.lit(float(p)) * (F.col("total") - 1)
        return F.floor(position), F.ceil(position), position - F.floor(position)

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    whole = Window.partitionBy(*key)
    blocks = values.groupBy(*key, *block).agg(F.count("*").alias("n")).withColumns(
        {
            "before": F.coalesce(F.sum("n").over(whole.orderBy(*block).rowsBetween(*_BEFORE)), F.lit(0)),
            "total": F.sum("n").over(whole),
        }
    )
    wanted = F.lit(False)
    for p in probs:
        low, high, _ = ranks(p)
        wanted = wanted | holds(low) | holds(high)
    blocks = settle(blocks.filter(wanted).drop("n").withColumnRenamed("before", "skipped"))
    chosen = settle(
        attach(values, blocks, key + block, "inner", settled=True)
        .groupBy(*key, *block, "value", "skipped", "total")
        .agg(F.count("*").alias("n"))
    )
    chosen, levels = split_if_large(chosen, key + block, ["value"])
    ranked = running(chosen, key + block, levels, {"before": F.col("n")})
    ranked = ranked.withColumn("before", F.col("before") + F.col("skipped"))
    picked, final = [], []
    for i, p in enumerate(probs):
        low, high, share = ranks(p)
        picked += [
            F.max(F.when(holds(rank), F.col("value"))).alias(f"__{side}{i}")
            for side, rank in (("lo", low), ("hi", high))
        ]
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        final.append((lo + (hi - lo) * share).alias(f"q{round(p * 100):02d}"))
    out = ranked.groupBy(*key, "total").agg(*picked)
    return out.select(*[f"__group.{c}" for c in group], "column", *final)
