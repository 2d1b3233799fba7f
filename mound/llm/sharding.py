"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank
is ``(rank - 1/2) / rows of the source``, and in that order every stretch holds the sources
in their overall proportion. Equal cuts of the order are the shards.

Neither ranking puts a source or the whole order into one task. A source is cut by ranges of
the hash into its share of ``BLOCKS`` blocks, or more so that none has over about ``BLOCK``
rows; a window numbers a block, and the counts of blocks, a row for each, are summed before it. The global order is cut by ranges of the
fractional rank, which hold equally many rows by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.llm.tables import row_hash, settle, text_of

SHARDS = 16
SEED = 11
BLOCKS = 4_096
BLOCK = 100_000


def _numbered(rows: DataFrame, block: list[str], order: list[Column], name: str, within: list[str]) -> DataFrame:
    """Number rows from 1 in the order of ``within``'s blocks and, inside a block, of ``order``."""
    counts = rows.groupBy(*within, *block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*within, *block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [*within, *block]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    same = [F.col(f"r.{k}") == F.col(f"c.{k}") for k in keys]
    joined = rows.withColumn("_at", at).alias("r").join(counts.alias("c"), same)
    return joined.select("r.*", (F.col("_before") + F.col("_at")).alias(name)).drop("_at")


def assign(rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, block: int = BLOCK) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``source`` and ``_h``, a hash that orders a source's rows.

    Row counts of shards differ by one at most; slots of a shard run from 0 without gaps.
    Null sources are one source. Rows of equal hash are ordered by their other columns, so
    only equal rows can change places.
    """
    ties = [F.col(f"`{c}`") for c in rows.columns if c not in ("_h", "source")]
    rows = rows.withColumn("_of", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    per = settle(rows.groupBy("_of").agg(F.count("*").alias("_rows")))
    total = per.agg(F.sum("_rows")).first()[0] or 0
    # Half of the hash is enough for cutting, and keeps the product inside 64 bits.
    parts = max(blocks, -(-total // block))
    own = F.ceil(F.col("_rows") * parts / max(1, total))
    part = F.shiftright((F.shiftright("_h", 32) + F.lit(2**31)) * own, 32)
    rows = rows.join(per, "_of").withColumn("_part", part)
    rows = _numbered(rows, ["_part"], [F.col("_h"), *ties], "_rank", ["_of"])
    rows = settle(rows.withColumn("_f", (F.col("_rank") - 0.5) / F.col("_rows")))
    rows = rows.withColumns({"_all": F.lit(0), "_part": F.floor(F.col("_f") * parts)})
    rows = _numbered(rows, ["_part"], [F.col("_f"), F.col("_of"), F.col("_rank")], "_place", ["_all"])
    place = F.col("_place") - 1
    rows = rows.withColumn("shard", F.expr(f"cast((_place - 1) * {shards} div {max(1, total)} as int)"))
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("slot", place - start)


def digest(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (UTF-8 bytes plus 1), ``text_crc32`` and the shuffling hash."""
    text = F.encode(text_of("text"), "UTF-8")
    return docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        row_hash(seed, "doc_id", "text").alias("_h"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Documents' ids, sizes and checksums with ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``rows``; a grown number of shards deals all rows anew, so ``grown_shard`` is null.
    A null text counts as empty. An empty table gives an empty result.
    """
    out = assign(settle(digest(docs, seed)), shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
