"""Fitted tables: written once, sized by Spark, joined by measured size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A compressed file may be small and its rows many: both are limited.
BROADCAST_ROWS = 1_000_000

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="mound-")
    return _own_folder[app]


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    The result no longer depends on executors that computed it, is the same for all
    readers, and has a size Spark knows from its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str] | Column,
    how: str = "left",
    settled: bool = False,
) -> DataFrame:
    """Join a fitted table onto rows.

    The table is settled and counted. Up to ``BROADCAST_ROWS`` rows Spark may broadcast it,
    if its files are below ``spark.sql.autoBroadcastJoinThreshold`` too: the rows then stay
    where they are. Otherwise both sides are shuffled, and adaptive execution splits the
    partitions of a key with too many rows. A key of columns must be unique in the table,
    or the join would multiply rows: a repeated one is an error.
    """
    if not settled:
        table = settle(table)
    keys = [] if isinstance(on, Column) else list(on)
    counts = [F.count("*").alias("n"), *([F.count_distinct(F.struct(*keys)).alias("u")] if keys else [])]
    size = table.agg(*counts).first()
    if keys and size.n != size.u:
        raise ValueError(f"{size.n - size.u} rows of the fitted table repeat a key of {', '.join(keys)}")
    if size.n > BROADCAST_ROWS:
        table = table.hint("merge")
    return rows.join(table, on if isinstance(on, Column) else list(on), how)


def pitch_group(
    df: DataFrame,
    mapping: DataFrame,
    tagged: str = "tagged_pitch_type",
    auto: str = "auto_pitch_type",
) -> DataFrame:
    """Add ``pitch_type_group``: by the tagged name, else the automatic one, else other.

    ``mapping`` has one row per name: ``pitch_name``, ``pitch_group``.
    """
    mapping = settle(mapping.select("pitch_name", "pitch_group"))
    for source in (tagged, auto):
        named = mapping.select(
            F.col("pitch_name").alias(source), F.col("pitch_group").alias(f"{source}_group")
        )
        df = attach(df, named, [source], settled=True)
    found = F.coalesce(f"{tagged}_group", f"{auto}_group", F.lit("other"))
    return df.withColumn("pitch_type_group", found).drop(f"{tagged}_group", f"{auto}_group")
