"""Streams of files: landing rows arrival by arrival, and running a stream over what has landed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mound.operators.attach import settle, shared_folder


def follow(like: DataFrame, path: str, **options: str) -> DataFrame:
    """A stream of the Parquet files that land in ``path``, with the schema of ``like``."""
    return like.sparkSession.readStream.schema(like.schema).options(**options).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed since the last run to Parquet at ``path``, then stop.

    Run again with the same folders it goes on where it stopped, also after a failure: offsets and
    state are in ``checkpoint``, and the sink takes every micro-batch once.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def replay(rows: DataFrame, arrival: Column, operator: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """What ``operator`` emits when ``rows`` land in the order of ``arrival``, the stream restarted after each landing.

    All rows of one arrival land together and are one micro-batch. There are as many
    restarts as arrivals, so these are few: files a day or a week, not rows.
    """
    spark = rows.sparkSession
    base = folder or f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    landing, out, checkpoint = (f"{base}/{x}" for x in ("landing", "out", "checkpoint"))
    dealt = settle(rows.withColumn("__arrival", arrival))
    for r in dealt.select("__arrival").distinct().orderBy("__arrival").collect():
        part = dealt.filter(F.col("__arrival").eqNullSafe(F.lit(r[0]))).drop("__arrival")
        part.write.mode("append").parquet(landing)
        drain(operator(follow(part, landing)), out, checkpoint)
    return spark.read.parquet(out)
