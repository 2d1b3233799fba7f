"""Operators on streams. Each takes and returns a streaming DataFrame; sources and sinks are the caller's.

Rows between two triggers are one micro-batch. What an operator keeps from one to the next is
state of bounded size: a row of counters for each player, open days, ids not older than the delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mound.functions.scalars import safe_rate
from mound.operators import asof
from mound.operators.ordered import spread
from mound.plans import model as scoring_model

_AT, _TIE, _SPREAD = "__at", "__tie", "__spread"


def live_counters(stream: DataFrame, key: str, ts: str, tie: str, outcomes: dict[str, Column], prefix: str = "live") -> DataFrame:
    """Add the key's count and outcome rates over its strictly earlier rows, as each row comes.

    Rows of a micro-batch are sorted by ``ts`` and ``tie``; between batches a key keeps its last
    place in that order, its count and its outcome sums. A row at or before that place came too late:
    what was emitted for later rows stands, so it is refused (``<prefix>_refused`` is true, its columns
    are null) and counted nowhere; so is a row without ``ts`` or ``tie``. Rows without a key are kept, spread
    over tasks, with null columns. Every row of the stream comes out once. A key's rows of one micro-batch
    are sorted in one task: bound the batch (``maxBytesPerTrigger``, ``maxFilesPerTrigger``).
    """
    names, columns = list(outcomes), stream.columns
    counters = [f"__{n}" for n in names]
    rows = stream.withColumns(
        {_AT: F.unix_micros(F.col(ts).cast("timestamp")), _TIE: F.col(tie).cast("string" if stream.schema[tie].dataType.simpleString() == "string" else "long")}
        | {c: F.coalesce(v.cast("long"), F.lit(0)) for c, v in zip(counters, outcomes.values())}
        | {_SPREAD: spread([key], [ts, tie])}
    )
    tie_kind = rows.schema[_TIE].dataType.simpleString()
    found = [f"{prefix}_n", *(f"{prefix}_{n}_k" for n in names)]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema]
    state_kind = f"at long, tie {tie_kind}, n long, " + ", ".join(f"k{i} long" for i in range(len(names)))

    def each(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames), ignore_index=True)
        out = {c: batch[c].array for c in columns}
        if group[0] is None or pd.isna(group[0]):
            yield pd.DataFrame(out | {f"{prefix}_refused": False} | dict.fromkeys(found))
            return
        at, last, *sums = state.get if state.exists else (None, None, 0, *[0] * len(names))
        when, tie = batch[_AT].to_numpy(), batch[_TIE].to_numpy()
        # A group has few rows and there are many groups: arrays, as each call on a frame costs more than its rows.
        if when.dtype == tie.dtype == np.int64:
            order, fresh = np.lexsort((tie, when)), np.ones(len(when), bool)
        else:
            order = batch.sort_values([_AT, _TIE]).index.to_numpy()
            fresh = ~(pd.isna(when) | pd.isna(tie))
        if at is not None:
            fresh[fresh] = [(x, y) > (at, last) for x, y in zip(when[fresh].tolist(), tie[fresh].tolist())]
        out[f"{prefix}_refused"] = ~fresh
        whole = []
        for name, value, so_far in zip(found, [fresh, *(batch[c].to_numpy() for c in counters)], sums):
            own = np.where(fresh, value, 0).astype(np.int64)
            before = np.empty(len(own), np.int64)
            before[order] = so_far + np.cumsum(own[order]) - own[order]
            out[name] = pd.arrays.IntegerArray(before, ~fresh)
            whole.append(int(so_far + own.sum()))
        if fresh.any():
            end = order[fresh[order]][-1]
            state.update((int(when[end]), tie[end] if tie_kind == "string" else int(tie[end]), *whole))
        yield pd.DataFrame(out, copy=False)

    ddl = ", ".join([*kinds, f"{prefix}_refused boolean", *(f"{c} long" for c in found)])
    counted = rows.groupBy(key, _SPREAD).applyInPandasWithState(each, ddl, state_kind, "append", GroupStateTimeout.NoTimeout)
    rates = {f"{prefix}_{n}_rate": safe_rate(f"{prefix}_{n}_k", f"{prefix}_n") for n in names}
    return counted.withColumns(rates).drop(*found[1:])


def daily_counts(stream: DataFrame, ts: str, delay: str, by: Sequence[str] = (), aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Rows per day (and ``by``), each day once, when the stream is ``delay`` past its end.

    A row comes too late when its day ended by the watermark, the latest ``ts`` of earlier
    micro-batches less ``delay``: it is dropped, as its day may be out already. Days the watermark
    has not passed are not out yet.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, "1 day").alias("__w"), *by).agg(
        F.count("*").alias("n"), *[v.alias(c) for c, v in (aggregates or {}).items()]
    )
    return counted.select(F.col("__w.start").cast("date").alias("day"), *by, "n", *(aggregates or {}))


def unique_rows(stream: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each id once, however often its row is sent again within ``delay``.

    An id is forgotten when the watermark is ``delay`` past its row. Later copies with the row's own
    time are behind the watermark by then and dropped for that; so are first copies later than
    ``delay``, which ``lateness`` measures on landed rows.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(list(key))


def lateness(rows: DataFrame, arrival: str, ts: str) -> float:
    """Seconds by which rows come behind the latest ``ts`` of earlier arrivals, at most; 0 if none does."""
    per = rows.groupBy(arrival).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    # A row an arrival: files, not pitches.
    earlier = Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    found = per.withColumn("before", F.max(F.col("last").cast("timestamp")).over(earlier))
    late = F.unix_micros("before") - F.unix_micros(F.col("first").cast("timestamp"))
    return max(0.0, (found.agg(F.max(late)).first()[0] or 0) / 1e6)


def live_scores(stream: DataFrame, fitted: PipelineModel, rates: Sequence[str] = (), keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Probability for every row as it comes; no state, no row looks at another."""
    return scoring_model.score(fitted, stream, rates, keep)


def with_history(stream: DataFrame, fitted: DataFrame, key: str, period: Sequence[str], fitted_key: str | None = None) -> DataFrame:
    """Attach settled history of strictly earlier periods (``asof.fit_history``) to rows as they come."""
    return asof.join_history_lagged(stream, fitted, key, period, fitted_key)
