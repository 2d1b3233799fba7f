"""Streams of files against batch results: restarts, late rows, replayed rows, scores."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mound.functions.scalars import safe_rate
from mound.plans import model, streams
from mound.plans.catalog import MODEL_CATEGORIES, MODEL_NUMBERS, MODEL_RATES, QUERIES, _fitted
from mound.streaming import live
from mound.streaming.files import drain, follow, replay
from tests.conftest import SF
from tests.oracle_check import connect, differences

START = datetime(2024, 5, 1)
KIND = "id long, who string, at timestamp, hit int"


def frame(spark, rows):
    """Rows of (id, who, minutes after the start, hit)."""
    return spark.createDataFrame([(i, w, None if m is None else START + timedelta(minutes=m), h) for i, w, m, h in rows], KIND)


def counted(stream):
    return live.live_counters(stream, "who", "at", "id", {"hit": F.col("hit")})


def expected(batches):
    """Plain Python: what each row sees when batches come one after the other."""
    state, out = {}, {}
    for batch in batches:
        known = [r for r in batch if r[1] is not None and r[2] is not None]
        for r in batch:
            if r[1] is None:
                out[r[0]] = (False, None, None)
            elif r[2] is None:
                out[r[0]] = (True, None, None)
        for i, who, minute, hit in sorted(known, key=lambda r: (r[2], r[0])):
            last, n, k = state.get(who, ((-1, -1), 0, 0))
            if (minute, i) <= last:
                out[i] = (True, None, None)
                continue
            out[i] = (False, n, k / n if n else None)
            state[who] = ((minute, i), n + 1, k + (hit or 0))
    return out


BATCHES = [
    [(1, "a", 5, 1), (2, "a", 3, 0), (3, "b", 9, 1), (4, None, 1, 1), (5, "a", None, 1)],
    [(6, "a", 4, 1), (7, "a", 6, 1), (8, "b", 9, None), (9, "b", 12, 0), (10, None, 2, 0)],
    [(11, "b", 12, 1), (12, "a", 60, 0), (13, "a", 61, 0), (14, "c", 1, 1), (15, "b", 9, 1)],
]


def land(spark, folder, rows):
    frame(spark, rows).write.mode("append").parquet(f"{folder}/landing")


def state_of(folder, spark):
    found = spark.read.parquet(f"{folder}/out").collect()
    assert len(found) == len({r.id for r in found})
    return {r.id: (r.live_refused, r.live_n, r.live_hit_rate) for r in found}


def test_counters_go_on_from_the_checkpoint(spark, tmp_path):
    """Every batch is a stream of its own that starts where the one before stopped."""
    base = str(tmp_path)
    for k, batch in enumerate(BATCHES):
        land(spark, base, batch)
        drain(counted(follow(frame(spark, []), f"{base}/landing")), f"{base}/out", f"{base}/checkpoint")
        assert state_of(base, spark) == expected(BATCHES[: k + 1])


def test_batch_without_commit_is_done_again_and_counts_once(spark, tmp_path):
    """A driver lost between the sink and the commit: the batch runs again on the state before it."""
    base = str(tmp_path)
    for batch in BATCHES[:2]:
        land(spark, base, batch)
        drain(counted(follow(frame(spark, []), f"{base}/landing")), f"{base}/out", f"{base}/checkpoint")
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    land(spark, base, BATCHES[2])
    drain(counted(follow(frame(spark, []), f"{base}/landing")), f"{base}/out", f"{base}/checkpoint")
    assert state_of(base, spark) == expected(BATCHES)


def test_several_micro_batches_of_one_run(spark, tmp_path):
    base = str(tmp_path)
    for batch in BATCHES:
        land(spark, base, batch)
    stream = follow(frame(spark, []), f"{base}/landing", maxFilesPerTrigger="1")
    drain(counted(stream), f"{base}/out", f"{base}/checkpoint")
    found = state_of(base, spark)
    # Which file comes first within a landing is open, but all rows are out once and none is counted twice.
    assert set(found) == {r[0] for b in BATCHES for r in b}
    for who in "abc":
        n = sorted(v[1] for i, v in found.items() if v[1] is not None and any(r[0] == i and r[1] == who for b in BATCHES for r in b))
        assert n == list(range(len(n)))


def test_in_order_counters_equal_the_batch_window(spark):
    """Nothing late: the stream gives what a window over the whole table gives."""
    events = streams._events(spark, SF)
    got = replay(events, F.dayofmonth("ts") % 32 > 15, lambda s: live.live_counters(s, "user_id", "ts", "event_id", {"buy": F.col("event_type") == "purchase"}))
    events.createOrReplaceTempView("all_events")
    want = spark.sql(
        "select event_id, count(*) over w as n, sum(cast(event_type = 'purchase' as int)) over w as k from all_events"
        " window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)"
    ).withColumn("rate", safe_rate("k", "n"))
    a = sorted((r.event_id, r.live_n, r.live_buy_rate) for r in got.collect())
    assert a == sorted((r.event_id, r.n, r.rate) for r in want.collect())
    assert got.filter("live_refused").count() == 0


def test_days_close_once_and_late_rows_are_named(spark, tmp_path):
    base = str(tmp_path)
    day = 24 * 60
    batches = [
        [(1, "a", 10, 1), (2, "a", day + 5, 1)],
        # The watermark is a day and five minutes in: the first day is still open at 6 hours' delay.
        [(3, "a", 20, 1), (4, "b", 3 * day, 1)],
        # Now it is 2 days and 18 hours in: the first two days are out, so 5 and 6 are too late, 7 is not.
        [(5, "a", 30, 1), (6, "a", 2 * day - 1, 1), (7, "a", 2 * day + 1, 1)],
        [(8, "b", 9 * day, 1)],
    ]
    late = [0, 0, 2, 0]
    for batch, dropped in zip(batches, late):
        land(spark, base, batch)
        stream = live.daily_counts(follow(frame(spark, []), f"{base}/landing"), "at", "6 hours", [], {"last": F.max("id")})
        query = drain(stream, f"{base}/out", f"{base}/checkpoint")
        progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
        assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == dropped
    found = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").select(F.day("day"), "n", "last").collect())
    assert found == [(1, 2, 3), (2, 1, 2), (3, 1, 7), (4, 1, 4)]


def test_replayed_rows_come_once_and_state_falls(spark, tmp_path):
    base, day = str(tmp_path), 24 * 60
    kept = []
    for k in range(5):
        rows = [(100 * k + i, "a", k * day + i, 1) for i in range(50)]
        again = [(100 * (k - 1) + i, "a", (k - 1) * day + i, 1) for i in range(50)] if k else []
        land(spark, base, [*rows, *again, *rows[:25]])
        stream = live.unique_rows(follow(frame(spark, []), f"{base}/landing"), ["id"], "at", "26 hours")
        query = drain(stream, f"{base}/out", f"{base}/checkpoint")
        kept.append([s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]])
    ids = [r.id for r in spark.read.parquet(f"{base}/out").collect()]
    assert sorted(ids) == [100 * k + i for k in range(5) for i in range(50)]
    # 250 ids went through; what is remembered are those of the last days.
    assert max(v for run in kept for v in run) < 250
    assert kept[-1][-1] < max(kept[-1][0], 200)


def test_lateness(spark):
    rows = [(1, "0", 0, 1), (2, "0", 100, 1), (3, "1", 70, 1), (4, "1", 300, 1), (5, "2", 290, 1)]
    assert live.lateness(frame(spark, rows), "who", "at") == 30 * 60
    assert live.lateness(frame(spark, rows[:1]), "who", "at") == 0
    assert live.lateness(frame(spark, []), "who", "at") == 0


def test_scores_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    """The full model of all features, row by row, with a plan that has no state, window or aggregate."""
    fitted, test = _fitted(spark, SF)
    rows = test.select("row_id", *MODEL_NUMBERS, *MODEL_RATES, *MODEL_CATEGORIES)
    got = replay(rows, F.col("inning") % 3, lambda s: live.live_scores(s, fitted, MODEL_RATES), str(tmp_path))
    want = {r.row_id: r.score for r in model.score(fitted, rows, MODEL_RATES).collect()}
    assert {r.row_id: r.score for r in got.collect()} == want
    assert len(want) == got.count() > 0


@pytest.mark.parametrize("name", sorted(streams.QUERIES))
def test_queries_against_duckdb(spark, name):
    from mound.plans import oracles

    assert differences(QUERIES[name](spark, SF), connect(SF), oracles.build()[name]) == []
