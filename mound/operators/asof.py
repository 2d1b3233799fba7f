"""Point-in-time features: what was known just before each pitch."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.functions.scalars import safe_rate
from mound.operators.attach import attach, settle
from mound.operators.ordered import (
    BUCKET_ROWS,
    GROUP_ROWS,
    Levels,
    busy,
    by_size,
    known,
    last_before,
    neighbour,
    number_rows,
    running,
    sliding,
    spread,
    unspread,
)
from mound.sources.schema import PITCH_GROUPS

ORDER = ("game_date", "game_id", "pitch_no", "row_id")
# A player's rows are cut by date: a calendar is short, whatever the row count.
LEVELS: Levels = (("game_date",), ("game_id", "pitch_no", "row_id"))
GAME = ("game_date", "game_id")

# Outcome indicator columns of a pitch log, 0 or 1, by the name used in features.
PITCHER_OUTCOMES = {
    "success": "control_success",
    "reverse": "is_reverse",
    "middle": "is_middle",
    "ball": "is_ball",
    "strike": "is_strike",
}
BATTER_OUTCOMES = {"success": "control_success", "middle": "is_middle"}
MIX = PITCH_GROUPS[:3]
# Rows of a task that counts pitches of players and games.
TASK_ROWS = 500_000


def _sums(prefix: str, outcomes: dict[str, str], mix: Sequence[str]) -> dict[str, Column]:
    """Counters behind the rates, as per-row values to add up."""
    sums = {f"asof_{prefix}_n": F.lit(1)}
    sums |= {f"asof_{prefix}_{name}_k": F.col(c).cast("int") for name, c in outcomes.items()}
    if mix:
        known = F.col("pitch_type_group").isNotNull().cast("int")
        sums[f"asof_{prefix}_pitchmix_n"] = known
        for group in mix:
            hit = F.coalesce(F.col("pitch_type_group") == group, F.lit(False)).cast("int")
            sums[f"asof_{prefix}_{group}_k"] = hit
    return sums


def _to_rates(df: DataFrame, prefix: str, outcomes: dict[str, str], mix: Sequence[str]) -> DataFrame:
    rates = {
        f"asof_{prefix}_{name}_rate": safe_rate(f"asof_{prefix}_{name}_k", f"asof_{prefix}_n")
        for name in outcomes
    }
    rates |= {
        f"asof_{prefix}_{group}_rate": safe_rate(
            f"asof_{prefix}_{group}_k", f"asof_{prefix}_pitchmix_n"
        )
        for group in mix
    }
    counters = [f"asof_{prefix}_{name}_k" for name in (*outcomes, *mix)]
    return df.withColumns(rates).drop(*counters)


def asof_rates(
    log: DataFrame,
    key: str,
    prefix: str,
    outcomes: dict[str, str],
    mix: Sequence[str] = (),
    levels: Levels = LEVELS,
    source: DataFrame | None = None,
    totals: DataFrame | None = None,
    limit: int | None = None,
    few: Sequence[DataFrame | None] | None = None,
) -> DataFrame:
    """Add count, outcome rates and pitch-mix rates over the player's earlier pitches.

    All columns share one exchange, one sort and one window of the rows; they are null
    for rows without a player. Every player's rows are cut into blocks; with ``limit``, after a count of
    the rows, only those of players of more rows; ``few`` holds those players where they are known (``busy``).
    """
    sums = _sums(prefix, outcomes, mix)
    if limit is None and few is None:
        out = running(log, [key], levels, sums, source, totals)
    else:
        found = (few or busy(log if source is None else source, [key], limit))[0]
        out = _counted(log, key, found, levels, sums, source)
    return _to_rates(out, prefix, outcomes, mix)


def _counted(
    df: DataFrame,
    key: str,
    found: DataFrame | None,
    levels: Levels,
    sums: dict[str, Column],
    source: DataFrame | None = None,
) -> DataFrame:
    """``running`` sums: in one window a key, in blocks for the ``busy`` keys ``found``."""

    def plain(rows: DataFrame) -> DataFrame:
        return running(rows, [key], [[c for level in levels for c in level]], sums)

    def cut(rows: DataFrame) -> DataFrame:
        same = None if source is None else source.join(F.broadcast(found), key, "left_semi")
        return running(rows, [key], levels, sums, same)

    return by_size(df, key, found, plain, cut)


def per_game(
    log: DataFrame, key: str, outcomes: dict[str, str], game: Sequence[str] = GAME
) -> DataFrame:
    """Pitches and outcome counts per player and game."""
    return _dealt(log, key, game).groupBy(key, *game).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(c).cast("int")).alias(f"{name}_k") for name, c in outcomes.items()],
    )


def _dealt(log: DataFrame, key: str, game: Sequence[str]) -> DataFrame:
    """Rows dealt by player and game to tasks of some ``TASK_ROWS``, however many rows there are.

    A player has few pitches in a game: counting before the shuffle would hold nearly every row of a task.
    """
    parts = max(math.ceil(log.count() / TASK_ROWS), log.sparkSession.sparkContext.defaultParallelism)
    return log.repartition(parts, key, *game)


def game_seq(log: DataFrame, key: str, game: Sequence[str] = GAME, limit: int = GROUP_ROWS) -> DataFrame:
    """Ordinal of each game of a player, first = 1; one row per player and game."""
    # Settled: numbering reads it twice.
    games = settle(per_game(log, key, {}, game))
    seq = _counted(games, key, busy(games, [key], limit)[0], [game[:1], game[1:]], {"game_seq": F.lit(1)})
    return seq.withColumn("game_seq", F.col("game_seq") + 1)


def _prev_columns(
    prefix: str, names: Sequence[str], ks: Sequence[int], how: str
) -> dict[str, tuple[str, int]]:
    if how not in ("pooled", "mean"):
        raise ValueError(f"how must be 'pooled' or 'mean', not {how!r}")
    return {f"asof_{prefix}_prev{k}_game_{name}_rate": (name, k) for name in names for k in ks}


def _prev_frames(wanted: dict[str, tuple[str, int]], how: str) -> Callable[[Window], dict[str, Column]]:
    """Previous-game rates over a window of games."""

    def frames(window: Window) -> dict[str, Column]:
        out = {}
        for column, (name, k) in wanted.items():
            last_k = window.rowsBetween(-k, -1)
            if how == "pooled":
                out[column] = safe_rate(F.sum(f"{name}_k").over(last_k), F.sum("n").over(last_k))
            else:
                out[column] = F.avg(safe_rate(f"{name}_k", "n")).over(last_k)
        return out

    return frames


def _with_prev_games(
    games: DataFrame,
    key: str,
    prefix: str,
    names: Sequence[str],
    ks: Sequence[int],
    how: str,
    bucket_rows: int,
) -> DataFrame:
    """Add previous-game rates to a per-game table that has a 0-based ``game_seq``."""
    frames = _prev_frames(_prev_columns(prefix, names, ks, how), how)
    return sliding(games, [key], "game_seq", max(ks), frames, bucket_rows)


def prev_games(
    log: DataFrame,
    key: str,
    prefix: str,
    outcomes: dict[str, str],
    ks: Sequence[int] = (1, 3, 5),
    how: str = "pooled",
    game: Sequence[str] = GAME,
    bucket_rows: int = BUCKET_ROWS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Outcome rates over the player's last k games, one row per player and game.

    ``how="pooled"`` divides summed counts, ``how="mean"`` averages per-game rates.
    Fewer than k earlier games: those there are; none: null. Players of more than ``limit`` games are cut into buckets.
    """
    wanted = _prev_columns(prefix, list(outcomes), ks, how)
    games = settle(per_game(log, key, outcomes, game))

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(key).orderBy(*game)
        return rows.filter(known([key])).withColumns(_prev_frames(wanted, how)(window)).select(key, *game, *wanted)

    def cut(rows: DataFrame) -> DataFrame:
        rows = running(rows, [key], [game[:1], game[1:]], {"game_seq": F.lit(1)})
        return _with_prev_games(rows, key, prefix, list(outcomes), ks, how, bucket_rows).select(key, *game, *wanted)

    return by_size(games, key, busy(games, [key], limit)[0], plain, cut)


def game_features_to_pitches(
    log: DataFrame, games: DataFrame, key: str, game: Sequence[str] = GAME
) -> DataFrame:
    """Give every pitch the values of its player's game."""
    return log.join(games, [key, *game], "left")


def asof_features(
    log: DataFrame,
    ks: Sequence[int] = (1, 3, 5),
    how: str = "pooled",
    bucket_rows: int = BUCKET_ROWS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add all 19 as-of columns of pitcher and batter.

    Rows are shuffled twice: by batter, whose few counters come first, and by pitcher. One pass counts
    the rows of every player before that. A player of at most ``limit`` rows is one window; the rows of others are
    cut into blocks, which the totals of earlier blocks are joined to. Rows without a pitcher or a batter have
    null columns of that player.
    """
    pitchers, batters = busy(log, ["pitcher_id", "batter_id"], limit)
    batter = _sums("batter", BATTER_OUTCOMES, ())
    out = _counted(log, "batter_id", batters, LEVELS, batter, log)
    counters = list(batter)

    def cut(rows: DataFrame) -> DataFrame:
        same = log if pitchers is None else log.join(F.broadcast(pitchers), "pitcher_id", "left_semi")
        return _pitcher_in_blocks(rows, same, ks, how, bucket_rows)

    if how == "pooled":
        out = by_size(out, "pitcher_id", pitchers, lambda rows: _pitcher_in_windows(rows, ks), cut)
    else:
        out = _pitcher_in_blocks(out, log, ks, how, bucket_rows)
    out = _to_rates(out, "pitcher", PITCHER_OUTCOMES, MIX)
    names = [c for c in out.columns if c not in counters]
    return _to_rates(out.select(*names, *counters), "batter", BATTER_OUTCOMES, ())


RECENT = ("success", "middle")


def _pitcher_in_windows(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Add previous-game rates and counters of the pitcher, all rows of one in one window."""
    key = "pitcher_id"
    sums = _sums("pitcher", PITCHER_OUTCOMES, MIX)
    names = _prev_columns("pitcher", RECENT, ks, "pooled")
    whole = Window.partitionBy(key, "__spread")
    inside = Window.partitionBy(key, "__spread", *GAME).orderBy("pitch_no", "row_id")
    earlier = (Window.unboundedPreceding, -1)
    out = rows.withColumn("__spread", spread([key], ["row_id"]))
    before = whole.orderBy(*ORDER).rowsBetween(*earlier)
    out = out.withColumns({f"__{c}": F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in sums.items()})
    # A game without a date or id follows no other one.
    out = out.withColumns({f"__own_{c}": F.first(f"__{c}").over(inside) for c in sums})
    out = out.withColumn("__game", F.dense_rank().over(whole.orderBy(*GAME)))
    placed = known(GAME)
    last = {k: whole.orderBy("__game").rangeBetween(-k, -1) for k in ks}
    hit = {name: F.col(PITCHER_OUTCOMES[name]).cast("int") for name in RECENT}
    prev = {
        column: safe_rate(F.coalesce(F.sum(hit[name]).over(last[k]), F.lit(0)), F.sum(F.lit(1)).over(last[k]))
        for column, (name, k) in names.items()
    }
    out = out.withColumns(prev)
    counts = {c: F.when(known([key]), F.when(placed, F.col(f"__{c}")).otherwise(F.col(f"__{c}") - F.col(f"__own_{c}"))) for c in sums}
    return out.select(
        *rows.columns,
        *[F.when(known([key]) & placed, F.col(c)).alias(c) for c in names],
        *[v.alias(c) for c, v in counts.items()],
    )


def _pitcher_in_blocks(
    rows: DataFrame, log: DataFrame, ks: Sequence[int], how: str, bucket_rows: int
) -> DataFrame:
    """Add previous-game rates and counters of the pitcher, a window a game.

    Counts before a game, the game's ordinal and the previous-game rates live in one table of a row per
    pitcher and game, which meets the rows in the shuffle their own window needs.
    """
    key = "pitcher_id"
    sums = _sums("pitcher", PITCHER_OUTCOMES, MIX)
    totals = settle(
        _dealt(log, key, GAME).groupBy(key, *GAME).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"__{c}") for c, v in sums.items()])
    )
    before = {f"__before_{c}": F.col(f"__{c}") for c in sums}
    games = running(totals, [key], [GAME[:1], GAME[1:]], before | {"game_seq": F.lit(1)})
    games = games.withColumns(
        {"n": F.col("__asof_pitcher_n")}
        | {f"{name}_k": F.col(f"__asof_pitcher_{name}_k") for name in RECENT}
    )
    games = _with_prev_games(games, key, "pitcher", RECENT, ks, how, bucket_rows)
    prev = list(_prev_columns("pitcher", RECENT, ks, how))
    games = games.select(key, *GAME, *before, *prev)

    inside = (
        Window.partitionBy(key, *GAME, "__spread")
        .orderBy("pitch_no", "row_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumn("__spread", spread([key], ["row_id"])).withColumns(
        {c: F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in sums.items()}
    )
    games = games.withColumn("__spread", unspread([key]))
    out = out.join(games, [key, *GAME, "__spread"], "left").withColumns(
        {
            c: F.when(F.col(key).isNotNull(), F.col(c) + F.coalesce(f"__before_{c}", F.lit(0)))
            for c in sums
        }
    )
    return out.select(*rows.columns, *prev, *sums)


def _in_blocks(log: DataFrame, order: Sequence[str], block_rows: int) -> tuple[DataFrame, Levels]:
    """Cut a game every ``block_rows`` values of its first order column, a number."""
    part = F.floor(F.col(order[0]) / F.lit(block_rows))
    return log.withColumn("__part", part), [["__part"], list(order)]


def pitch_no(
    log: DataFrame,
    game: str = "game_id",
    order: Sequence[str] = ORDER[2:],
    name: str = "pitch_no",
    block_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the number of the pitch within its game, whatever gaps ``order`` has."""
    log, levels = _in_blocks(log, order, block_rows)
    return number_rows(log, [game], levels, name).drop("__part")


def pitch_of_pa(
    log: DataFrame,
    game: str = "game_id",
    order: Sequence[str] = ORDER[2:],
    turn: Sequence[str] = ("inning", "top_bottom", "batter_id"),
    block_rows: int = BUCKET_ROWS,
    limit: int | None = None,
) -> DataFrame:
    """Add the appearance number within the game and the pitch number within it.

    A new appearance starts where inning, half or batter differs from the row before. A segmented scan: inside a
    block of a game one window numbers rows, appearances and the row an appearance began at, as if nothing came
    before. Blocks are summed up to (first and last turn, rows, changes, row of the last change),
    settled, and carried along the game once; what was carried is added to the rows of
    each block. So the log is read twice, whatever the columns. Null for rows without a game.
    With ``limit``, after a count of the rows, only games of more rows are cut: others are one window, read and shuffled once.
    """
    if limit is not None:

        def plain(rows: DataFrame) -> DataFrame:
            return _appearances(rows, game, order, turn)

        def cut(rows: DataFrame) -> DataFrame:
            return pitch_of_pa(rows, game, order, turn, block_rows)

        return by_size(log, game, busy(log, [game], limit)[0], plain, cut)
    log, levels = _in_blocks(log, order, block_rows)
    block = [game, "__part"]
    inside = Window.partitionBy(*block, "__spread").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def scanned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"__spread": spread([game], order), "__turn": F.struct(*turn)})
        rows = rows.withColumns({"__row": F.row_number().over(inside), "__prev": F.lag("__turn").over(inside)})
        changed = F.col("__prev").isNotNull() & ~F.col("__prev").eqNullSafe(F.col("__turn"))
        rows = rows.withColumn("__change", changed.cast("int"))
        return rows.withColumns(
            {
                "__changes": F.sum("__change").over(so_far),
                "__begun": F.max(F.when(F.col("__change") == 1, F.col("__row"))).over(so_far),
            }
        )

    narrow = log.select(game, "__part", *order, *[c for c in turn if c not in (game, *order)])
    blocks = scanned(narrow.filter(F.col(game).isNotNull())).groupBy(*block).agg(
        F.min_by("__turn", "__row").alias("first"),
        F.max_by("__turn", "__row").alias("last"),
        F.count("*").alias("rows"),
        F.sum("__change").alias("changes"),
        F.max("__begun").alias("begun"),
    )
    along = Window.partitionBy(game).orderBy("__part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    new = ~F.lag("last").over(along).eqNullSafe(F.col("first"))
    blocks = blocks.withColumns({"__new": new.cast("int"), "__rows": F.coalesce(F.sum("rows").over(earlier), F.lit(0))})
    # The last row of the game so far at which an appearance began: by a change inside a block, or at its first row.
    start = F.col("__rows") + F.coalesce("begun", F.when(F.col("__new") == 1, F.lit(1)))
    carried = blocks.withColumns(
        {
            "__turns": F.coalesce(F.sum(F.col("__new") + F.col("changes")).over(earlier), F.lit(0)) + F.col("__new"),
            "__since": F.when(F.col("__new") == 1, F.col("__rows") + 1).otherwise(F.max(start).over(earlier)),
        }
    )
    carried = settle(carried.select(*block, unspread([game]).alias("__spread"), "__rows", "__turns", "__since"))
    out = scanned(log).join(carried, [*block, "__spread"], "left")
    began = F.coalesce(F.col("__rows") + F.col("__begun"), F.col("__since"))
    return out.select(
        *[c for c in log.columns if c != "__part"],
        (F.col("__turns") + F.col("__changes")).alias("pa_no"),
        (F.col("__rows") + F.col("__row") - began + 1).alias("pitch_of_pa"),
    )


def _appearances(log: DataFrame, game: str, order: Sequence[str], turn: Sequence[str]) -> DataFrame:
    """``pitch_of_pa`` with all rows of a game in one window."""
    inside = Window.partitionBy(game, "__spread").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumns({"__spread": spread([game], order), "__turn": F.struct(*turn)})
    rows = rows.withColumns({"__row": F.row_number().over(inside), "__prev": F.lag("__turn").over(inside)})
    changed = F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(F.col("__turn"))
    rows = rows.withColumn("__change", changed.cast("int"))
    begun = F.max(F.when(F.col("__change") == 1, F.col("__row"))).over(so_far)
    # As in blocks, rows without a game or a number have none.
    counts = {"pa_no": F.sum("__change").over(so_far), "pitch_of_pa": (F.col("__row") - begun + 1).cast("long")}
    return rows.select(*log.columns, *[F.when(known([game, order[0]]), v).alias(c) for c, v in counts.items()])


def count_outcome(
    log: DataFrame,
    game: str = "game_id",
    order: Sequence[str] = ORDER[2:],
    turn: Sequence[str] = ("inning", "top_bottom", "batter_id"),
    block_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``count_outcome``: what the pitch did to the count, read from the next pitch of the appearance.

    ``ball`` or ``strike`` where that count alone is one higher, ``same`` where neither is (a foul with two strikes),
    null on the last pitch of an appearance, where counts are missing, and where they jump. It settles
    after the pitch: a label of history rows, banned as a feature.
    """
    log, levels = _in_blocks(log, order, block_rows)
    counts = ("balls_before", "strikes_before")
    seen = neighbour(log, [game], levels, [*dict.fromkeys((*turn, *counts))], "__next", step=1)
    goes_on = F.col("__next").isNotNull()
    for column in turn:
        goes_on = goes_on & F.col(column).eqNullSafe(F.col(f"__next.{column}"))
    balls, strikes = (F.col(f"__next.{c}") - F.col(c) for c in counts)
    outcome = (
        F.when((balls == 1) & (strikes == 0), "ball")
        .when((balls == 0) & (strikes == 1), "strike")
        .when((balls == 0) & (strikes == 0), "same")
    )
    return seen.withColumn("count_outcome", F.when(goes_on, outcome)).drop("__next", "__part")


def rolling(
    log: DataFrame,
    key: str,
    n: int,
    frames: dict[str, Column],
    levels: Levels = LEVELS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add aggregates over the last ``n`` earlier rows of the key; history or train only.

    ``frames`` holds plain aggregates such as ``F.avg("rel_speed")``.
    """
    numbered = running(log, [key], levels, {"__at": F.lit(1)})
    # Rows without a key have no history and stay by themselves.
    numbered = numbered.withColumn("__at", F.coalesce("__at", F.pmod(F.xxhash64(*levels[-1]), F.lit(2**40)) * (2 * n + 2)))

    def over(window: Window) -> dict[str, Column]:
        return {name: agg.over(window.rowsBetween(-n, -1)) for name, agg in frames.items()}

    return sliding(numbered, [key], "__at", n, over, bucket_rows).drop("__at")


def expanding_by_period(
    log: DataFrame, key: Sequence[str], period: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Per key and period, sums of the period and of all earlier ones (``before_*``)."""
    table = log.groupBy(*key, *period).agg(*[F.sum(v).alias(c) for c, v in sums.items()])
    earlier = (
        Window.partitionBy(*key)
        .orderBy(*period)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return table.withColumns(
        {f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums}
    )


def period_number(period: Sequence[str]) -> Column:
    """Season, or season and month, as one increasing number."""
    season, *month = period
    return F.col(season) * 100 + F.col(month[0]) if month else F.col(season)


def fit_history(
    history: DataFrame,
    key: str,
    period: Sequence[str],
    sums: dict[str, Column],
    own: bool = False,
) -> DataFrame:
    """Cumulative sums per key with the periods they hold for.

    A row holds for periods after ``period`` up to ``next_period``; the last one has no
    end. One row per key and period, settled, ready for ``join_history_lagged``.
    ``own`` keeps the sums of the period itself as ``own_*``.
    """
    w = Window.partitionBy(key).orderBy("period")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    table = (
        # Dealt by key once, for the sums and the window: a key has few rows a period.
        history.withColumn("period", period_number(period))
        .repartition(F.col(key))
        .groupBy(key, "period")
        .agg(*[F.sum(v).alias(f"own_{c}") for c, v in sums.items()])
        .withColumns(
            {c: F.sum(f"own_{c}").over(so_far) for c in sums}
            | {"next_period": F.lead("period").over(w)}
        )
    )
    return settle(table if own else table.drop(*[f"own_{c}" for c in sums]))


def join_history_lagged(
    rows: DataFrame,
    fitted: DataFrame,
    key: str,
    period: Sequence[str],
    fitted_key: str | None = None,
) -> DataFrame:
    """Attach history of strictly earlier periods; at most one match per row.

    A fitted row is repeated for each season it holds in, the last one up to the season
    after all history, where all later rows look as well. So the join is on key and
    season: a busy key spreads over its seasons, and only months within one are compared.
    """
    by_month = len(period) > 1
    season = (lambda c: F.floor(F.col(c) / 100).cast("int")) if by_month else F.col
    last = fitted.agg(F.max(season("period"))).first()[0] or 0
    end = F.coalesce(season("next_period"), F.lit(last + 1))
    start = season("period") if by_month else F.col("period") + 1
    h = fitted.withColumnRenamed(fitted_key or key, "__key").withColumn(
        "__held", F.explode(F.sequence(start, end))
    )
    now = period_number(period)
    match = (
        (F.col(key) == F.col("__key"))
        & (F.least(F.col(period[0]), F.lit(last + 1)) == F.col("__held"))
        & (F.col("period") < now)
        & (F.col("next_period").isNull() | (now <= F.col("next_period")))
    )
    return attach(rows, h, match, settled=True).drop("__key", "__held", "period", "next_period")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    columns: Sequence[str],
    tie: str,
    block: Column | None = None,
) -> DataFrame:
    """Add to each left row ``columns`` of the last right row strictly before it.

    Both sides become one sequence per key, cut into minutes unless ``block`` says
    otherwise: one summary row per key and minute is carried on. At equal time
    left rows come first, so a right row never sees itself; ``tie`` orders right rows of
    the same time.
    """
    block = F.date_trunc("minute", ts) if block is None else block
    value = F.struct(*columns).alias("__value")
    rights = right.select(key, ts, tie, value).withColumn("__side", F.lit(1))
    lefts = left.withColumn("__side", F.lit(0))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("__block", block)
    found = last_before(both, [key], [["__block"], [ts, "__side", tie]], "__value", "__found")
    return found.filter(F.col("__side") == 0).select(
        *[F.col(c) for c in left.columns],
        *[F.col(f"__found.{c}").alias(f"asof_{c}") for c in columns],
    )


def chronological(log: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Total order of the log; range-partitioned, unique by its last column."""
    return log.orderBy(*order)
