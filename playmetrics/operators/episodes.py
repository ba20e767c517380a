"""What players do inside a screen: enter, stay, exit, and runs of one action.

The first-episode rule: a player's episode starts at the first *enter* row.  Later rows have
``k`` (rows since the enter) and ``el`` (seconds since it).  It ends at the first later row that
is an *exit*; or has ``el > stay_limit`` (*timeout*); or has ``k >= loss_window`` while
``el < stay_limit`` (*window*).  Otherwise it is *unfinished*.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import action_is, has_keyword
from ..plans.quantiles import group_stats, widen
from ..plans.timeline import (
    GRAIN,
    FirstSeen,
    Histories,
    LastSeen,
    LinkSum,
    Prev,
    RowNumber,
    RunSum,
    position,
    running,
)
from .frames import top_per_group
from .stats import most_common

Actions = str | Sequence[str]


def repeat_runs(
    events: DataFrame, duration_limit: int | None = 600, top_n: int = 3, grain: int = GRAIN, to_next: bool = False
) -> DataFrame:
    """Each player's longest run per action, the ``top_n`` of them.

    A run is a stretch of rows with one action.  ``repeats`` is its length less one; its
    ``duration``, from the second click to the last, must be under ``duration_limit`` (None: any).
    ``preceding`` is the action before the run.  With ``to_next`` the duration goes from the first click to
    the next action, for a player's last run to its last click.
    """
    changed = lambda before, now: (before["action"] != now["action"]).cast("int")
    placed = running(
        events.select("player", "ts", "event_id", "action"), Prev("before", ("action",)), LinkSum("run", ("action",), changed), grain=grain
    )
    starts = F.coalesce(F.col("before.action") != F.col("action"), F.lit(True))
    placed = placed.withColumn("starts", starts)
    runs = placed.groupBy("player", "run", "action").agg(
        (F.count(F.lit(1)) - 1).alias("repeats"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("last_ts"),
        (F.max("ts") - F.min(F.when(~F.col("starts"), F.col("ts")))).alias("duration"),
        F.max(F.when(F.col("starts"), F.col("before.action"))).alias("preceding"),
    )
    if to_next:
        # The first row of a run ends the run before.
        nexts = placed.where("starts").select("player", (F.col("run") - 1).alias("run"), F.col("ts").alias("next_ts"))
        until = F.coalesce("next_ts", "last_ts") - F.col("start_ts")
        runs = runs.join(nexts, ["player", "run"], "left").withColumn("duration", until)
    runs = runs.where(F.col("repeats") >= 1)
    if duration_limit is not None:
        runs = runs.where(F.col("duration") < duration_limit)
    better = F.struct("repeats", (-F.col("run")).alias("early"))
    best = runs.groupBy("player", "action").agg(
        F.max_by(F.struct("repeats", "duration", "preceding", "start_ts", "run"), better).alias("best")
    )
    flat = best.select("player", "action", "best.*")
    return top_per_group(flat, ["player"], [F.col("repeats").desc(), F.col("run"), F.col("action")], top_n)


def repeat_clicks(
    events: DataFrame, duration_limit: int = 600, top_n: int = 3, grain: int = GRAIN, approx: bool = False
) -> DataFrame:
    """Per action over `repeat_runs`: players, mean and median repeats and duration, and the
    most common preceding action (on a tie the first by name)."""
    runs = repeat_runs(events, duration_limit, top_n, grain)
    # Durations are whole seconds under ``duration_limit``: few different values, like counts.
    stats = widen(
        group_stats(runs, ["action"], ["repeats", "duration"], approx=approx, counts=True),
        ["action"],
        [
            ("repeats", "n", "players"),
            ("repeats", "mean", "mean_repeats"),
            ("repeats", "p50", "median_repeats"),
            ("duration", "mean", "mean_duration"),
            ("duration", "p50", "median_duration"),
        ],
    )
    before = most_common(runs.where(F.col("preceding").isNotNull()), ["action"], "preceding")
    return stats.join(before, "action", "left")


def first_episode(
    events: DataFrame,
    enter: Actions,
    exits: Actions,
    loss_window: int | None = 20,
    stay_limit: int | None = 1500,
    grain: int = GRAIN,
) -> DataFrame:
    """One row per player: how the first episode ended.

    Columns: ``ending`` (exit, window, timeout, unfinished, none), ``enter_ts``, ``end_ts``,
    ``stay_clicks`` (rows strictly inside).  ``None`` switches a limit off.
    """
    return episode_table(events, [(enter, exits)], loss_window, stay_limit, grain).drop("pair")


def _end_kind(is_exit: Column, k: Column, el: Column, loss_window, stay_limit) -> Column:
    kind = F.when(is_exit, F.lit("exit"))
    if stay_limit is not None:
        kind = kind.when(el > stay_limit, F.lit("timeout"))
    if loss_window is not None:
        inside = k >= loss_window
        kind = kind.when(inside & (el < stay_limit) if stay_limit is not None else inside, F.lit("window"))
    return kind


def episode_table(
    events: DataFrame,
    pairs: Sequence[tuple[Actions, Actions]],
    loss_window: int | None = 20,
    stay_limit: int | None = 1500,
    grain: int = GRAIN,
) -> DataFrame:
    """`first_episode` for every (enter, exit) pair in one pass over the rows, with ``pair`` no."""
    seen = [
        FirstSeen(f"_in{i}", F.when(action_is("action", enter), F.col("ts")), numbered=True)
        for i, (enter, _) in enumerate(pairs)
    ]
    rows = running(
        events.select("player", "ts", "event_id", "action"), RowNumber("rn"), *seen, grain=grain
    )
    folded = []
    for i, (_, exits) in enumerate(pairs):
        first = F.col(f"_in{i}")
        k, el = F.col("rn") - first["rn"], F.col("ts") - first["value"]
        kind = F.when(k > 0, _end_kind(action_is("action", exits), k, el, loss_window, stay_limit))
        end = F.struct(F.col("rn"), F.col("ts"), kind.alias("kind"))
        folded.append(F.min(F.when(kind.isNotNull(), end)).alias(f"_end{i}"))
        folded.append(F.min(F.when(first.isNotNull(), first)).alias(f"_first{i}"))
    per_player = rows.groupBy("player").agg(F.max("rn").alias("rows"), F.max("ts").alias("last_ts"), *folded)
    outcomes = []
    for i in range(len(pairs)):
        first, end = F.col(f"_first{i}"), F.col(f"_end{i}")
        outcomes.append(
            F.struct(
                F.lit(i).alias("pair"),
                F.when(first.isNull(), "none")
                .when(end.isNull(), "unfinished")
                .otherwise(end["kind"])
                .alias("ending"),
                first["value"].alias("enter_ts"),
                end["ts"].alias("end_ts"),
                F.when(end.isNotNull(), end["rn"] - first["rn"] - 1)
                .otherwise(F.col("rows") - first["rn"])
                .alias("stay_clicks"),
            )
        )
    return per_player.select("player", "last_ts", F.inline(F.array(*outcomes)))


def ui_stay_actions(
    events: DataFrame, enter: Actions, exits: Actions, grain: int = GRAIN, approx: bool = False
) -> DataFrame:
    """Actions between a player's first enter and the next exit, for players who do exit.

    Per action: players, total, mean and median clicks.
    """
    leaves = action_is("action", exits).cast("int")
    inside = (
        Histories(events.select("player", "ts", "event_id", "action"), grain=grain)
        .add(RowNumber("rn"), FirstSeen("_in", F.when(action_is("action", enter), F.col("ts")), numbered=True))
        .where(F.col("rn") > F.col("_in.rn"))
        .add(RunSum("exits", leaves))
        .done()
    )
    counted = inside.groupBy("player", "action").agg(
        F.count_if(F.col("exits") == 0).alias("clicks"), F.max(F.col("exits") > 0).alias("_left")
    )
    leaver = F.max("_left").over(Window.partitionBy("player"))
    clicks = counted.withColumn("_leaver", leaver).where(F.col("_leaver") & (F.col("clicks") > 0))
    return widen(
        group_stats(clicks, ["action"], ["clicks"], approx=approx, counts=True),
        ["action"],
        [
            ("clicks", "n", "players"),
            ("clicks", "total", "total_clicks"),
            ("clicks", "mean", "mean_clicks"),
            ("clicks", "p50", "median_clicks"),
        ],
    )


def _loss_columns() -> list[Column]:
    entered = F.col("ending") != "none"
    return [
        F.count_if(entered).alias("entered"),
        F.count_if(F.col("ending") == "exit").alias("exited"),
        F.try_divide(F.count_if(entered & (F.col("ending") != "exit")), F.count_if(entered)).alias("loss_rate"),
        F.avg(F.when(entered, F.col("stay_clicks"))).alias("mean_stay_clicks"),
        F.count_if(entered & (F.col("stay_clicks") > 3)).alias("players_over_3"),
    ]


def ui_loss(
    events: DataFrame,
    enter: Actions,
    exits: Actions,
    loss_window: int | None = 20,
    stay_limit: int | None = 1500,
    grain: int = GRAIN,
) -> DataFrame:
    """Share of entering players who do not exit, mean clicks inside, players with more than 3."""
    return first_episode(events, enter, exits, loss_window, stay_limit, grain).agg(*_loss_columns())


def _stay_secs() -> Column:
    counted = F.col("ending").isin("exit", "window")
    return F.when(counted, F.col("end_ts") - F.col("enter_ts")).otherwise(F.lit(0))


def ui_stay_time(
    events: DataFrame,
    enter: Actions,
    exits: Actions,
    loss_window: int | None = 20,
    stay_limit: int | None = 1500,
    grain: int = GRAIN,
) -> DataFrame:
    """Seconds in the screen per player; 0 unless the episode ended by exit or click window."""
    episodes = first_episode(events, enter, exits, loss_window, stay_limit, grain)
    return episodes.select("player", "ending", _stay_secs().alias("stay_secs"))


def ui_stay_time_means(
    events: DataFrame, enter: Actions, exits: Actions, loss_window: int | None = 20, grain: int = GRAIN
) -> DataFrame:
    """Two means of the stay: over normal exits, and over all entries.

    Here there is no time limit and an unfinished episode ends at the player's last row.
    """
    episodes = first_episode(events, enter, exits, loss_window, None, grain)
    stay = F.coalesce("end_ts", "last_ts") - F.col("enter_ts")
    return episodes.agg(
        F.avg(F.when(F.col("ending") == "exit", stay)).alias("mean_exit_secs"),
        F.avg(stay).alias("mean_all_secs"),
    )


def ui_enter_ratio(events: DataFrame, enter: Actions, begin: int, end: int) -> DataFrame:
    """Players with the enter action strictly inside ``(begin, end)`` over players active in it."""
    rows = events.where((F.col("ts") > begin) & (F.col("ts") < end))
    return _enter_counts(rows, [enter]).select("active", F.col("entered0").alias("entered"), _ratio(0))


def ui_enter_ratio_by_day(
    events: DataFrame, enter: Actions, first_day: int, days: int, utc_offset: int = 0
) -> DataFrame:
    """`ui_enter_ratio` of every day from ``first_day`` to ``days`` later, in one pass: ``day_no, active, entered, ratio``.

    Days without a player have a row of zeros with ratio -1.  A row on the first second of a day is in no day.
    """
    since = F.col("ts") - (first_day * 86_400 - utc_offset)
    daily = events.where(since % 86_400 != 0).withColumn("day_no", F.floor(since / 86_400).cast("int"))
    flags = daily.where(F.col("day_no").between(0, days)).groupBy("day_no", "player").agg(
        F.max(action_is("action", enter).cast("int")).alias("entered")
    )
    counted = flags.groupBy("day_no").agg(F.count(F.lit(1)).alias("active"), F.sum("entered").alias("entered"))
    every = events.sparkSession.range(days + 1).select(F.col("id").cast("int").alias("day_no"))
    filled = every.join(counted, "day_no", "left").na.fill(0, ["active", "entered"])
    ratio = F.coalesce(F.try_divide("entered", "active"), F.lit(-1.0))
    return filled.withColumn("ratio", ratio)


def _enter_counts(rows: DataFrame, enters: Sequence[Actions]) -> DataFrame:
    flags = [F.max(action_is("action", e).cast("int")).alias(f"e{i}") for i, e in enumerate(enters)]
    return (
        rows.groupBy("player")
        .agg(*flags)
        .agg(
            F.count(F.lit(1)).alias("active"),
            *[F.coalesce(F.sum(f"e{i}"), F.lit(0)).alias(f"entered{i}") for i in range(len(enters))],
        )
    )


def _ratio(i: int) -> Column:
    return F.when(F.col("active") == 0, F.lit(-1.0)).otherwise(
        F.try_divide(F.col(f"entered{i}"), F.col("active"))
    ).alias("ratio")


def ui_report(
    events: DataFrame,
    pairs: Sequence[tuple[str, str]],
    begin: int,
    end: int,
    loss_window: int | None = 20,
    stay_limit: int | None = 1500,
    grain: int = GRAIN,
) -> DataFrame:
    """Loss, mean stay and enter ratio for a list of (enter, exit) pairs: one row per pair.

    All pairs share one ordered pass over the rows.
    """
    episodes = episode_table(events, pairs, loss_window, stay_limit, grain)
    loss = episodes.groupBy("pair").agg(*_loss_columns(), F.avg(_stay_secs()).alias("mean_stay_secs"))
    rows = events.where((F.col("ts") > begin) & (F.col("ts") < end))
    counts = _enter_counts(rows, [enter for enter, _ in pairs])
    ratios = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("pair"),
                        F.lit(str(enter)).alias("enter"),
                        F.lit(str(leave)).alias("exit"),
                        _ratio(i).alias("enter_ratio"),
                    )
                    for i, (enter, leave) in enumerate(pairs)
                ]
            )
        )
    )
    return ratios.join(loss, "pair")


def ui_click_times(events: DataFrame, action: Actions) -> DataFrame:
    """Clicks of an action per player and the level at the first; players without any left out."""
    return (
        events.where(action_is("action", action))
        .groupBy("player")
        .agg(F.count(F.lit(1)).alias("clicks"), F.min_by("level", position()).alias("first_level"))
    )


def find_payers(
    events: DataFrame,
    keywords: Sequence[str],
    money_limit: int = 100,
    step_limit: int = 5,
    how: str = "substring",
    grain: int = GRAIN,
) -> DataFrame:
    """Players whose money rises by ``money_limit`` soon after a payment action.

    The value at the latest keyword row is compared with each of the next ``step_limit + 1``
    rows; ``steps`` is the distance at the first hit.
    """
    marked = has_keyword("action", keywords) if how == "substring" else action_is("action", list(keywords))
    seen = LastSeen("_kw", F.when(marked, F.col("key_index")), numbered=True)
    steps = F.col("rn") - F.col("_kw.rn")
    return (
        running(
            events.select("player", "ts", "event_id", "action", "key_index"),
            RowNumber("rn"),
            seen,
            grain=grain,
        )
        .where((steps <= step_limit + 1) & (F.col("key_index") - F.col("_kw.value") >= money_limit))
        .groupBy("player")
        .agg(F.min_by(steps, F.col("rn")).cast("bigint").alias("steps"))
    )


def first_pay_view_time(events: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Seconds from a player's first row to the first row with a payment keyword, 0 if never."""
    viewed = F.min(F.when(has_keyword("action", keywords), F.col("ts")))
    return events.groupBy("player").agg(F.coalesce(viewed - F.min("ts"), F.lit(0)).alias("secs"))


def pre_conversion_actions(events: DataFrame, pay_actions: Sequence[str], grain: int = GRAIN) -> DataFrame:
    """Clicks per (player, action) before conversion.

    Conversion is a payment action at which money exceeds its value at the latest row outside
    payment actions (at the player's first row if there is none).  Payment actions are not
    counted; players who never convert keep all rows.
    """
    paying = action_is("action", list(pay_actions))
    money = F.col("key_index")
    converts = paying & (money > F.coalesce("_outside", "_first"))
    return (
        Histories(events.select("player", "ts", "event_id", "action", "key_index"), grain=grain)
        .add(LastSeen("_outside", F.when(~paying, money)), FirstSeen("_first", money))
        .let(_converts=converts.cast("int"))
        .add(RunSum("_done", F.col("_converts")))
        .done()
        .where((F.col("_done") == 0) & ~paying)
        .groupBy("player", "action")
        .agg(F.count(F.lit(1)).alias("clicks"))
    )
