"""Measures per block of active play time.

The clock counts only gaps of at most ``gap`` seconds.  A block is cut at a row that is within
``gap`` of the previous row, once the time counted from the block's first row to the previous
row has reached ``interval``.  The cut row opens the next block and the clock restarts there, so
where a cut falls depends on where the one before fell: the cuts of one player form a chain.

The clock sees only the distinct seconds at which a player acted, so the log is reduced to one
record per (player, second) before the chain is followed.  A history then has at most as many
records as the log has seconds, whatever the number of its rows.  Within one second only the
first row and the later rows can differ, hence the ``head`` flag that joins rows to blocks.
Everything else about a row (deltas, previous actions, clicks) is summed per
(player, second, head) before it meets its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cuts import clock_relay, stay_relay
from ..plans.quantiles import group_stats, widen
from ..plans.stretches import GRAIN, follow
from ..plans.timeline import Prev, position, running
from ..sources.tables import settle
from .sessions import gap_sessions

GAP = 300
SLOT = ["player", "ts", "head"]


def block_map(events: DataFrame, interval: int, gap: int = GAP, grain: int = GRAIN) -> DataFrame:
    """Block of every (player, second, head); ``head`` marks the first row of the second.

    A player with more than ``grain`` rows is followed in stretches by several tasks.
    """
    seconds = events.groupBy("player", "ts").agg(F.count(F.lit(1)).alias("rows"))
    made = "ts bigint, head boolean, block int, cut boolean"
    return follow(seconds, clock_relay(gap, interval), made, ["player"], ["ts"], grain, events.select("player"))


def with_head(rows: DataFrame, prev: str = "before") -> DataFrame:
    """Flag rows that are the first of their second, from a `Prev` column holding ``ts``."""
    return rows.withColumn("head", F.coalesce(F.col(f"{prev}.ts") < F.col("ts"), F.lit(True)))


def _full_blocks(folded: DataFrame, keep_short: bool = False) -> DataFrame:
    """Drop each player's last block: no cut closed it.

    The input has at least one record per (player, block), so the highest block is the open one.
    ``keep_short`` keeps block 0 of players without any cut.
    """
    cuts = F.max("block").over(Window.partitionBy("player"))
    limit = F.greatest(cuts, F.lit(1)) if keep_short else cuts
    return folded.withColumn("_cuts", limit).where(F.col("block") < F.col("_cuts")).drop("_cuts")


def _per_block(
    slots: DataFrame, events: DataFrame, interval: int, gap: int, sums: dict[str, Column], keep_short: bool = False,
    grain: int = GRAIN,
) -> DataFrame:
    """Attach blocks to per-slot records and fold them per (player, block); full blocks only."""
    folded = (
        slots.join(block_map(events, interval, gap, grain), SLOT)
        .groupBy("player", "block")
        .agg(*[value.alias(name) for name, value in sums.items()])
    )
    return _full_blocks(folded, keep_short)


def block_summary(per_player: DataFrame, value: str, approx: bool = False, counts: bool = True) -> DataFrame:
    """Players, min, max, mean and median of ``value`` (a count, if not said) by block number."""
    return widen(
        group_stats(per_player if approx or counts else settle(per_player, "blocks"), ["block"], [value], approx=approx, counts=counts),
        ["block"],
        [
            (value, "n", "players"),
            (value, "min", "min_value"),
            (value, "max", "max_value"),
            (value, "mean", "mean_value"),
            (value, "p50", "median_value"),
        ],
    )


def active_blocks(events: DataFrame, interval: int, gap: int = GAP, grain: int = GRAIN) -> DataFrame:
    """Full blocks of each player: number, first second, last second, clicks."""
    slots = _click_slots(events)
    return _per_block(
        slots,
        events,
        interval,
        gap,
        {"start_ts": F.min("ts"), "end_ts": F.max("ts"), "clicks": F.sum("clicks")},
        grain=grain,
    )


def _click_slots(events: DataFrame) -> DataFrame:
    """Clicks per (player, second, head): no ordering of rows is needed to count them."""
    seconds = events.groupBy("player", "ts").agg(F.count(F.lit(1)).alias("rows"))
    both = F.array(
        F.struct(F.lit(True).alias("head"), F.lit(1).cast("bigint").alias("clicks")),
        F.struct(F.lit(False).alias("head"), (F.col("rows") - 1).alias("clicks")),
    )
    return seconds.select("player", "ts", F.inline(both)).where(F.col("clicks") > 0)


def clicks_by_block(
    events: DataFrame, interval: int, gap: int = GAP, approx: bool = False, grain: int = GRAIN
) -> DataFrame:
    """Rows in each block, summarised over players."""
    return block_summary(active_blocks(events, interval, gap, grain), "clicks", approx)


def _value_slots(events: DataFrame) -> DataFrame:
    """Last index value per (player, second, head)."""
    seconds = events.groupBy("player", "ts").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by("key_index", "event_id").alias("opening"),
        F.max_by("key_index", "event_id").alias("closing"),
    )
    both = F.array(
        F.struct(F.lit(True).alias("head"), F.col("opening").alias("value")),
        F.struct(F.lit(False).alias("head"), F.col("closing").alias("value")),
    )
    return seconds.select("player", "ts", "rows", F.inline(both)).where("head or rows > 1")


def key_value_by_block(
    events: DataFrame, interval: int, gap: int = GAP, keep_short: bool = False, grain: int = GRAIN
) -> DataFrame:
    """Index value of a player just before each cut."""
    last = F.max_by("value", F.struct(F.col("ts"), ~F.col("head")))
    return _per_block(_value_slots(events), events, interval, gap, {"value": last}, keep_short, grain)


def key_growth_by_block(
    events: DataFrame, interval: int, gap: int = GAP, keep_short: bool = False, approx: bool = False, grain: int = GRAIN
) -> DataFrame:
    """Index value just before each cut, summarised by block.

    ``keep_short`` lets players without a full block enter block 0 with their last value.
    """
    return block_summary(key_value_by_block(events, interval, gap, keep_short, grain), "value", approx, counts=False)


def _linked(events: DataFrame, columns: tuple[str, ...], grain: int) -> DataFrame:
    rows = events.select("player", "ts", "event_id", *columns)
    return with_head(running(rows, Prev("before", ("ts", *columns)), grain=grain))


def key_growth_times(
    events: DataFrame, interval: int, gap: int = GAP, grain: int = GRAIN, approx: bool = False
) -> DataFrame:
    """Number of index increases in each block, summarised over players."""
    grows = F.count_if(F.col("key_index") > F.col("before.key_index"))
    slots = _linked(events, ("key_index",), grain).groupBy(*SLOT).agg(grows.alias("times"))
    per_player = _per_block(slots, events, interval, gap, {"times": F.sum("times")}, grain=grain)
    return block_summary(per_player, "times", approx)


def key_change_per_player(
    events: DataFrame, interval: int, gap: int = GAP, growth: bool = True, grain: int = GRAIN, keep_open: bool = False
) -> DataFrame:
    """Index change of each player credited to the action before it, per block and action.

    ``keep_open`` also counts each player's last block, which no cut has closed.
    """
    sign = 1 if growth else -1
    delta = (F.col("key_index") - F.col("before.key_index")) * sign
    slots = (
        _linked(events, ("key_index", "action"), grain)
        .groupBy(*SLOT, F.col("before.action").alias("action"))
        .agg(F.sum(F.when(delta > 0, delta)).alias("change"), F.count_if(delta > 0).alias("times"))
    )
    folded = (
        slots.join(block_map(events, interval, gap, grain), SLOT)
        .groupBy("player", "block", "action")
        .agg(F.sum("change").alias("change"), F.sum("times").alias("times"))
    )
    return (folded if keep_open else _full_blocks(folded)).where(F.col("times") > 0)


def key_change_by_action(
    events: DataFrame,
    interval: int,
    gap: int = GAP,
    growth: bool = True,
    grain: int = GRAIN,
    approx: bool = False,
    keep_open: bool = False,
) -> DataFrame:
    """Per (block, action): players and max, min, median, mean of change and of occurrences."""
    per_player = key_change_per_player(events, interval, gap, growth, grain, keep_open)
    wanted = [("change", "n", "players"), ("change", "total", "total_change")]
    for m in ("change", "times"):
        wanted += [(m, s, f"{label}_{m}") for s, label in (("max", "max"), ("min", "min"), ("p50", "median"), ("mean", "mean"))]
    return widen(group_stats(per_player if approx else settle(per_player, "changes"), ["block", "action"], ["change", "times"], approx=approx), ["block", "action"], wanted)


def key_change_one_player(
    events: DataFrame, player: int, interval: int, gap: int = GAP, growth: bool = True, grain: int = GRAIN
) -> DataFrame:
    """`key_change_by_action` for one player: change and times per block and action, and the
    increases in the whole block."""
    mine = key_change_per_player(events.where(F.col("player") == player), interval, gap, growth, grain)
    totals = mine.groupBy("block").agg(F.sum("times").alias("block_times"))
    return mine.join(totals, "block")


def chaos_index(
    events: DataFrame, interval: int, gap: int = GAP, approx: bool = False, keep_short: bool = False, grain: int = GRAIN
) -> DataFrame:
    """Actions new to the player in each block, summarised over players.

    ``keep_short`` lets players without a full block enter block 0 with all their actions.
    """
    firsts = events.groupBy("player", "action").agg(F.min(position()).alias("at"))
    novel = firsts.select("player", F.col("at.ts").alias("ts"), F.col("at.event_id").alias("event_id"))
    heads = events.groupBy("player", "ts").agg(F.min("event_id").alias("first_id"))
    found = (
        novel.join(heads, ["player", "ts"])
        .groupBy("player", "ts", (F.col("event_id") == F.col("first_id")).alias("head"))
        .agg(F.count(F.lit(1)).alias("novel"))
    )
    every = _click_slots(events).join(found, SLOT, "left").na.fill(0, ["novel"])
    per_player = _per_block(every, events, interval, gap, {"novel": F.sum("novel")}, keep_short, grain)
    return block_summary(per_player, "novel", approx)


CHANGES = (
    "up_times",
    "up_volume",
    "down_times",
    "down_volume",
    "closing_value",
    "power_times",
    "power_volume",
    "closing_power",
)


def change_sums(delta: Column, power_delta: Column) -> list[Column]:
    """Times and volumes of rises and falls; nulls count as no change."""
    zero = F.lit(0)
    return [
        F.count_if(delta > 0).alias("up_times"),
        F.coalesce(F.sum(F.when(delta > 0, delta)), zero).alias("up_volume"),
        F.count_if(delta < 0).alias("down_times"),
        F.coalesce(F.sum(F.when(delta < 0, -delta)), zero).alias("down_volume"),
        F.count_if(power_delta > 0).alias("power_times"),
        F.coalesce(F.sum(F.when(power_delta > 0, power_delta)), zero).alias("power_volume"),
    ]


def change_summary(per_player: DataFrame, key: str, approx: bool = False) -> DataFrame:
    """Players, and median and mean of the eight measures, by ``key``."""
    wanted = [("up_times", "n", "players")]
    for m in CHANGES:
        wanted += [(m, "p50", f"{m}_median"), (m, "mean", f"{m}_mean")]
    return widen(group_stats(per_player if approx else settle(per_player, "changes"), [key], list(CHANGES), approx=approx), [key], wanted)


def key_change_per_player_block(
    events: DataFrame, interval: int, gap: int = GAP, grain: int = GRAIN
) -> DataFrame:
    """The eight change measures per player and full block.

    The change on a cut row belongs to no block.
    """
    delta = F.col("key_index") - F.col("before.key_index")
    power_delta = F.col("power") - F.col("before.power")
    last = F.struct("ts", "event_id", "key_index", "power")
    slots = (
        _linked(events, ("key_index", "power"), grain)
        .groupBy(*SLOT)
        .agg(
            *change_sums(delta, power_delta),
            F.max(last).alias("last"),
            F.min_by(F.struct(delta.alias("d"), power_delta.alias("p")), "event_id").alias("lead"),
        )
    )
    # A cut falls on the first row of its slot; that row's change is taken out again.
    d, p = F.col("lead.d"), F.col("lead.p")
    off = {
        "up_times": (d > 0).cast("int"),
        "up_volume": F.greatest(d, F.lit(0)),
        "down_times": (d < 0).cast("int"),
        "down_volume": F.greatest(-d, F.lit(0)),
        "power_times": (p > 0).cast("int"),
        "power_volume": F.greatest(p, F.lit(0)),
    }
    sums = {
        m: F.sum(F.col(m) - F.when(F.col("cut"), F.coalesce(v, F.lit(0))).otherwise(F.lit(0)))
        for m, v in off.items()
    }
    sums["last"] = F.max("last")
    per_player = _per_block(slots, events, interval, gap, sums, grain=grain)
    return per_player.select(
        "player",
        "block",
        *off,
        F.col("last.key_index").alias("closing_value"),
        F.col("last.power").alias("closing_power"),
    )


def key_change_by_time(
    events: DataFrame, interval: int, gap: int = GAP, grain: int = GRAIN, approx: bool = False
) -> DataFrame:
    """The eight change measures by block: players, median and mean."""
    return change_summary(key_change_per_player_block(events, interval, gap, grain), "block", approx)


def ui_stays(
    events: DataFrame,
    enter: str,
    exits: str,
    limit: int = 600,
    loss_window: int = 20,
    grain: int = GRAIN,
) -> DataFrame:
    """Repeated stays in a screen: one row per stay, ``player, enter_ts, stay``.

    A stay opens at an enter row.  It closes at the first later row that is an exit, is
    ``loss_window`` rows on, or follows a gap over ``limit``.  An exit counts up to its own
    time (not at all after a gap over ``limit``), the others up to the row before; the closing
    row never opens the next stay.
    """
    is_action = lambda name: F.coalesce(F.col("action") == name, F.lit(False))
    rows = events.select("player", "ts", "event_id", is_action(enter).alias("enters"), is_action(exits).alias("exits"))
    made = "enter_ts bigint, stay bigint"
    return follow(rows, stay_relay(limit, loss_window), made, ["player"], ["ts", "event_id"], grain)


def ui_time_ratio(
    events: DataFrame,
    enter: str,
    exits: str,
    limit: int = 600,
    loss_window: int = 20,
    grain: int = GRAIN,
) -> DataFrame:
    """Stay in a screen over (active seconds + 1), per player; also stays, median stay and both sums."""
    stays = (
        ui_stays(events, enter, exits, limit, loss_window, grain)
        .groupBy("player")
        .agg(
            F.count(F.lit(1)).alias("stays"),
            F.sum("stay").alias("stay_secs"),
            F.median("stay").alias("median_stay"),
        )
    )
    active = (
        gap_sessions(events, limit)
        .groupBy("player")
        .agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("active_secs"))
    )
    return (
        active.join(stays, "player", "left")
        .na.fill(0, ["stays", "stay_secs"])
        .withColumn("ratio", F.col("stay_secs") / (F.col("active_secs") + 1))
    )
