"""Per-player counts, flags and the user profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import group_stats
from ..plans.timeline import GRAIN, position
from .blocks import ui_time_ratio
from .frames import top_per_group
from .episodes import find_payers, first_pay_view_time, ui_stay_time
from .sessions import click_frequency, click_frequency_pre_vip, favourite_slot, first_day_and_retention
from .stats import group_rate

SLOTS = ("afternoon", "morning", "night", "noon")


def _pre_vip(events: DataFrame, pre_vip: bool) -> DataFrame:
    return events.where(F.col("vip_level") < 1) if pre_vip else events


def action_distribution(events: DataFrame, pre_vip: bool = False) -> DataFrame:
    """Clicks per (player, action)."""
    return _pre_vip(events, pre_vip).groupBy("player", "action").agg(F.count(F.lit(1)).alias("clicks"))


def action_distribution_nested(events: DataFrame, pre_vip: bool = False) -> DataFrame:
    """`action_distribution` as one map-like array per player: ``actions array<struct<action, n>>``."""
    counted = action_distribution(events, pre_vip)
    pairs = F.sort_array(F.collect_list(F.struct("action", F.col("clicks").alias("n"))))
    return counted.groupBy("player").agg(pairs.alias("actions"))


def target_action_counts(events: DataFrame, actions: Sequence[str], pre_vip: bool = False) -> DataFrame:
    """Clicks on each listed action per player, zeros kept: one column per action."""
    wanted = [F.count_if(_pre_vip_flag(pre_vip) & (F.col("action") == a)).alias(a) for a in actions]
    return events.groupBy("player").agg(*wanted)


def _pre_vip_flag(pre_vip: bool) -> Column:
    return F.col("vip_level") < 1 if pre_vip else F.lit(True)


def separating_actions(
    events: DataFrame, flags: DataFrame, top_n: int = 20, approx: bool = False
) -> DataFrame:
    """Actions that set groups of retained players apart.

    ``flags``: ``player, retained, vip``.  Long result ``list, rank, action, score`` for the
    lists ``vip`` and ``not_vip`` (by median clicks) and ``spread`` (by population std over all
    retained players), and ``only_vip`` / ``only_not_vip``: in one of the first two, not the other.
    """
    counted = action_distribution(events).join(flags.where("retained"), "player")
    medians = group_stats(counted, ["vip", "action"], ["clicks"], approx=approx, counts=True)
    spread = group_stats(counted, ["action"], ["clicks"], ())
    side = F.when(F.col("vip"), "vip").otherwise("not_vip").alias("list")
    scores = medians.select(side, "action", F.col("p50").alias("score")).unionByName(
        spread.select(F.lit("spread").alias("list"), "action", F.col("std_pop").alias("score"))
    )
    top = top_per_group(scores, ["list"], [F.col("score").desc(), F.col("action")], top_n)
    # At most ``3 * top_n`` rows are left here.
    sided = F.count_if(F.col("list") != "spread").over(Window.partitionBy("action"))
    marked = top.withColumn("_alone", (F.col("list") != "spread") & (sided == 1))
    lists = F.when(F.col("_alone"), F.array("list", F.concat(F.lit("only_"), "list"))).otherwise(F.array("list"))
    return marked.select(F.explode(lists).alias("list"), "rank", "action", "score")


def steps_to_vip(events: DataFrame) -> DataFrame:
    """Rows before VIP of each player who becomes VIP."""
    return (
        events.groupBy("player")
        .agg(F.count_if(F.col("vip_level") == 0).alias("steps"), F.max("vip_level").alias("_vip"))
        .where(F.col("_vip") >= 1)
        .drop("_vip")
    )


def favourite_device(events: DataFrame) -> DataFrame:
    """Most used device per player; the smallest name on a tie."""
    counted = events.where(F.col("device").isNotNull()).groupBy("player", "device").agg(F.count(F.lit(1)).alias("rows"))
    top = counted.groupBy("player").agg(F.max("rows").alias("_top"))
    return (
        counted.join(top, "player")
        .where(F.col("rows") == F.col("_top"))
        .groupBy("player")
        .agg(F.min("device").alias("device"))
    )


def device_pay_rate(events: DataFrame, payers: DataFrame, min_size: int = 10) -> DataFrame:
    """Payer rate of each player's most used device, 0 on devices with under ``min_size`` players.

    ``payers``: one row per paying player.  Columns ``player, device, size, rate``.
    """
    paying = payers.select("player").distinct().withColumn("pays", F.lit(True))
    owned = favourite_device(events).join(paying, "player", "left")
    rates = group_rate(owned, "device", F.coalesce("pays", F.lit(False)), min_size)
    return owned.select("player", "device").join(rates, "device")


def vip_and_retained_flags(events: DataFrame, min_days: int = 1) -> DataFrame:
    """Last ``vip_level`` is not 0; last ``num_days_played`` is above ``min_days``."""
    at = position()
    return events.groupBy("player").agg(
        (F.max_by("vip_level", at) != 0).alias("vip"),
        (F.max_by("num_days_played", at) > min_days).alias("retained"),
    )


def flag_crosstab(flags: DataFrame) -> DataFrame:
    """Players by (vip, retained) and their share within the vip group."""
    counted = flags.groupBy("vip", "retained").agg(F.count(F.lit(1)).alias("players"))
    size = counted.groupBy("vip").agg(F.sum("players").alias("_size"))
    return counted.join(size, "vip").select(
        "vip", "retained", "players", (F.col("players") / F.col("_size")).alias("share")
    )


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Replace a column by one 0/1 column per known value."""
    flags = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)


def user_profile(
    events: DataFrame,
    enter: str,
    exits: str,
    gap: int = 300,
    slot_gap: int = 3600,
    stay_gap: int = 600,
    loss_window: int = 20,
    min_days: int = 1,
    grain: int = GRAIN,
) -> DataFrame:
    """One row per player: pre-VIP click frequency, VIP flag, favourite slot as 0/1 columns,
    share of time in a screen, retained flag."""
    freq = click_frequency_pre_vip(events, gap)
    slots = favourite_slot(events, slot_gap, pre_vip=True).select("player", "slot")
    ratio = ui_time_ratio(events, enter, exits, stay_gap, loss_window, grain).select("player", "ratio")
    flags = vip_and_retained_flags(events, min_days)
    joined = freq.join(flags, "player").join(ratio, "player", "left").join(slots, "player", "left")
    return one_hot(joined, "slot", SLOTS)


def user_profile_long(
    events: DataFrame,
    enter: str,
    exits: str,
    keywords: Sequence[str],
    first_day: int,
    days: int,
    gap: int = 300,
    min_length: int = 300,
    loss_window: int = 20,
    stay_limit: int = 1500,
    money_limit: int = 100,
    step_limit: int = 5,
    grain: int = GRAIN,
) -> DataFrame:
    """The older profile: click frequency, first-day time, retention, first payment view, screen
    stay, payer flag."""
    payers = find_payers(events, keywords, money_limit, step_limit, grain=grain)
    stay = ui_stay_time(events, enter, exits, loss_window, stay_limit, grain).select("player", "stay_secs")
    return (
        click_frequency(events, gap, min_length)
        .join(first_day_and_retention(events, first_day, days, gap), "player")
        .join(first_pay_view_time(events, keywords), "player")
        .join(stay, "player")
        .join(payers.select("player", F.lit(True).alias("payer")), "player", "left")
        .na.fill({"payer": False})
    )


def sample_one_per_player(events: DataFrame, seed: int = 0) -> DataFrame:
    """One row per player, drawn by a seeded hash of the row's id: the same on every run."""
    draw = F.struct(F.xxhash64(F.lit(seed), F.col("event_id")).alias("h"), F.col("event_id"))
    return (
        events.groupBy("player")
        .agg(F.min_by(F.struct(*[c for c in events.columns if c != "player"]), draw).alias("row"))
        .select("player", "row.*")
    )
