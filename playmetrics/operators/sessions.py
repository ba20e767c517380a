"""Sessions and active time.

A session is a stretch of a player's rows with no gap above ``limit`` seconds.  Rows are first
reduced to one record per player and ``limit``-wide time bucket: rows in one bucket are never
more than ``limit`` apart, so a bucket never spans two sessions, and a history shrinks to at
most ``span / limit`` records before any ordered work.  All sorting happens on those records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import day_slot
from ..sources.events import day_of, hour_of

LIMIT = 300


def session_buckets(events: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = ("player",)) -> DataFrame:
    """One record per (keys, bucket): bucket start, end, rows, and the session it belongs to."""
    width = max(limit, 1)
    buckets = (
        events.withColumn("bucket", F.floor(F.col("ts") / F.lit(width)))
        .groupBy(*keys, "bucket")
        .agg(
            F.min("ts").alias("bucket_start"),
            F.max("ts").alias("bucket_end"),
            F.count(F.lit(1)).alias("bucket_rows"),
        )
    )
    w = Window.partitionBy(*keys).orderBy("bucket")
    gap = F.col("bucket_start") - F.lag("bucket_end").over(w)
    opens = F.coalesce(gap > limit, F.lit(True)).cast("int")
    return buckets.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w) - 1).drop("_opens")


def gap_sessions(events: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = ("player",)) -> DataFrame:
    """Sessions of each player: number from 0, start, end, clicks."""
    return (
        session_buckets(events, limit, keys)
        .groupBy(*keys, "session")
        .agg(
            F.min("bucket_start").alias("start_ts"),
            F.max("bucket_end").alias("end_ts"),
            F.sum("bucket_rows").alias("clicks"),
        )
    )


def _frequency(length: Column) -> Column:
    """Clicks per second of a session: the first click opens it and is not counted."""
    return (F.col("clicks") - 1) / F.when(length > 0, length)


def click_frequency(events: DataFrame, limit: int = LIMIT, min_length: int = 300) -> DataFrame:
    """Median clicks per second over a player's sessions of at least ``min_length`` seconds.

    A player's last session is still open and counts only when no other one qualifies.
    Null where a player has no usable session.
    """
    latest = Window.partitionBy("player")
    rated = (
        gap_sessions(events, limit)
        .withColumn("length", F.col("end_ts") - F.col("start_ts"))
        .withColumn("is_last", F.col("session") == F.max("session").over(latest))
        .withColumn("freq", _frequency(F.col("length")))
    )
    closed = F.when(~F.col("is_last") & (F.col("length") >= min_length) & (F.col("length") > 0), F.col("freq"))
    return rated.groupBy("player").agg(
        F.coalesce(F.median(closed), F.max(F.when(F.col("is_last"), F.col("freq")))).alias("freq")
    )


def click_frequency_pre_vip(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """As `click_frequency` on rows before VIP, over all sessions longer than zero seconds."""
    rated = (
        gap_sessions(events.where(F.col("vip_level") < 1), limit)
        .withColumn("freq", _frequency(F.col("end_ts") - F.col("start_ts")))
        .groupBy("player")
        .agg(F.median("freq").alias("freq"))
    )
    return events.select("player").distinct().join(rated, "player", "left")


def _in_range(begin: int, end: int) -> Column:
    return F.col("ts").between(begin, end)


def play_time_in_range(events: DataFrame, begin: int, end: int, threshold: int = LIMIT) -> DataFrame:
    """Active seconds of every player in ``[begin, end]``; gaps over ``threshold`` do not count."""
    played = (
        gap_sessions(events.where(_in_range(begin, end)), threshold)
        .groupBy("player")
        .agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("duration"))
    )
    return (
        events.select("player").distinct().join(played, "player", "left").na.fill(0, ["duration"])
    )


def play_span(events: DataFrame) -> DataFrame:
    """Seconds from a player's first row to the last."""
    return events.groupBy("player").agg((F.max("ts") - F.min("ts")).alias("span"))


def play_time_by_day(
    events: DataFrame, first_day: int, days: int, threshold: int = LIMIT, utc_offset: int = 0
) -> DataFrame:
    """Active seconds per player and day number 0..days; only days with rows appear."""
    day_no = day_of(F.col("ts"), utc_offset) - F.lit(first_day)
    daily = events.withColumn("day_no", day_no.cast("int")).where(F.col("day_no").between(0, days))
    return (
        gap_sessions(daily, threshold, ("player", "day_no"))
        .groupBy("player", "day_no")
        .agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("duration"))
    )


def first_day_and_retention(
    events: DataFrame, first_day: int, days: int, threshold: int = LIMIT, utc_offset: int = 0
) -> DataFrame:
    """Active seconds on a player's first non-zero day, and whether several days are non-zero."""
    played = play_time_by_day(events, first_day, days, threshold, utc_offset).where(F.col("duration") > 0)
    per_player = played.groupBy("player").agg(
        F.min_by("duration", "day_no").alias("first_day_duration"),
        (F.count(F.lit(1)) > 1).alias("retained"),
    )
    return (
        events.select("player")
        .distinct()
        .join(per_player, "player", "left")
        .select(
            "player",
            F.coalesce("first_day_duration", F.lit(0)).alias("first_day_duration"),
            F.coalesce("retained", F.lit(False)).alias("retained"),
        )
    )


def favourite_slot(events: DataFrame, limit: int = 3600, utc_offset: int = 0, pre_vip: bool = False) -> DataFrame:
    """Day slot in which most of a player's sessions start; on a tie the slot seen first.

    ``pre_vip`` looks at rows before VIP; a player without any has the slot of the first row.
    """
    rows = events.where(F.col("vip_level") < 1) if pre_vip else events
    started = gap_sessions(rows, limit).withColumn("slot", day_slot(hour_of(F.col("start_ts"), utc_offset)))
    counted = started.groupBy("player", "slot").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("start_ts").alias("seen")
    )
    best = counted.groupBy("player").agg(
        F.max_by("slot", F.struct(F.col("sessions"), (-F.col("seen")).alias("early"))).alias("slot"),
        F.max("sessions").alias("sessions"),
    )
    if not pre_vip:
        return best
    first = events.groupBy("player").agg(day_slot(hour_of(F.min("ts"), utc_offset)).alias("_first"))
    return first.join(best, "player", "left").select(
        "player", F.coalesce("slot", "_first").alias("slot"), F.coalesce("sessions", F.lit(1)).alias("sessions")
    )


def _top_sessions(events: DataFrame, top_n: int, limit: int) -> DataFrame:
    rank = Window.partitionBy("player").orderBy(F.col("freq").desc(), "start_ts")
    return (
        gap_sessions(events, limit)
        .withColumn("freq", _frequency(F.col("end_ts") - F.col("start_ts")))
        .where(F.col("freq").isNotNull())
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= top_n)
    )


def max_click_freq(events: DataFrame, top_n: int = 10, limit: int = LIMIT, pre_vip: bool = False) -> DataFrame:
    """A player's ``top_n`` sessions by clicks per second."""
    rows = events.where(F.col("vip_level") < 1) if pre_vip else events
    return _top_sessions(rows, top_n, limit).select("player", "rank", "freq", "start_ts", "end_ts", "clicks")


def max_click_freq_actions(
    events: DataFrame, top_n: int = 10, limit: int = LIMIT, pre_vip: bool = False
) -> DataFrame:
    """The rows of `max_click_freq` sessions in order of time: one row per click.

    Rows meet their session through the time bucket, so a player with very many rows spreads
    over as many join keys as it has buckets.
    """
    rows = events.where(F.col("vip_level") < 1) if pre_vip else events
    best = _top_sessions(rows, top_n, limit).select("player", "session", "rank", "freq")
    where = session_buckets(rows, limit).select("player", "bucket", "session").join(best, ["player", "session"])
    return (
        rows.withColumn("bucket", F.floor(F.col("ts") / F.lit(max(limit, 1))))
        .join(where, ["player", "bucket"])
        .select("player", "rank", "freq", "ts", "event_id", "action")
    )
