"""The event table every per-player operator works on.

Columns: ``player`` bigint, ``ts`` bigint (whole epoch seconds), ``event_id`` bigint (order of
rows within a second), and any of ``action``, ``key_index``, ``level``, ``power``,
``vip_level``, ``num_days_played``, ``device``, ``channel``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400

TYPES = {
    "action": "string",
    "level": "int",
    "power": "bigint",
    "vip_level": "int",
    "num_days_played": "int",
    "device": "string",
    "channel": "string",
}


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole epoch seconds of a timestamp, zone-free timestamp, or epoch number column."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        # Read off the fields, so that the session's time zone plays no part.
        at = F.col(column)
        clock = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
        return F.unix_date(F.to_date(at)).cast("bigint") * DAY + clock
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(F.col(column))
    return F.floor(F.col(column)).cast("bigint")


def as_events(df: DataFrame, player: str, ts: str, event_id: str, **columns: str | Column) -> DataFrame:
    """Select and rename the columns of a log by role, checking types once.

    ``columns`` maps a role (``action=``, ``key_index=``, ``level=``, ...) to a column name or
    expression.  Rows without a player or a time belong to no history and are left out.
    """
    kind = df.schema[player].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError("player ids must not be floating point: large ids lose digits")
    chosen = []
    for role, source in columns.items():
        value = F.col(source) if isinstance(source, str) else source
        chosen.append((value.cast(TYPES[role]) if role in TYPES else value).alias(role))
    return df.where(F.col(player).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(player).cast("bigint").alias("player"),
        epoch_seconds(df, ts).alias("ts"),
        F.col(event_id).cast("bigint").alias("event_id"),
        *chosen,
    )


def day_of(ts: Column, utc_offset: int = 0) -> Column:
    """Calendar day number (days since 1970-01-01) of epoch seconds."""
    return F.floor((ts + F.lit(utc_offset)) / F.lit(DAY))


def hour_of(ts: Column, utc_offset: int = 0) -> Column:
    """Hour of the day, 0-23, of epoch seconds."""
    return F.floor(F.pmod(ts + F.lit(utc_offset), F.lit(DAY)) / F.lit(3600)).cast("int")


def calendar_ranges(events: DataFrame, first_day: int, days: int, unit: str = "day") -> DataFrame:
    """Half-open ranges covering ``first_day`` and ``days`` more, with the rows found in each.

    ``first_day`` is a day number.  ``unit`` is ``day`` or ``hour``.
    """
    width = DAY if unit == "day" else 3600
    start = first_day * DAY
    count = (days + 1) * DAY // width
    spark = events.sparkSession
    ranges = spark.range(count).select(
        F.col("id").alias("slot"),
        (F.lit(start) + F.col("id") * width).alias("begin"),
        (F.lit(start) + (F.col("id") + 1) * width).alias("end"),
    )
    found = (
        events.where((F.col("ts") >= start) & (F.col("ts") < start + count * width))
        .groupBy(F.floor((F.col("ts") - start) / width).alias("slot"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return ranges.join(found, "slot", "left").na.fill(0, ["rows"])
