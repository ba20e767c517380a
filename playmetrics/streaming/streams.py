"""Structured Streaming forms of three operators.

Input: a stream with ``player bigint, ts bigint (epoch seconds), event_id bigint, action string``.
Rows older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.predicates import action_is
from ..plans.cuts import chain_of_cuts
from ..sources.tables import work_dir


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)


def stream_sessions(events: DataFrame, limit: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Sessions of each player, emitted once closed: ``player, start_ts, end_ts, clicks``.

    A gap of exactly ``limit`` stays inside a session, as in the batch form.
    """
    return (
        _timed(events, delay)
        .groupBy("player", F.session_window("event_time", f"{limit} seconds").alias("w"))
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("clicks"))
        .select("player", "start_ts", "end_ts", "clicks")
    )


def stream_enter_ratio(events: DataFrame, enter: str, window: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Players with the enter action over players active, per calendar window: ``begin, active, entered, ratio``.

    Two stateful operators follow each other: the first keeps one entry per window and player until the
    watermark has passed the window, the second counts the entries that the first lets go.  So
    players are counted exactly, and a window with a third of all rows is no hot key of the first.
    """
    enters = F.coalesce(action_is("action", enter), F.lit(False)).cast("int")
    players = (
        _timed(events, delay)
        .groupBy(F.window("event_time", window).alias("w"), "player")
        .agg(F.max(enters).alias("enters"))
    )
    counted = players.groupBy(F.window(F.window_time("w"), window).alias("w")).agg(
        F.count(F.lit(1)).alias("active"), F.sum("enters").alias("entered")
    )
    return counted.select(
        F.unix_seconds("w.start").alias("begin"), "active", "entered", (F.col("entered") / F.col("active")).alias("ratio")
    )


def stream_active_blocks(events: DataFrame, interval: int, gap: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Full blocks of active time, each emitted at its cut: ``player, block, start_ts, end_ts, clicks``.

    Rows are counted per player and second before they are shuffled, so a batch brings a player at
    most one record per second and input part; its task holds one Arrow batch of these and one number per
    second.  State per player, kept for ever: the block's first
    second, the last second, the clock since the last cut, block number and clicks.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(["player", "ts"], as_index=False).agg(rows=("event_id", "size"))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds = pd.Series(dtype=np.int64)
        for batch in batches:
            seconds = seconds.add(batch.groupby("ts")["rows"].sum(), fill_value=0).astype(np.int64)
        seconds = seconds.sort_index()
        # Within a second only the first row and the later ones can differ.
        twice = np.minimum(seconds.to_numpy(), 2)
        ts = np.repeat(seconds.index.to_numpy(), twice)
        clicks = np.ones(len(ts), np.int64)
        clicks[(np.cumsum(twice) - 1)[twice == 2]] = seconds.to_numpy()[twice == 2] - 1
        opened, last, clock, block, before = state.get if state.exists else (int(ts[0]), int(ts[0]), 0, 0, 0)
        cuts, clock = chain_of_cuts(ts, last, clock, gap, interval)
        edges = np.concatenate(([0], cuts, [len(ts)]))
        sums = np.add.reduceat(np.append(clicks, 0), edges[:-1]) * (np.diff(edges) > 0)
        sums[0] += before
        ends = np.where(cuts > 0, ts[cuts - 1], last)
        starts = np.concatenate(([opened], ts[cuts]))
        state.update((int(starts[-1]), int(ts[-1]), clock, block + len(cuts), int(sums[-1])))
        yield pd.DataFrame(
            {
                "player": np.full(len(cuts), key[0]),
                "block": np.arange(block, block + len(cuts), dtype=np.int32),
                "start_ts": starts[:-1],
                "end_ts": ends,
                "clicks": sums[:-1],
            }
        )

    combined = events.select("player", "ts", "event_id").mapInPandas(combine, "player bigint, ts bigint, rows bigint")
    return (
        _timed(combined, delay)
        .groupBy("player")
        .applyInPandasWithState(
            advance,
            "player bigint, block int, start_ts bigint, end_ts bigint, clicks bigint",
            "opened bigint, last bigint, clock bigint, block int, clicks bigint",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a finite stream to its end into a table in the shared folder, and read it back."""
    spark = stream.sparkSession
    root = work_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .option("path", f"{root}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
