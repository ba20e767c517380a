"""Registration of queries, and the game-log view of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.timeline import LinkSum, RowNumber, RunSum, running
from ..sources.events import as_events, day_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key``, with its SQL statement where it has one."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the floating-point columns, so that the order of additions does not show."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# The game log -------------------------------------------------------------------------------

DAY0 = 19_723  # 2024-01-01 as a day number
BEGIN = DAY0 * 86_400
GAP = 21_600
BLOCK = 86_400
RETAINED_DAYS = 26


def log(spark: SparkSession, sf: str, **extra) -> DataFrame:
    """``events`` as a game log: player, ts, event_id, action, key_index (cents)."""
    return as_events(
        table(spark, sf, "events"),
        player="user_id",
        ts="ts",
        event_id="event_id",
        action="event_type",
        key_index=F.round(F.col("value") * 100).cast("bigint"),
        **extra,
    )


def _scanned(events: DataFrame, *more) -> DataFrame:
    """The log with the running columns level, power and vip_level, and any others asked for."""
    paid = F.when(F.col("action") == "purchase", F.col("key_index")).otherwise(F.lit(0))
    big = ((F.col("action") == "purchase") & (F.col("key_index") >= 15_000)).cast("int")
    scanned = running(events, RowNumber("_rn_"), RunSum("power", paid), RunSum("_vip", big), *more)
    return scanned.select(
        *events.columns,
        (F.floor((F.col("_rn_") - 1) / 10) + 1).cast("int").alias("level"),
        "power",
        (F.col("_vip") > 0).cast("int").alias("vip_level"),
        *[F.col(spec.name).cast("int").alias(spec.name) for spec in more],
    )


def full_log(spark: SparkSession, sf: str, device: bool = False) -> DataFrame:
    """The log with level, power and vip_level."""
    extra = {"device": F.get_json_object("props", "$.k").cast("int") % 12} if device else {}
    return _scanned(log(spark, sf, **extra))


def profile_log(spark: SparkSession, sf: str) -> DataFrame:
    """The full log with num_days_played, the number of distinct days seen so far."""
    new_day = lambda before, now: (day_of(before["ts"]) != day_of(now["ts"])).cast("int")
    return _scanned(log(spark, sf), LinkSum("num_days_played", ("ts",), new_day))


LOG = """log AS (
  SELECT user_id AS player, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, event_id, event_type AS action,
         CAST(round(value * 100) AS BIGINT) AS key_index,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS VARCHAR) AS device
  FROM events)"""

FULL = (
    LOG
    + """, full_log AS (
  SELECT *, CAST(1 + (row_number() OVER w - 1) // 10 AS INTEGER) AS level,
         CAST(sum(CASE WHEN action = 'purchase' THEN key_index ELSE 0 END) OVER w AS BIGINT) AS power,
         CAST(max(CASE WHEN action = 'purchase' AND key_index >= 15000 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS vip_level,
         row_number() OVER w AS rn
  FROM log WINDOW w AS (PARTITION BY player ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
)


def sessions_sql(source: str = "log", gap: int = GAP, keys: str = "player", name: str = "sessions") -> str:
    """Sessions by the plain statement: a flag on each long gap, a running count, a group by."""
    return f"""{name}_gaps AS (
  SELECT *, ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS gap FROM {source}),
{name}_flags AS (
  SELECT *, sum(CASE WHEN gap > {gap} THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM {name}_gaps),
{name} AS (
  SELECT {keys}, CAST(session AS BIGINT) AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS clicks
  FROM {name}_flags GROUP BY {keys}, session)"""


def blocks_sql(source: str = "log", gap: int = GAP, interval: int = BLOCK) -> str:
    """Block of every row by walking each history row by row; ``full_rows`` keeps full blocks."""
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, event_id) AS seq FROM {source}),
walk AS (
  SELECT player, seq, ts AS head, ts AS last, CAST(0 AS BIGINT) AS earlier, 0 AS block, false AS cut
  FROM numbered WHERE seq = 1
  UNION ALL
  SELECT n.player, n.seq,
         CASE WHEN n.ts - w.last > {gap} OR w.earlier + w.last - w.head >= {interval} THEN n.ts ELSE w.head END,
         n.ts,
         CASE WHEN n.ts - w.last > {gap} THEN w.earlier + w.last - w.head
              WHEN w.earlier + w.last - w.head >= {interval} THEN 0 ELSE w.earlier END,
         CASE WHEN n.ts - w.last <= {gap} AND w.earlier + w.last - w.head >= {interval}
              THEN w.block + 1 ELSE w.block END,
         n.ts - w.last <= {gap} AND w.earlier + w.last - w.head >= {interval}
  FROM walk w JOIN numbered n ON n.player = w.player AND n.seq = w.seq + 1),
block_rows AS (
  SELECT n.*, w.block, w.cut, max(w.block) OVER (PARTITION BY n.player) AS cuts
  FROM numbered n JOIN walk w ON n.player = w.player AND n.seq = w.seq),
full_rows AS (SELECT * FROM block_rows WHERE block < cuts)"""
