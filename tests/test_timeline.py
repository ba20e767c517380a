"""Scans over stretches give the plain window's result for every grain."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from playmetrics.plans.timeline import FirstSeen, Histories, LastSeen, LinkSum, Prev, RowNumber, RunSum, Total, running
from playmetrics.plans.stretches import split

from .conftest import make, random_rows, table


@pytest.mark.parametrize("grain, seed", [(1, 1), (7, 2), (40, 1), (1_000_000, 2)])
def test_all_specs_equal_plain_windows(spark, grain, seed):
    events = make(spark, random_rows(seed)).select("player", "ts", "event_id", "action", "key_index")
    paying = F.when(F.col("action") == "pay", F.col("key_index"))
    w = Window.partitionBy("player").orderBy("ts", "event_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    found = running(
        events,
        Prev("p", ("ts", "action")),
        RowNumber("rn"),
        RunSum("s", F.col("key_index")),
        RunSum("s0", F.col("key_index"), inclusive=False),
        LastSeen("last", paying),
        LastSeen("last_in", paying, inclusive=True),
        LastSeen("lastn", paying, numbered=True),
        FirstSeen("first", paying),
        FirstSeen("firstn", paying, numbered=True),
        LinkSum("runs", ("action",), lambda a, b: (a["action"] != b["action"]).cast("int")),
        Total("whole", F.col("key_index")),
        Total("top", F.col("key_index"), "max"),
        grain=grain,
    ).select(
        "player", "event_id", "p.ts", "p.action", "rn", "s", "s0", "last", "last_in",
        F.col("lastn.rn").alias("last_rn"), F.col("firstn.rn").alias("first_rn"), "first", "runs", "whole", "top",
    )
    numbered = events.withColumn("rn", F.row_number().over(w).cast("bigint"))
    changed = (F.lag("action").over(w) != F.col("action")).cast("int")
    wanted = (
        numbered.withColumn("flag", F.coalesce(changed, F.lit(1)))
        .select(
            "player",
            "event_id",
            F.lag("ts").over(w).alias("ts"),
            F.lag("action").over(w).alias("action"),
            "rn",
            F.sum("key_index").over(upto).alias("s"),
            F.coalesce(F.sum("key_index").over(before), F.lit(0)).alias("s0"),
            F.last(paying, True).over(before).alias("last"),
            F.last(paying, True).over(upto).alias("last_in"),
            F.last(F.when(paying.isNotNull(), F.col("rn")), True).over(before).alias("last_rn"),
            F.first(F.when(paying.isNotNull(), F.col("rn")), True).over(upto).alias("first_rn"),
            F.first(paying, True).over(upto).alias("first"),
            F.sum("flag").over(upto).alias("runs"),
            F.sum("key_index").over(Window.partitionBy("player")).alias("whole"),
            F.max("key_index").over(Window.partitionBy("player")).alias("top"),
        )
    )
    assert table(found) == table(wanted)


def test_scans_share_one_shuffle_of_the_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    make(spark, random_rows(3)).write.parquet(path)
    events = spark.read.parquet(path).select("player", "ts", "event_id", "action")
    df = (
        Histories(events)
        .add(RowNumber("rn"), Prev("p", ("action",)))
        .add(RunSum("s", F.col("rn")))
        .done()
    )
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_null_keys_and_times_keep_their_rows(spark):
    rows = [(None if i % 3 else i % 2, None if i % 5 == 0 else i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "player bigint, ts bigint, event_id bigint")
    w = Window.partitionBy("player").orderBy("ts", "event_id")
    wanted = table(df.withColumn("rn", F.row_number().over(w).cast("bigint")))
    for grain in (10, 1000):
        assert table(running(df, RowNumber("rn"), grain=grain)) == wanted


def test_a_hot_player_and_second_spread(spark):
    # Half of all rows belong to player 1, half of these to one second.
    rows = [dict(player=1 if i % 2 else i, ts=50 if i % 4 == 1 else i, event_id=i) for i in range(800)]
    events = make(spark, rows).select("player", "ts", "event_id")
    short, long = split(events, ["player"], ["ts", "event_id"], 50)
    sizes = [r["count"] for r in long.groupBy("player", "_stretch").count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= 8 and max(sizes) <= 100
    assert short.where("player = 1").count() == 0 and short.count() == 400
