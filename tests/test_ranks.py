from __future__ import annotations

import random

from pyspark.sql import functions as F

from playmetrics.plans import ranks
from playmetrics.plans.ranks import running_total
from playmetrics.sources.tables import settle


def test_running_total_matches_a_plain_loop(spark):
    rng = random.Random(3)
    keys = [(None, "x"), *{(rng.choice("abc"), f"{rng.randrange(10**6)}") for _ in range(500)}]
    rows = [(*k, rng.randrange(4)) for k in keys]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k string, w bigint").repartition(5)
    got = {(r["g"], r["k"]): r["before"] for r in running_total(df, ["g", "k"], F.col("w"), "before").collect()}
    total = 0
    for g, k, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        assert got[g, k] == total
        total += w


def test_running_total_of_nothing(spark):
    df = spark.createDataFrame([], "k string")
    assert running_total(df, ["k"], F.lit(1), "before").collect() == []


def test_no_task_gets_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    plan = running_total(df, ["k"], F.lit(1), "at")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_each_range_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(ranks, "settle", lambda df, name: settle(df.withColumn("_range", F.floor("id").cast("int") % 8), name))
    found = running_total(spark.range(0, 8).repartition(8), ["id"], F.lit(1), "before")
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and sorted(r["before"] for r in found.collect()) == list(range(8))
