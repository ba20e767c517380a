import random

import numpy as np
import pytest

from playmetrics.plans import facts
from playmetrics.plans.quantiles import group_stats


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_for_any_bracket_width(spark, accuracy):
    rng = random.Random(accuracy)
    data = {
        "even": [rng.random() for _ in range(4000)],
        "ties": [float(rng.randrange(4)) for _ in range(1500)],
        "skew": [rng.expovariate(1) ** 5 for _ in range(999)],
        "one": [3.5],
        "two": [1.0, 2.0],
    }
    rows = [(g, v, -v) for g, values in data.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(7)
    stats = group_stats(df, ["g"], ["v", "w"], (0.0, 0.25, 0.5, 0.9, 1.0), accuracy=accuracy)
    found = {(r["g"], r["measure"]): r for r in stats.collect()}
    assert len(found) == 10
    for g, values in data.items():
        for measure, sign in (("v", 1), ("w", -1)):
            r, x = found[(g, measure)], np.array(values) * sign
            assert r["n"] == len(x) and r["min"] == x.min() and r["max"] == x.max()
            assert r["mean"] == pytest.approx(x.mean()) and r["std_pop"] == pytest.approx(x.std())
            for q, name in ((0, "p00"), (0.25, "p25"), (0.5, "p50"), (0.9, "p90"), (1, "p100")):
                assert r[name] == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_nulls_and_whole_table(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    row = group_stats(df, [], ["v"]).collect()[0]
    assert (row["n"], row["p50"]) == (2, 2.0)
    approx = group_stats(df, [], ["v"], approx=True).collect()[0]
    assert approx["p50"] in (1.0, 3.0)


def test_three_exchanges_and_no_window_over_all_values(spark, tmp_path):
    rng = random.Random(2)
    path = str(tmp_path / "values")
    spark.createDataFrame([(rng.random(), rng.random()) for _ in range(3000)], "v double, w double").write.parquet(path)
    df = group_stats(spark.read.parquet(path), [], ["v", "w"], (0.25, 0.5))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange" in line and "Broadcast" not in line for line in plan.splitlines()) <= 3


@pytest.mark.parametrize("seed", range(3))
def test_small_groups_with_null_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 1.0, 2.0, 5.0])) for _ in range(40)]
    found = {r["g"]: r for r in group_stats(spark.createDataFrame(rows, "g int, v double"), ["g"], ["v"], (0.1, 0.25, 0.75)).collect()}
    for g in {g for g, v in rows if v is not None}:
        mine = [v for h, v in rows if h == g and v is not None]
        for q, name in ((0.1, "p10"), (0.25, "p25"), (0.75, "p75")):
            assert found[g][name] == pytest.approx(np.quantile(mine, q), abs=1e-12)


def test_keys_may_have_any_name(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 2, 7.0), (3, 2, 1.0)], "_side int, _q int, v double")
    found = group_stats(df, ["_side", "_q"], ["v"])
    assert found.columns[:3] == ["_side", "_q", "measure"]
    assert sorted((r["_side"], r["_q"], r["p50"]) for r in found.collect()) == [(1, 2, 6.0), (3, 2, 1.0)]


@pytest.mark.parametrize("few", [0, 20_000])
def test_rows_of_large_groups_stay_where_they_are(spark, tmp_path, monkeypatch, few):
    """Rows meet their group's marks without an exchange of rows or a broadcast of them."""
    monkeypatch.setattr(facts, "FEW", few)
    monkeypatch.setattr(facts, "GRAIN", 500)
    path = str(tmp_path / "values")
    # Two large groups of few different values (rows that compress to nothing), and small ones.
    spark.range(40_000).selectExpr(
        "if(id % 100 < 98, id % 2, id % 1000) AS g", "(id * 7 % 11) / 100.0D AS v"
    ).repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    stats = group_stats(df, ["g"], ["v"], (0.25, 0.5, 0.75))
    wanted = df.groupBy("g").agg(*[facts.F.percentile("v", q).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75)])
    shown = lambda d: sorted(tuple(round(x, 9) for x in r) for r in d.select("g", "p25", "p50", "p75").collect())
    assert shown(stats) == shown(wanted)
    if few:
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_raw_rows_are_not_sorted(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(5000).selectExpr("id % 3 AS g", "id * 7 % 1001 / 7 AS v").write.parquet(path)
    stats = group_stats(spark.read.parquet(path), ["g"], ["v"], (0.25, 0.5))
    plan = stats._jdf.queryExecution().executedPlan().toString().splitlines()
    partial = [line for line in plan if "partial_min" in line]
    assert len(partial) == 1 and "HashAggregate" in partial[0]
    scan = next(i for i, line in enumerate(plan) if "Scan parquet" in line and "Sort" not in line)
    at = plan.index(partial[0])
    assert not any("Sort" in line or "hashpartitioning" in line for line in plan[at : scan + 1])
