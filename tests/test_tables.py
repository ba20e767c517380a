"""Sources, column helpers, statistics and models on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmetrics.catalog import QUERIES
from playmetrics.functions.special import beta_inc, gamma_upper
from playmetrics.operators import frames, models, stats
from playmetrics.sources import tables as io
from playmetrics.sources.events import as_events

from .conftest import make, table


def test_adapter(spark):
    raw = spark.sql(
        "SELECT 36028840373811787L AS uid, timestamp_ntz'2024-03-10 02:30:00.9' AS t, 5 AS id, 'x' AS what UNION ALL SELECT null, null, 1, 'y'"
    )
    expected = [(36028840373811787, 1710037800, 5, "x")]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert table(as_events(raw, "uid", "t", "id", action="what")) == expected
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(TypeError):
        as_events(raw.withColumn("uid", F.col("uid").cast("double")), "uid", "t", "id")


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([("ID,a,b,T",), ("1,2.5,0,1",), ("2,0,3,0",)], "value string").coalesce(1)
    lines.write.text(str(tmp_path / "lines"))
    assert table(io.read_labelled_lines(spark, str(tmp_path / "lines")), "id", "label") == [(1, 1.0), (2, 0.0)]
    names = spark.createDataFrame([(" Win/Buy{0}/B{0} ",), ("Plain",), ("Plain",), ("",)], "value string")
    names.write.text(str(tmp_path / "names"))
    found = [n for (n,) in table(io.read_names(spark, str(tmp_path / "names"), 3))]
    assert found == ["Plain", "Win/Buy0/B0", "Win/Buy1/B1", "Win/Buy2/B2"]
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    path = io.write_result(df, str(tmp_path / "out"), "r1", "csv")
    assert table(io.read_csv(spark, path, "a int, b string")) == [(1, "x")]
    events = make(spark, [dict(player=p, ts=p) for p in (1, 2)])
    assert table(spark.read.parquet(io.write_player(events, 2, str(tmp_path / "p"))), "player") == [(2,)]
    assert table(io.settle(df, "t")) == [(1, "x")]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 4.0, "b"), (3, 9.0, "b"), (4, None, "a")], "k int, v double, s string")
    assert table(df.select(frames.zero_count(["k", "v"]).alias("z"))) == [(0,), (0,), (0,), (1,)]
    assert table(frames.impute(df, "v", "median"), "k", "v")[3] == (4, 4.0)
    assert table(frames.impute(df, "s", "mode"), "k", "s")[0] == (1, "b")
    assert table(frames.without_maximum(df, "v"), "k") == [(1,), (2,), (4,)]
    series = frames.padded_series(make(spark, [dict(player=1, ts=t, key_index=t) for t in (1, 2)]), "key_index", 4)
    assert table(series) == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 2)]
    assert table(stats.null_summary(df), "column", "nulls") == [("k", 0), ("s", 1), ("v", 1)]
    assert table(stats.most_common(df, [], "s").select("s", "rows")) == [("b", 2)]


def test_constant_column_has_score_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert table(stats.standardize(df)) == [(-1.0, 0.0), (1.0, 0.0)]
    assert table(stats.unstandardize(stats.standardize(df), df, ["a", "b"])) == [(1.0, 5.0), (3.0, 5.0)]


def test_p_values():
    # Standard tables of the t, chi-square and F distributions.
    assert beta_inc(5.0, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)
    assert gamma_upper(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert gamma_upper(5.0, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)
    assert beta_inc(10.0, 1.5, 20 / (20 + 3 * 3.098391)) == pytest.approx(0.05, abs=1e-6)
    assert gamma_upper(1.0, 3.0) == pytest.approx(math.exp(-3.0))


def features(spark, n=240):
    rng = np.random.default_rng(5)
    rows = [(i, float(i % 2), float(rng.normal(2.0 * (i % 2), 1.0)), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label double, x double, noise double")


def test_folds_are_even_and_stratified(spark):
    df = features(spark, 101)
    # Whole numbers that lie far apart, and text, as the order.
    for order in ("id", "wide", "name"):
        ordered = df.withColumn("wide", F.col("id") * 10**15).withColumn("name", F.format_string("n%05d", "id"))
        kept = models.stratified_folds(ordered, "label", [order], 6)
        sizes = kept.groupBy("label", "fold").count().collect()
        assert len(sizes) == 12 and {r["count"] for r in sizes} <= {8, 9}
        parts = [r["fold"] for r in models.kfold(ordered, [order], 10).orderBy("id").collect()]
        assert parts == [int(i) for i in np.repeat(range(10), [11] + [10] * 9)]
    train, test = models.random_split(df, ["id"])
    again, _ = models.random_split(df.repartition(5), ["id"])
    assert train.count() + test.count() == 101 and table(train) == table(again)


def test_clusters_of_flags_with_silhouettes(spark):
    df = features(spark).withColumn("flag", F.col("label") == 1)
    found = models.kmeans_sweep(df, ["flag", "x"], (2, 3)).collect()
    assert [(r["k"], r["cluster"]) for r in found] == [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    for r in found:
        assert r["size"] > 0 and -1 <= r["silhouette"] <= 1
        mine = [x for x in found if x["k"] == r["k"]]
        assert r["mean_silhouette"] == pytest.approx(sum(x["size"] * x["silhouette"] for x in mine) / 240)
    assert sorted(round(r["flag"]) for r in found[:2]) == [0, 1]


def test_categories_are_ranked_with_nulls_last(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["b", None, "a", "b", "c", None])], "id int, t string")
    assert table(models.encode_categories(df)) == [(0, 1), (1, 3), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_scores_against_numpy(spark):
    df = features(spark)
    data = {c: np.array([r[c] for r in df.orderBy("id").collect()]) for c in ("label", "x", "noise")}
    scores = {r["feature"]: r for r in models.anova_scores(df, ["x", "noise"], "label").collect()}
    for c in ("x", "noise"):
        groups = [data[c][data["label"] == k] for k in (0, 1)]
        between = sum(len(g) * (g.mean() - data[c].mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert scores[c]["f"] == pytest.approx(between / (within / 238))
    assert scores["x"]["p"] < 1e-20 and scores["noise"]["p"] > 1e-4
    pearson = stats.pearson_with_target(df, ["x", "noise"], "label").collect()
    # With two classes both tests are the same test.
    for r in pearson:
        assert r["p"] == pytest.approx(scores[r["feature"]]["p"], rel=1e-6)
    with pytest.raises(Exception, match="negative values"):
        models.chi2_scores(df, ["x"], "label").collect()
    positive = df.withColumn("x", F.abs("x"))
    found = models.best_k(models.chi2_scores(positive, ["x", "noise"], "label"), "chi2", 1)
    assert [r["feature"] for r in found.collect()] == ["x"]


def test_models_on_planted_data(spark):
    df = features(spark)
    report = models.classify_users(df, ["id"], "label", ["x", "noise"], folds=2, trees=10)
    balanced = models.classify_users(df, ["id"], "label", ["x", "noise"], folds=2, trees=10, balance=True).collect()
    assert len(balanced) == 6 and all(r["accuracy"] > 0.7 for r in balanced)
    folded = models.assemble(models.stratified_folds(df, "label", ["id"], 3), ["x", "noise"], "label", ["fold"])
    confusion = models.fold_confusion(models.cross_validate(models.decision_tree(), folded, 3)[0]).collect()
    assert sum(r["rows"] for r in confusion) == 240 and {r["fold"] for r in confusion} == {0, 1, 2}
    for r in confusion:
        mine = [x for x in confusion if x["fold"] == r["fold"]]
        right = sum(x["rows"] for x in mine if x["label"] == x["prediction"])
        assert r["accuracy"] == pytest.approx(right / sum(x["rows"] for x in mine))
    rows = report.collect()
    assert len(rows) == 6 and all(r["accuracy"] > 0.75 for r in rows)
    model = models.decision_tree().fit(models.assemble(df, ["x", "noise"], "label"))
    tree = models.tree_table(model, ["x", "noise"], spark).collect()
    assert tree[0]["feature"] == "x" and tree[0]["rows"] == 240 and tree[0]["parent"] is None
    assert all(sum(k["rows"] for k in tree if k["parent"] == t["node"]) in (0, t["rows"]) for t in tree)
    sweep = models.kmeans_sweep(df, ["x", "noise"], (2, 3)).collect()
    inertia = {r["k"]: r["inertia"] for r in sweep}
    assert inertia[3] < inertia[2] and sum(r["size"] for r in sweep if r["k"] == 2) == 240
    nb = models.naive_bayes_accuracy(df.withColumn("x", F.abs("x")), ["x", "noise"], "label", ["id"]).collect()[0]
    assert 0.4 < nb["accuracy"] <= 1.0


def test_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 2))
    labels = [0] * 30 + [1] * 29 + [2]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in zip(labels, points)], "c int, x double, y double")
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    lab = np.array(labels)
    s = []
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        b = min(d[i][lab == k].mean() for k in set(labels) - {labels[i]})
        s.append(0.0 if not own.any() else (b - d[i][own].mean()) / max(b, d[i][own].mean()))
    found = {r["cluster"]: r["silhouette"] for r in models.silhouette(df, ["x", "y"], "c").collect()}
    assert found[None] == pytest.approx(np.mean(s))
    assert found[0] == pytest.approx(np.mean(s[:30])) and found[2] == 0.0


def test_class_sizes_go_to_the_rows(spark, monkeypatch):
    """The rows of a class are not dealt to one task: the join with class sizes moves no rows."""
    df = spark.range(900).selectExpr("id", "if(id % 9 = 0, null, id % 2) AS c")
    written = []
    monkeypatch.setattr(models, "settle", lambda df, name: written.append(name) or io.settle(df, name))
    found = models.stratified_folds(df, "c", ["id"], 6)
    assert written == ["ranked", "classes"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(c" not in plan
    sizes = {(r["c"], r["fold"]): r["count"] for r in found.groupBy("c", "fold").count().collect()}
    assert len(sizes) == 18 and sum(sizes.values()) == 900 and max(sizes.values()) - min(sizes.values()) < 60


def test_fits_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "folds")
    spark.range(400).selectExpr("CAST(id % 2 AS DOUBLE) AS x", "id % 2 AS c", "id DIV 2 % 2 AS fold").coalesce(1).write.parquet(path)
    data = models.assemble(spark.read.parquet(path), ["x"], "c", ["fold"])
    assert data.rdd.getNumPartitions() == 1 and models.spread(data, 400) is data
    dealt = models.spread(data, 50)
    assert dealt.rdd.getNumPartitions() == 8
    count = lambda d: sorted(d.groupBy("fold", "label").count().collect())
    assert count(dealt) == count(data)
    scored, _ = models.cross_validate(models.random_forest(5), dealt, 2)
    assert [(r["rows"], r["accuracy"]) for r in models.fold_scores(scored).orderBy("fold").collect()] == [(200, 1.0)] * 2
    # The query deals its rows out.
    seen = []
    monkeypatch.setattr(models, "cross_validate", lambda estimator, data, folds: seen.append(data) or (data.withColumn("prediction", F.col("label")), None))
    monkeypatch.setattr(models, "FOREST_ROWS", 3)
    QUERIES["random_forest_folds"](spark, "/root/testdata/sf0.001")
    assert seen[0].rdd.getNumPartitions() == -(-seen[0].count() // 3)
