import numpy as np
import pytest

from playmetrics.catalog import QUERIES
from playmetrics.catalog.models import PROFILE_FEATURES
from playmetrics.operators import balance

FEATURES = ["x", "y"]


def cloud(n, seed=3):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.15).astype(int)
    points = rng.normal(size=(n, 2)) + label[:, None] * 1.2
    return points, label


@pytest.mark.parametrize("box", [4, 40, 100_000])
def test_nearest_equals_brute_force(spark, monkeypatch, box):
    monkeypatch.setattr(balance, "BOX_ROWS", box)
    points, label = cloud(400)
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(points)], "pid bigint, x double, y double")
    queries = df.where("pid < 60").withColumnRenamed("pid", "qid")
    found = {}
    for r in balance.nearest(queries, df, FEATURES, 7).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["pid"])
    d = ((points[:60, None] - points[None]) ** 2).sum(2)
    assert found == {i: list(np.argsort(d[i], kind="stable")[:7]) for i in range(60)}


def test_cells_are_dealt_out_by_number(spark, monkeypatch):
    """Small bytes, much work: the searches of different cells are not put together into one task."""
    monkeypatch.setattr(balance, "BOX_ROWS", 20)
    points, _ = cloud(400)
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(points)], "pid bigint, x double, y double")
    found = balance.nearest(df.withColumnRenamed("pid", "qid"), df, FEATURES, 3)
    assert len(found.collect()) == 1200
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "hashpartitioning(cell" in line]
    assert dealt and all("5), REPARTITION_BY_NUM" in line for line in dealt)


def test_full_cells_are_cut_again(spark, monkeypatch):
    # Nearly all points lie in one corner, which the few boxes of the driver leave to one cell.
    monkeypatch.setattr(balance, "BOX_ROWS", 25)
    monkeypatch.setattr(balance, "BOXES", 2)
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(600, 2)) * 1e-3, rng.normal(size=(40, 2)) * 50, np.repeat([[7.0, 7.0]], 60, axis=0)])
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(points)], "pid bigint, x double, y double")
    corners = spark.createDataFrame([(0, 0, [-np.inf] * 2, [np.inf] * 2)], "box bigint, cell bigint, low array<double>, high array<double>")
    at = df.withColumn("cell", balance.F.lit(0).cast("bigint"))
    placed, _, cells = balance._cells(at, at.limit(3), FEATURES, corners)
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    # Only the cell of 60 equal points cannot be cut.
    assert sum(sizes.values()) == 700 and sorted(sizes.values())[-1] == 60 and sorted(sizes.values())[-2] <= 25
    inside = {r["cell"]: (r["low"], r["high"]) for r in cells.collect()}
    for r in placed.collect():
        low, high = inside[r["cell"]]
        assert low[0] <= r["x"] < high[0] and low[1] <= r["y"] < high[1]
    found = {}
    for r in balance.nearest(df.where("pid % 9 = 0").withColumnRenamed("pid", "qid"), df.where("pid < 641"), FEATURES, 5).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["pid"])
    d = ((points[:, None] - points[None, :641]) ** 2).sum(2)
    assert found == {i: list(np.argsort(d[i], kind="stable")[:5]) for i in range(0, 700, 9)}


def test_many_copies_of_one_position_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(balance, "COPIES", 7)
    points, label = cloud(200, 9)
    rows = [(i, float(p[0]), float(p[1]), int(c)) for i, (p, c) in enumerate(zip(points, label))]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label int")
    few = sorted(map(tuple, balance.borderline_smote(df, FEATURES, "label", "id").collect()))
    monkeypatch.setattr(balance, "COPIES", 10_000)
    assert few == sorted(map(tuple, balance.borderline_smote(df, FEATURES, "label", "id").collect()))


def test_border_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balance, "BOX_ROWS", 30)
    points, label = cloud(300, 5)
    points = np.round(points, 1)  # positions repeat
    rows = [(i, float(p[0]), float(p[1]), int(c)) for i, (p, c) in enumerate(zip(points, label))]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label int")
    positions = df.groupBy(*FEATURES).agg(
        balance.F.min("id").alias("qid"),
        balance.F.count_if(balance.F.col("label") == 1).alias("few"),
        balance.F.count_if(balance.F.col("label") == 0).alias("many"),
    )
    found = {(r["x"], r["y"]): r["majority"] for r in balance.border_positions(positions, FEATURES).collect()}
    wanted = {}
    for i in np.nonzero(label == 1)[0]:
        d = np.sqrt(((points[i] - points) ** 2).sum(1))
        order = sorted((j for j in range(300) if j != i), key=lambda j: (d[j], points[j][0], points[j][1], 1 - label[j]))[:10]
        many = sum(label[j] == 0 for j in order)
        if 5 <= many < 10:
            wanted[(float(points[i][0]), float(points[i][1]))] = many
    assert found == wanted and len(wanted) > 5


def test_classes_become_even(spark):
    points, label = cloud(500, 7)
    rows = [(i, float(p[0]), float(p[1]), int(c)) for i, (p, c) in enumerate(zip(points, label))]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label int")
    made = balance.borderline_smote(df, FEATURES, "label", "id")
    data = made.collect()
    sizes = [sum(r["label"] == c for r in data) for c in (0, 1)]
    assert sizes[0] == int((label == 0).sum()) and abs(sizes[1] / sizes[0] - 1) < 0.1
    assert sum(r["copy"] == 0 for r in data) == 500
    low, high = points.min(0), points.max(0)
    assert all(low[0] <= r["x"] <= high[0] and low[1] <= r["y"] <= high[1] for r in data)
    again = balance.borderline_smote(df.repartition(3), FEATURES, "label", "id").collect()
    assert sorted(map(tuple, data)) == sorted(map(tuple, again))


def test_query_balances_on_all_profile_features(spark):
    made = QUERIES["borderline_smote"](spark, "/root/testdata/sf0.001")
    assert made.columns == ["player", *PROFILE_FEATURES, "vip", "copy"]
    assert made.where("copy = 0").count() > 0
