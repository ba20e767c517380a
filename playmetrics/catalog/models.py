"""Folds, encodings, feature scores, classifiers and clusters on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, models, stats
from ..operators.players import one_hot
from ..sources.tables import settle
from .events import profile
from .registry import query, rounded, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABEL = "(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)"
PROFILE_FEATURES = ["freq", "ratio", "retained", "slot_afternoon", "slot_morning", "slot_night", "slot_noon"]


def lines(spark, sf):
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES, label.alias("label"))


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "stratified_folds",
    """SELECT o_orderkey, o_orderstatus, CAST(ntile(6) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders""",
)
def _(spark, sf):
    folds = models.stratified_folds(orders(spark, sf), "o_orderstatus", ["o_orderkey"], 6)
    return folds.select("o_orderkey", "o_orderstatus", "fold")


@query("kfold", "SELECT o_orderkey, CAST(ntile(10) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def _(spark, sf):
    return models.kfold(orders(spark, sf), ["o_orderkey"], 10).select("o_orderkey", "fold")


@query("random_split")
def _(spark, sf):
    train, test = models.random_split(orders(spark, sf), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select("o_orderkey", "part")


@query(
    "standardize",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) + 0.0 AS {c}" for c in FEATURES)
    + " FROM lineitem",
)
def _(spark, sf):
    scaled = stats.standardize(lines(spark, sf).drop("label"), FEATURES)
    return rounded(scaled, 5)


@query("unstandardize", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({c}, 4) AS {c}' for c in FEATURES)} FROM lineitem")
def _(spark, sf):
    data = lines(spark, sf).drop("label")
    return rounded(stats.unstandardize(stats.standardize(data, FEATURES), data, FEATURES), 4)


@query(
    "binarize_scaled",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"CAST({c} > avg({c}) OVER () AS INTEGER) AS {c}" for c in FEATURES)
    + " FROM lineitem",
)
def _(spark, sf):
    return stats.binarize_scaled(lines(spark, sf).drop("label"), FEATURES)


@query(
    "encode_categories",
    """WITH t AS (SELECT p_partkey, nullif(p_size, 7)::DOUBLE AS p_size, nullif(p_type, 'ECONOMY') AS p_type, p_brand FROM part),
    f AS (SELECT p_partkey, coalesce(p_size, (SELECT median(p_size) FROM t)) AS p_size,
      coalesce(p_type, (SELECT p_type FROM t WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_type, p_brand FROM t)
    SELECT p_partkey, p_size, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
    CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand FROM f""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.nullif("p_size", F.lit(7)).cast("double").alias("p_size"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("p_type"),
        "p_brand",
    )
    return models.encode_categories(part, median=["p_size"], mode=["p_type"])


@query(
    "one_hot",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(l_returnflag = '{v}' AS INTEGER) AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem",
)
def _(spark, sf):
    return one_hot(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"])


GUESS = "(CASE WHEN l_quantity > 40 THEN 2 WHEN l_discount > 0.05 THEN 1 ELSE 0 END)"


def guessed(spark, sf):
    guess = F.when(F.col("l_quantity") > 40, 2).when(F.col("l_discount") > 0.05, 1).otherwise(0)
    return lines(spark, sf).withColumn("prediction", guess)


@query(
    "classification_report",
    f"""WITH t AS (SELECT {LABEL} AS a, {GUESS} AS b FROM lineitem), c AS (SELECT unnest([0, 1, 2]) AS class)
    SELECT class, count(*) FILTER (a = class) AS support,
    round(count(*) FILTER (a = class AND b = class) / count(*) FILTER (b = class), 6) AS precision,
    round(count(*) FILTER (a = class AND b = class) / count(*) FILTER (a = class), 6) AS recall,
    round(2 * count(*) FILTER (a = class AND b = class) / (count(*) FILTER (a = class) + count(*) FILTER (b = class)), 6) AS f1,
    round(avg((a = b)::INT), 6) AS accuracy FROM t, c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(models.classification_report(guessed(spark, sf)))


@query(
    "confusion_matrix",
    f"""WITH t AS (SELECT {LABEL} AS label, {GUESS} AS prediction FROM lineitem)
    SELECT label, prediction, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM t GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(models.confusion_matrix(guessed(spark, sf)))


CHI2 = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(2 AS BIGINT) AS dof, round(sum((o - n / t.n_all * t.s_all) ** 2 / (n / t.n_all * t.s_all)), 4) AS chi2
    FROM (SELECT l_returnflag, sum({c}) AS o, count(*) AS n FROM lineitem GROUP BY 1),
    (SELECT sum({c}) AS s_all, count(*) AS n_all FROM lineitem) t"""
    for c in FEATURES
)


@query("chi2_scores", CHI2)
def _(spark, sf):
    return rounded(models.chi2_scores(lines(spark, sf), FEATURES, "label").select("feature", "dof", "chi2"), 4)


@query("chi2_p")
def _(spark, sf):
    return models.chi2_scores(lines(spark, sf), FEATURES, "label")


@query("chi2_best_k", f"SELECT feature, chi2 FROM ({CHI2}) ORDER BY chi2 DESC, feature LIMIT 2")
def _(spark, sf):
    scores = models.chi2_scores(lines(spark, sf), FEATURES, "label")
    return rounded(models.best_k(scores.select("feature", "chi2"), "chi2", 2), 4)


ANOVA = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round((sum(n * (m - t.m_all) ** 2) / 2) / (sum(n * v) / (sum(n) - 3)), 6) AS f,
    CAST(2 AS BIGINT) AS "between", CAST(sum(n) - 3 AS BIGINT) AS "within"
    FROM (SELECT l_returnflag, avg({c}) AS m, var_pop({c}) AS v, count(*) AS n FROM lineitem GROUP BY 1), (SELECT avg({c}) AS m_all FROM lineitem) t"""
    for c in FEATURES
)


@query("anova_scores", ANOVA)
def _(spark, sf):
    return rounded(models.anova_scores(lines(spark, sf), FEATURES, "label").drop("p"))


@query("anova_p")
def _(spark, sf):
    return models.anova_scores(lines(spark, sf), FEATURES, "label")


def _binary_chi2() -> str:
    flags = ", ".join(f"({c} > avg({c}) OVER ())::INT AS {c}" for c in FEATURES)
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, sum((o - n / t.n_all * t.s_all) ** 2 / (n / t.n_all * t.s_all)) AS score
        FROM (SELECT l_returnflag, sum({c}) AS o, count(*) AS n FROM bin GROUP BY 1), (SELECT sum({c}) AS s_all, count(*) AS n_all FROM bin) t"""
        for c in FEATURES
    )
    return f"""WITH bin AS (SELECT l_returnflag, {flags} FROM lineitem), chi AS ({parts}), fs AS ({ANOVA})
    SELECT feature FROM chi WHERE score > (SELECT quantile_cont(score, 0.4) FROM chi)
    INTERSECT SELECT feature FROM fs WHERE f > (SELECT quantile_cont(f, 0.4) FROM fs)"""


@query("select_both", _binary_chi2())
def _(spark, sf):
    data = lines(spark, sf)
    binary = stats.binarize_scaled(data, FEATURES)
    return models.select_both(binary, data, FEATURES, "label", percent=60)


# Fitted models --------------------------------------------------------------------------------


def folded(spark, sf, folds: int = 6):
    split = models.stratified_folds(lines(spark, sf), "label", ["l_orderkey", "l_linenumber"], folds)
    return models.assemble(settle(split, "folds"), FEATURES, "label", ["fold"])


@query("decision_tree")
def _(spark, sf):
    scored, _ = models.cross_validate(models.decision_tree(), folded(spark, sf), 6)
    return rounded(models.fold_scores(scored))


@query("tree_table")
def _(spark, sf):
    model = models.decision_tree().fit(models.assemble(lines(spark, sf), FEATURES, "label"))
    return models.tree_table(model, FEATURES, spark)


def profile_data(spark, sf):
    """The profile with the vip flag as label; players without a session before VIP are left out."""
    clean = profile(spark, sf).na.drop("any")
    return settle(clean.withColumn("vip", F.col("vip").cast("int")), "profile")


@query("random_forest")
def _(spark, sf):
    data = models.assemble(profile_data(spark, sf), PROFILE_FEATURES, "vip")
    model = models.random_forest(250).fit(models.spread(data, models.FOREST_ROWS))
    return models.ranked_weights(model.featureImportances.toArray(), PROFILE_FEATURES, spark, "importance")


@query("logistic_l1")
def _(spark, sf):
    data = profile_data(spark, sf).select(*[F.col(c).cast("double").alias(c) for c in PROFILE_FEATURES], "vip")
    scaled = models.assemble(stats.standardize(data, PROFILE_FEATURES), PROFILE_FEATURES, "vip")
    model = models.logistic_l1(data.count()).fit(scaled)
    return models.ranked_weights(model.coefficients.toArray(), PROFILE_FEATURES, spark, "coefficient")


def numeric_profile(spark, sf):
    """Player, all features as numbers, and the vip flag."""
    return profile_data(spark, sf).select("player", *[F.col(c).cast("double").alias(c) for c in PROFILE_FEATURES], "vip")


def profile_folds(data):
    return settle(models.stratified_folds(data, "vip", ["player"], 6), "folds")


@query("random_forest_folds")
def _(spark, sf):
    data = models.assemble(profile_folds(numeric_profile(spark, sf)), PROFILE_FEATURES, "vip", ["fold"])
    scored, _ = models.cross_validate(models.random_forest(250), models.spread(data, models.FOREST_ROWS), 6)
    return rounded(models.fold_confusion(scored))


@query("logistic_l1_folds")
def _(spark, sf):
    scaled = stats.standardize(profile_folds(numeric_profile(spark, sf)), PROFILE_FEATURES)
    data = models.assemble(settle(scaled, "scaled"), PROFILE_FEATURES, "vip", ["fold"])
    scored, _ = models.cross_validate(models.logistic_l1, models.spread(data, models.MODEL_ROWS), 6)
    return rounded(models.fold_confusion(scored))


@query("classify_users")
def _(spark, sf):
    return models.classify_users(numeric_profile(spark, sf), ["player"], "vip", PROFILE_FEATURES)


@query("classify_users_balanced")
def _(spark, sf):
    return models.classify_users(numeric_profile(spark, sf), ["player"], "vip", PROFILE_FEATURES, balance=True)


@query("borderline_smote")
def _(spark, sf):
    scaled = settle(stats.standardize(numeric_profile(spark, sf), PROFILE_FEATURES), "scaled")
    return balance.borderline_smote(scaled, PROFILE_FEATURES, "vip", "player")


@query(
    "border_positions",
    """WITH p AS (SELECT c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y, count(*) FILTER (c_mktsegment = 'BUILDING') AS few,
      count(*) FILTER (c_mktsegment <> 'BUILDING') AS many FROM customer GROUP BY 1, 2),
    d AS (SELECT q.x AS qx, q.y AS qy, q.few AS qfew, q.many AS qmany, p.x, p.y, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS dist,
      p.few - (q.x = p.x AND q.y = p.y)::INT AS few, p.many FROM p q, p WHERE q.few > 0),
    b AS (SELECT *, greatest(10 - coalesce(sum(few + many) OVER (PARTITION BY qx, qy ORDER BY dist, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM d),
    m AS (SELECT qx, qy, qfew, qmany, CAST(sum(least(many, greatest(room - few, 0))) AS BIGINT) AS majority FROM b GROUP BY 1, 2, 3, 4)
    SELECT qx AS x, qy AS y, qfew AS few, qmany AS many, majority FROM m WHERE majority >= 5 AND majority < 10""",
)
def _(spark, sf):
    small = F.col("c_mktsegment") == "BUILDING"
    data = table(spark, sf, "customer").groupBy(
        (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y")
    )
    counted = data.agg(F.count_if(small).alias("few"), F.count_if(~small).alias("many"))
    positions = settle(counted.withColumn("qid", F.xxhash64("x", "y")), "positions")
    return balance.border_positions(positions, ["x", "y"]).drop("qid")


DIMENSIONS = 64


@query("kmeans_sweep")
def _(spark, sf):
    return models.kmeans_sweep(profile_data(spark, sf), PROFILE_FEATURES, (2, 3))


@query("kmeans_embeddings")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMENSIONS)])
    return models.kmeans_sweep(vectors, vectors.columns, (2, 3, 4, 5))


SILHOUETTE_COORDS = [f"x{i}" for i in range(DIMENSIONS)]


@query(
    "silhouette",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS s, count(*) AS n
      FROM v a, v b GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY 1, 2),
    r AS (SELECT label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM m)
    SELECT label AS cluster, count(*) AS rows, round(avg(s), 6) AS silhouette FROM r GROUP BY 1
    UNION ALL SELECT NULL, count(*), round(avg(s), 6) FROM r""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMENSIONS)])
    return rounded(models.silhouette(vectors, SILHOUETTE_COORDS, "label"))


@query("naive_bayes")
def _(spark, sf):
    return models.naive_bayes_accuracy(lines(spark, sf), FEATURES, "label", ["l_orderkey", "l_linenumber"])
