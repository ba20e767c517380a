"""Feature scores, folds, classifiers and clusters on a table of features.

Feature scores, folds and reports are plain aggregations.  Classifiers and clusters are
``pyspark.ml`` estimators.  Differences from the usual single-machine settings:

* a tree's ``min_samples_split=20`` becomes ``minInstancesPerNode=10``, the nearest Spark rule;
* L1 strength ``C = 1`` becomes ``regParam = 1 / rows``, as Spark averages the loss;
* the silhouette uses squared Euclidean distance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_p, f_p
from ..plans.facts import with_facts
from ..plans.ranks import running_total
from ..sources.tables import settle
from .balance import borderline_smote
from .frames import impute
from .stats import column_moments, standardize


# Folds ---------------------------------------------------------------------------------------


def _contiguous(rn: Column, n: Column, k: int) -> Column:
    """Part 0..k-1 of position ``rn`` when ``n`` rows are cut into ``k`` even stretches, the
    first ``n % k`` one row longer."""
    small, longer = F.floor(n / k), n % k
    edge = longer * (small + 1)
    return F.when(rn <= edge, F.floor((rn - 1) / (small + 1))).otherwise(
        longer + F.floor(F.try_divide(rn - 1 - edge, small))
    ).cast("int")


def kfold(df: DataFrame, order: Sequence[str], k: int = 10) -> DataFrame:
    """Contiguous folds in ``order``; adds ``fold``."""
    placed = running_total(df, order, F.lit(1), "_at")
    return placed.withColumn("fold", _contiguous(F.col("_at") + 1, F.lit(df.count()), k)).drop("_at")


def stratified_folds(df: DataFrame, label: str, order: Sequence[str], k: int = 6) -> DataFrame:
    """Folds that are contiguous within each class; adds ``fold``. Null is a class of its own."""
    # Ranks in (class, order) over all rows, less the rows of the classes before.
    placed = settle(running_total(df, [label, *order], F.lit(1), "_at"), "ranked")
    classes = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    found = with_facts(placed, settle(classes, "classes"), F.col(label).eqNullSafe(F.col("_class")), F.col("_size"))
    fold = _contiguous(F.col("_at") - F.col("_first") + 1, F.col("_size"), k)
    return found.withColumn("fold", fold).drop("_at", "_first", "_size", "_class")


def random_split(df: DataFrame, ids: Sequence[str], share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts by a seeded hash of the row's id: the same on every run and partitioning."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1_000_000))
    chosen = draw < int(share * 1_000_000)
    return df.where(chosen), df.where(~chosen)


# Encoding ------------------------------------------------------------------------------------


def encode_categories(df: DataFrame, median: Sequence[str] = (), mode: Sequence[str] = ()) -> DataFrame:
    """Impute the named columns, then replace every text column by its value's rank in sorted order, null last."""
    for c in median:
        df = impute(df, c, "median")
    for c in mode:
        df = impute(df, c, "mode")
    for c in [c for c, kind in df.dtypes if kind == "string"]:
        values = df.select(F.col(c).isNull().alias("_none"), F.col(c).alias("_value")).distinct()
        codes = running_total(values, ["_none", "_value"], F.lit(1), "_code")
        coded = df.join(codes, F.col(c).eqNullSafe(F.col("_value")))
        df = coded.select(*[F.col("_code").cast("int").alias(c) if x == c else F.col(x) for x in df.columns])
    return df


# Feature scores ------------------------------------------------------------------------------


def chi2_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of non-negative features against the class.

    Observed: the sum of the feature in each class; expected: its whole sum shared out by class
    frequency.  One aggregation by class; the rest works on one row per (feature, class).
    Columns ``feature, chi2, dof, p, neg_log10_p``.
    """
    bad = [F.min(c).alias(c) for c in features]
    by_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in features], *bad
    )
    long = by_class.select(
        label,
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.when(F.col(c) < 0, F.raise_error(F.lit(f"negative values in {c}")).cast("double"))
                        .otherwise(F.col(f"s_{c}"))
                        .alias("observed"),
                    )
                    for c in features
                ]
            )
        ),
    )
    totals = long.groupBy("feature").agg(
        F.sum("observed").alias("_sum"), F.sum("n").alias("_rows"), (F.count(F.lit(1)) - 1).alias("dof")
    )
    expected = F.col("n") / F.col("_rows") * F.col("_sum")
    part = F.try_divide(F.pow(F.col("observed") - expected, F.lit(2.0)), expected)
    return (
        long.join(totals, "feature")
        .groupBy("feature", "dof")
        .agg(F.sum(part).alias("chi2"))
        .withColumn("p", F.when(F.col("chi2").isNotNull(), chi2_p("chi2", "dof")))
        .withColumn("neg_log10_p", F.when(F.col("p") > 0, -F.log10("p")))
    )


def anova_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """F of each feature between classes; ``feature, f, between, within, p``.

    Class sums come from one aggregation over values centred on the column mean.
    """
    moments, _ = column_moments(df, features)
    centred = df.select(label, *[(F.col(c).cast("double") - moments[f"mean_{c}"]).alias(c) for c in features])
    by_class = centred.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in features],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in features],
    )
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q")) for c in features
    ]
    long = by_class.select("n", F.inline(F.array(*cells)))
    parts = long.groupBy("feature").agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_explained"),
        F.sum("s").alias("_sum"),
        F.sum("q").alias("_square"),
        F.sum("n").alias("_rows"),
        F.count(F.lit(1)).alias("_classes"),
    )
    between = F.col("_explained") - F.col("_sum") * F.col("_sum") / F.col("_rows")
    within = F.col("_square") - F.col("_explained")
    return (
        parts.withColumn("between", F.col("_classes") - 1)
        .withColumn("within", F.col("_rows") - F.col("_classes"))
        .withColumn("f", F.try_divide(between / F.col("between"), within / F.col("within")))
        .withColumn("p", F.when(F.col("f").isNotNull(), f_p("f", "between", "within")))
        .select("feature", "f", "between", "within", "p")
    )


def top_percent(scores: DataFrame, score: str, percent: float) -> DataFrame:
    """Features whose score lies above the ``100 - percent`` percentile of all scores."""
    bar = scores.agg(F.percentile(score, F.lit(1 - percent / 100))).scalar()
    return scores.where(F.col(score) > bar)


def best_k(scores: DataFrame, score: str, k: int = 5) -> DataFrame:
    """The ``k`` features with the highest score."""
    return scores.orderBy(F.col(score).desc(), "feature").limit(k)


def select_both(binary: DataFrame, df: DataFrame, features: Sequence[str], label: str, percent: float = 3) -> DataFrame:
    """Features in the top ``percent`` by chi-square (on ``binary``) and by F (on ``df``)."""
    chosen = top_percent(chi2_scores(binary, features, label), "chi2", percent).select("feature")
    return chosen.intersect(top_percent(anova_scores(df, features, label), "f", percent).select("feature"))


# Reports -------------------------------------------------------------------------------------


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows by (label, prediction), raw and as a share of the label."""
    counted = scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("rows"))
    size = counted.groupBy(label).agg(F.sum("rows").alias("_size"))
    return counted.join(size, label).select(label, prediction, "rows", (F.col("rows") / F.col("_size")).alias("share"))


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: support, precision, recall and F1, with the overall accuracy on every row."""
    counted = scored.groupBy(F.col(label).alias("a"), F.col(prediction).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    hits = F.sum(F.when(F.col("actual") & F.col("same"), F.col("m")).otherwise(F.lit(0)))
    sides = counted.select(
        "m",
        F.inline(
            F.array(
                F.struct(F.col("a").alias("class"), F.lit(True).alias("actual"), (F.col("a") == F.col("b")).alias("same")),
                F.struct(F.col("b").alias("class"), F.lit(False).alias("actual"), (F.col("a") == F.col("b")).alias("same")),
            )
        ),
    )
    per_class = sides.groupBy("class").agg(
        hits.alias("hits"),
        F.sum(F.when(F.col("actual"), F.col("m")).otherwise(F.lit(0))).alias("support"),
        F.sum(F.when(~F.col("actual"), F.col("m")).otherwise(F.lit(0))).alias("predicted"),
    )
    overall = per_class.agg(F.sum("hits") / F.sum("support")).scalar()
    precision, recall = F.try_divide("hits", "predicted"), F.try_divide("hits", "support")
    return per_class.select(
        "class",
        "support",
        F.coalesce(precision, F.lit(0.0)).alias("precision"),
        F.coalesce(recall, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0)).alias("f1"),
        overall.alias("accuracy"),
    )


# Classifiers ---------------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str], label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns to one vector ``features``, the label to ``label`` as a number."""
    extra = [F.col(label).cast("double").alias("label")] if label else []
    typed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features], *extra)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(typed)


def decision_tree(max_depth: int = 3, min_split: int = 20) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=max(min_split // 2, 1), seed=0)


def random_forest(trees: int = 250) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, seed=0)


def logistic_l1(rows: int, c: float = 1.0) -> LogisticRegression:
    """L1 penalty for standardised features; ``rows`` is the size of the training set."""
    return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * rows), standardization=False, maxIter=200)


#: Rows of one task: a forest follows each through all its trees, the other models do little with one.
FOREST_ROWS, MODEL_ROWS = 10_000, 100_000


def spread(data: DataFrame, rows: int) -> DataFrame:
    """Deal a table out to tasks of about ``rows`` rows, as its bytes may be few for the work of a fit.

    Up to ``rows`` rows stay as they are.  How rows lie decides the draws of a forest, not what it learns from.
    """
    parts = -(-data.count() // rows)
    return data.repartition(parts) if parts > 1 else data


def cross_validate(
    estimator: Estimator | Callable[[int], Estimator], data: DataFrame, folds: int
) -> tuple[DataFrame, object]:
    """Fit on all folds but one in turn; every row's out-of-fold prediction, and the last model.

    ``data`` has ``features``, ``label`` and ``fold``.  An estimator that depends on the number of
    training rows is given as a function of it.
    """
    scored, model = None, None
    for k in range(folds):
        train = data.where(F.col("fold") != k)
        model = (estimator if isinstance(estimator, Estimator) else estimator(train.count())).fit(train)
        part = model.transform(data.where(F.col("fold") == k)).select("fold", "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    return scored, model


def fold_scores(scored: DataFrame) -> DataFrame:
    """Accuracy of each fold."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def fold_confusion(scored: DataFrame) -> DataFrame:
    """Confusion matrix of each fold: ``fold, label, prediction, rows, share`` of the label, and ``accuracy`` of the fold."""
    counted = scored.groupBy("fold", "label", "prediction").agg(F.count(F.lit(1)).alias("rows"))
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(F.lit(0)))
    fold, row = Window.partitionBy("fold"), Window.partitionBy("fold", "label")
    return counted.select(
        "*", (F.col("rows") / F.sum("rows").over(row)).alias("share"), (hits.over(fold) / F.sum("rows").over(fold)).alias("accuracy")
    )


def tree_table(model, features: Sequence[str], spark) -> DataFrame:
    """Nodes of a fitted tree: ``node, parent, depth, feature, threshold, impurity, rows, counts, prediction``.

    A tree of depth d has at most ``2^(d+1) - 1`` nodes.
    """
    rows = []

    def walk(node, parent: int | None, depth: int) -> None:
        mine = len(rows)
        counts = [float(v) for v in node.impurityStats().stats()]
        leaf = node.subtreeDepth() == 0
        split = None if leaf else node.split()
        rows.append(
            (
                mine,
                parent,
                depth,
                None if leaf else features[split.featureIndex()],
                None if leaf else float(split.threshold()),
                float(node.impurity()),
                int(sum(counts)),
                counts,
                float(node.prediction()),
            )
        )
        if not leaf:
            walk(node.leftChild(), mine, depth + 1)
            walk(node.rightChild(), mine, depth + 1)

    walk(model._java_obj.rootNode(), None, 0)
    return spark.createDataFrame(
        rows,
        "node int, parent int, depth int, feature string, threshold double, impurity double, rows bigint, "
        "counts array<double>, prediction double",
    )


def ranked_weights(weights: Sequence[float], features: Sequence[str], spark, name: str = "weight") -> DataFrame:
    """One row per feature with its importance or coefficient, ranked by size."""
    order = sorted(range(len(features)), key=lambda i: (-abs(float(weights[i])), features[i]))
    rows = [(rank + 1, features[i], float(weights[i])) for rank, i in enumerate(order)]
    return spark.createDataFrame(rows, f"rank int, feature string, {name} double")


def classify_users(
    profile: DataFrame,
    order: Sequence[str],
    label: str,
    features: Sequence[str],
    folds: int = 6,
    trees: int = 250,
    balance: bool = False,
) -> DataFrame:
    """Drop rows with nulls, scale, cross-validate a tree, an L1 logistic model and a forest.

    One report row per model and class.  ``balance`` adds synthetic minority rows first.
    """
    clean = profile.na.drop("any").select(*order, *features, F.col(label).cast("int").alias(label))
    if balance:
        clean = standardize(clean, list(features))
        clean = borderline_smote(clean, features, label, order[0])
        order = [order[0], "_copy"]
        clean = clean.withColumnRenamed("copy", "_copy")
    split = settle(stratified_folds(clean, label, order, folds), "folds")
    raw = assemble(split, features, label, ["fold"])
    scaled = assemble(settle(standardize(split, list(features)), "scaled"), features, label, ["fold"])
    runs = (
        ("decision_tree", lambda rows: decision_tree(), spread(raw, MODEL_ROWS)),
        ("logistic_l1", logistic_l1, spread(scaled, MODEL_ROWS)),
        ("random_forest", lambda rows: random_forest(trees), spread(raw, FOREST_ROWS)),
    )
    result = None
    for name, estimator, data in runs:
        scored, _ = cross_validate(estimator, data, folds)
        report = classification_report(scored).withColumn("model", F.lit(name))
        result = report if result is None else result.unionByName(report)
    return result


def naive_bayes(smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(smoothing=smoothing, modelType="multinomial")


def naive_bayes_accuracy(
    df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], share: float = 0.7, seed: int = 0
) -> DataFrame:
    """Train on a share of the rows, report accuracy on the rest.  Negative features are an error."""
    safe = df.select(
        *ids,
        label,
        *[
            F.when(F.col(c) < 0, F.raise_error(F.lit(f"negative values in {c}")).cast("double"))
            .otherwise(F.col(c).cast("double"))
            .alias(c)
            for c in features
        ],
    )
    train, test = (assemble(part, features, label) for part in random_split(safe, ids, share, seed))
    scored = naive_bayes().fit(train).transform(test)
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


# Clusters ------------------------------------------------------------------------------------


def fit_clusters(df: DataFrame, features: Sequence[str], estimator: Estimator):
    """Fit any clustering estimator on z-scores; the model and the scored rows."""
    clean = df.select(*features).na.drop("any")
    data = assemble(standardize(clean, list(features)), features)
    model = Pipeline(stages=[estimator]).fit(data)
    return model.stages[-1], model.transform(data)


def kmeans_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3), seed: int = 0) -> DataFrame:
    """K-means on z-scores for each k: inertia, silhouettes, and the centres in original units.

    Rows ``k, cluster, size, inertia, silhouette`` (of the cluster), ``mean_silhouette`` (of all rows),
    ``<features>``.  Flags count as 0 and 1.  The z-scores are written once for all passes.
    """
    spark = df.sparkSession
    clean = df.select(*[F.col(f).cast("double").alias(f) for f in features]).na.drop("any")
    moments, _ = column_moments(clean, features)
    scale = spark.range(1).select(moments.alias("m")).first()["m"]
    data = assemble(settle(standardize(clean, list(features)), "scaled"), features).select("features")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(data)
        sizes = model.summary.clusterSizes
        # One row per cluster and one for all.
        found = _silhouette(model.transform(data).select(F.col("prediction").alias("cluster"), "features")).collect()
        shape = {r["cluster"]: r["silhouette"] for r in found}
        for i, centre in enumerate(model.clusterCenters()):
            original = [float(c) * scale[f"std_{f}"] + scale[f"mean_{f}"] for c, f in zip(centre, features)]
            rows.append((k, i, int(sizes[i]), float(model.summary.trainingCost), shape.get(i), shape.get(None), *original))
    names = ", ".join(f"`{f}` double" for f in features)
    return spark.createDataFrame(
        rows, f"k int, cluster int, size bigint, inertia double, silhouette double, mean_silhouette double, {names}"
    )


def silhouette(scored: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """Mean silhouette per cluster and over all rows, by squared Euclidean distance.

    The mean squared distance to a cluster follows from its size, sums and squared sums, so no
    pairs of rows are formed.  Columns ``cluster`` (null for the whole), ``rows``, ``silhouette``.
    """
    return _silhouette(assemble(scored, features, keep=[cluster]).select(F.col(cluster).alias("cluster"), "features"))


def _silhouette(points: DataFrame) -> DataFrame:
    """The same of ``cluster`` and the vector ``features``."""
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda sum_, v: sum_ + v * v)
    placed = points.select("cluster", "features", vector_to_array("features").alias("_x")).withColumn("_norm", square(F.col("_x")))
    shapes = placed.groupBy(F.col("cluster").alias("_other")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_norm").alias("_norms"), vector_to_array(Summarizer.sum(F.col("features"))).alias("_sums")
    )
    # One row with all clusters: as many entries as the model has clusters.
    packed = shapes.agg(F.collect_list(F.struct("_other", "_n", "_norms", "_sums"))).scalar()

    def total(s: Column) -> Column:
        dot = F.aggregate(F.arrays_zip(s["_sums"], F.col("_x")), F.lit(0.0), lambda acc, p: acc + p["_sums"] * p["_x"])
        return s["_n"] * F.col("_norm") - 2 * dot + s["_norms"]

    inside = F.filter("_shapes", lambda s: s["_other"] == F.col("cluster"))[0]
    others = F.filter("_shapes", lambda s: s["_other"] != F.col("cluster"))
    a = F.try_divide(total(inside), inside["_n"] - 1)
    b = F.array_min(F.transform(others, lambda s: total(s) / s["_n"]))
    measured = placed.select("cluster", "_x", "_norm", packed.alias("_shapes")).select("cluster", a.alias("_a"), b.alias("_b"))
    value = F.when(F.col("_a").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    per_cluster = measured.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("silhouette"))
    whole = measured.agg(F.lit(None).alias("cluster"), F.count(F.lit(1)).alias("rows"), F.avg(value).alias("silhouette"))
    return per_cluster.unionByName(whole)


def vector_columns(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Vector column ``features`` back to named columns."""
    array = vector_to_array("features")
    return scored.select("prediction", *[array[i].alias(f) for i, f in enumerate(features)])
