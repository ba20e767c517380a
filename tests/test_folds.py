from collections import Counter

from playmetrics.operators import models


def test_null_classes_and_ids_stay(spark):
    rows = [(i if i % 5 else None, i % 3 if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label int")
    split = models.stratified_folds(df, "label", ["id", "label"], 3).collect()
    assert Counter((r.id, r.label) for r in split) == Counter(rows)
    for label in (None, 1, 2):
        sizes = Counter(r.fold for r in split if r.label == label)
        assert sorted(sizes) == [0, 1, 2] and max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter(r.id for r in models.kfold(df, ["id", "label"], 4).collect()) == Counter(i for i, _ in rows)
