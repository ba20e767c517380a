"""Balancing two classes with synthetic rows near the class border.

Rows with equal features are one *position* with a count per class, so any number of copies of
one row is a single point here.  Nearest positions are found exactly: space is cut into cells
with at most ``BOX_ROWS`` positions.  The first cuts, up to ``BOXES`` boxes, come from a bounded sample;
cells that are still too full are halved again and again, by the median of their widest dimension, as a
table that is joined to the rows.  Cuts decide only how work is spread.  A first search inside a query's
own cell bounds the distance of its k-th neighbour, and the query then visits just the cells that reach
into that distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

SAMPLE = 20_000
BOX_ROWS = 4_096
#: Cells of one task.
TASK_CELLS = 4
#: Boxes that the driver knows; each is cut further as a table.
BOXES = 1_024
#: Synthetic rows of one position that one task writes.
COPIES = 10_000
CELLS = 4_000_000


def _cut(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of ``2^depth`` boxes that cover all of space: every box is halved
    at the sample median of its widest dimension, ``depth`` times."""
    dims = sample.shape[1]
    boxes = [(np.full(dims, -np.inf), np.full(dims, np.inf), sample)]
    for _ in range(depth):
        halves = []
        for low, high, points in boxes:
            spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(dims)
            axis = int(spread.argmax())
            if spread[axis] == 0:
                halves.append((low, high, points))
                continue
            edge = float(np.median(points[:, axis]))
            if edge == points[:, axis].min():
                edge = float(points[:, axis][points[:, axis] > edge].min())
            right = points[:, axis] >= edge
            upper, lower = high.copy(), low.copy()
            upper[axis], lower[axis] = edge, edge
            halves += [(low, upper, points[~right]), (lower, high, points[right])]
        boxes = halves
    return np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def _home(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Box of each point; boxes are half-open."""
    found = np.empty(len(points), dtype=np.int64)
    for start in range(0, len(points), 1024):
        x = points[start : start + 1024, None, :]
        found[start : start + 1024] = ((x >= low) & (x < high)).all(2).argmax(1)
    return found


def _halve(rows: DataFrame, cuts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Move rows to the cell on their side of their cell's cut: cell c becomes 2c or 2c + 1."""
    side = F.element_at(F.array(*[F.col(c).cast("double") for c in names]), F.col("_axis")) >= F.col("_edge")
    found = rows.join(cuts, F.col("cell") == F.col("_cell"), "left")
    return found.withColumn("cell", 2 * F.col("cell") + F.coalesce(side, F.lit(False)).cast("int")).drop("_cell", "_axis", "_edge")


def _cells(
    points: DataFrame, queries: DataFrame, names: Sequence[str], corners: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points and queries with their ``cell``, and the cells' corners, once no cell is too full.

    A cell of positions that are all equal stays as it is.
    """
    while True:
        sides = [F.struct((F.max(c) - F.min(c)).cast("double").alias("width"), F.lit(-i).alias("i"), F.min(c).cast("double").alias("low"),
                          F.max(c).cast("double").alias("high"), F.percentile_approx(c, 0.5).cast("double").alias("mid")) for i, c in enumerate(names, 1)]
        counted = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.greatest(*sides).alias("s") if len(sides) > 1 else sides[0].alias("s"))
        full = counted.where((F.col("n") > BOX_ROWS) & (F.col("s.width") > 0))
        half = F.col("s.low") + F.col("s.width") / 2
        # The upper half begins above the lowest value; a median at the lowest value gives way to the middle.
        edge = F.when(F.col("s.mid") > F.col("s.low"), F.col("s.mid")).when(half > F.col("s.low"), half).otherwise(F.col("s.high"))
        cuts = settle(full.select(F.col("cell").alias("_cell"), (-F.col("s.i")).alias("_axis"), edge.alias("_edge")), "cuts")
        if cuts.isEmpty():
            return points, queries, corners
        points, queries = (settle(_halve(df, cuts, names), "cells") for df in (points, queries))
        at = lambda bound, swap: F.transform(
            bound, lambda v, i: F.when((i + 1 == F.col("_axis")) & (F.col("_side") == swap), F.col("_edge")).otherwise(v)
        )
        both = F.when(F.col("_axis").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        parts = corners.join(cuts, F.col("cell") == F.col("_cell"), "left").withColumn("_side", F.explode(both))
        corners = settle(
            parts.select("box", (2 * F.col("cell") + F.col("_side")).alias("cell"), at("low", 1).alias("low"), at("high", 0).alias("high")),
            "corners",
        )


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of ``a`` to ``b``, a few rows of ``a`` at a time so that memory stays small."""
    step = max(1, CELLS // max(b.size, 1))
    for start in range(0, len(a), step):
        yield start, np.sqrt(((a[start : start + step, None, :] - b[None, :, :]) ** 2).sum(2))


def nearest(queries: DataFrame, points: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """The exact ``k`` nearest points of each query by Euclidean distance.

    ``queries``: ``qid`` and features; ``points``: features and any payload.  Result: ``qid,
    rank``, the point's columns and ``distance``; equal distances are ranked by the features.
    """
    payload = [c for c in points.columns if c not in features]
    names, width = list(features), len(features)
    count = points.count()
    # The positions with the least hashes, each task's own first.
    drawn = points.select(*names).orderBy(F.xxhash64(F.lit(17), *names), *names).limit(SAMPLE)
    sample = np.array(drawn.collect(), dtype=float).reshape(-1, width)
    depth = max(0, math.ceil(math.log2(max(count / BOX_ROWS, 1))))
    low, high = _cut(sample, min(depth, int(math.log2(BOXES)), int(math.log2(max(len(sample) / 16, 1)))))

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(box=_home(batch[names].to_numpy(float), low, high))

    def typed(df: DataFrame, *extra: str) -> str:
        return ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes), *extra])

    corners = points.sparkSession.createDataFrame(
        [(b, b, low[b].tolist(), high[b].tolist()) for b in range(len(low))], "box bigint, cell bigint, low array<double>, high array<double>"
    )
    boxed_points, boxed_queries = (
        df.mapInPandas(at_home, typed(df, "box bigint")).withColumnRenamed("box", "cell") for df in (points, queries)
    )
    boxed_points, boxed_queries, corners = _cells(settle(boxed_points, "points"), settle(boxed_queries, "queries"), names, corners)

    # Cells are few bytes for the work they are: dealt out by number, they are not put together into one task again.
    parts = max(1, math.ceil(count / (TASK_CELLS * BOX_ROWS)))
    by_cell = boxed_points.repartition(parts, "cell").groupBy("cell")

    def bound(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        radius = np.full(len(mine), np.inf)
        if len(near) >= k:
            x, y = mine[names].to_numpy(float), near[names].to_numpy(float)
            for start, d in _distances(x, y):
                radius[start : start + len(d)] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return mine.drop(columns="cell").assign(radius=radius)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, radius = batch[names].to_numpy(float), batch["radius"].to_numpy()
            for start in range(0, len(batch), 256):
                part = x[start : start + 256, None, :]
                reach = np.sqrt((np.maximum(np.maximum(low - part, part - high), 0.0) ** 2).sum(2))
                row, box = np.nonzero(reach <= radius[start : start + 256, None])
                out = batch.iloc[start + row].reset_index(drop=True)
                yield out.assign(box=box.astype(np.int64))

    def search(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        parts = []
        x, y = mine[names].to_numpy(float), near[names].to_numpy(float)
        order = np.lexsort(y.T[::-1]) if len(y) else np.empty(0, dtype=int)
        near, y = near.iloc[order], y[order]
        for start, d in _distances(x, y) if len(y) else ():
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(best)), best.shape[1])
            found = near.iloc[best.ravel()][[*names, *payload]].reset_index(drop=True)
            found.insert(0, "qid", mine["qid"].to_numpy()[start + row])
            parts.append(found.assign(distance=d[row, best.ravel()]))
        columns = ["qid", *names, *payload, "distance"]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    radii = (
        boxed_queries.repartition(parts, "cell").groupBy("cell")
        .cogroup(by_cell)
        .applyInPandas(bound, typed(queries, "radius double"))
    )
    # First the boxes within reach, then their cells.
    boxes = radii.mapInPandas(visit, typed(queries, "radius double", "box bigint"))
    gaps = [
        F.greatest(F.element_at("low", i) - F.col(c), F.col(c) - F.element_at("high", i), F.lit(0.0)) for i, c in enumerate(names, 1)
    ]
    reach = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
    visits = boxes.join(corners, "box").where(reach <= F.col("radius")).select("qid", *names, "cell")
    kinds = dict(points.dtypes)
    schema = ", ".join(["qid bigint", *(f"`{c}` {kinds[c]}" for c in [*names, *payload]), "distance double"])
    found = visits.repartition(parts, "cell").groupBy("cell").cogroup(by_cell).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", *names))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _draw(seed: int, salt: int, *ids: str | Column) -> Column:
    """A hashed number in [0, 1), the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed * 100 + salt), *ids), F.lit(1_000_003)) / 1_000_003


def border_positions(
    positions: DataFrame, features: Sequence[str], near: int = 10
) -> DataFrame:
    """Minority positions of which at least half, but not all, of the ``near`` closest rows are
    of the majority.  At equal distance minority rows are closer.

    ``positions``: ``qid``, features, ``few`` and ``many`` (rows of either class).
    """
    few = positions.where(F.col("few") > 0)
    points = positions.select(*features, F.col("few").alias("n_few"), F.col("many").alias("n_many"))
    found = nearest(few.select("qid", *features), points, features, near + 1)
    # The row itself is left out of its own position, which is always the first.
    own = F.when((F.col("distance") == 0), 1).otherwise(0)
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.col("n_few") - F.col("own") + F.col("n_many")
    before = F.coalesce(F.sum(rows).over(order), F.lit(0))
    left = F.greatest(F.lit(near) - F.col("before"), F.lit(0))
    majority = F.least(F.col("n_many"), F.greatest(F.col("left") - (F.col("n_few") - F.col("own")), F.lit(0)))
    counted = (
        found.withColumn("own", own)
        .withColumn("before", before)
        .withColumn("left", left)
        .groupBy("qid")
        .agg(F.sum(majority).alias("majority"))
        .where((F.col("majority") >= near / 2) & (F.col("majority") < near))
    )
    return few.join(counted, "qid")


def borderline_smote(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    near: int = 10,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Add synthetic minority rows near the border until both classes are about equal.

    Half of the new rows lie between a border row and one of its ``k`` closest minority rows, half
    at most midway towards one of its ``k`` closest majority rows.  Columns: ``key``, features,
    label, ``copy`` (0 for original rows).
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(sizes) != 2:
        raise ValueError("balancing needs exactly two classes")
    minority = min(sizes, key=lambda c: (sizes[c], c))
    missing = max(sizes.values()) - sizes[minority]
    small = F.col(label) == minority
    positions = settle(
        df.groupBy(*features).agg(
            F.min(key).alias("qid"), F.count_if(small).alias("few"), F.count_if(~small).alias("many")
        ),
        "positions",
    )
    border = settle(border_positions(positions, features, near), "border")
    weight = border.agg(F.sum("few")).first()[0]
    original = df.select(key, *features, label, F.lit(0).alias("copy"))
    if not weight or not missing:
        return original

    def neighbours(count: str, name: str) -> DataFrame:
        points = positions.where(F.col(count) > 0).select(*features, F.col(count).alias("n"))
        found = nearest(border.select("qid", *features), points, features, k + 1)
        # A position of its own leads nowhere; one of several rows counts as many times, up to k.
        others = found.where(F.col("distance") > 0)
        target = F.struct("rank", F.array(*features).alias("to"))
        repeated = F.array_repeat(target, F.least("n", F.lit(k)).cast("int"))
        ordered = F.array_sort(F.flatten(F.collect_list(repeated)))
        return others.groupBy("qid").agg(F.slice(ordered, 1, k).alias(name))

    copies = F.floor(F.col("few") * (missing / weight) + _draw(seed, 1, "qid"))
    new = (
        border.withColumn("copies", copies)
        .where(F.col("copies") > 0)
        .join(neighbours("few", "near_few"), "qid", "left")
        .join(neighbours("many", "near_many"), "qid", "left")
        # A position of very many rows is written by many tasks, a range of its copies each.
        .select("*", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1, F.lit(COPIES))).alias("_from"))
        .repartition("qid", "_from")
        .select("*", F.explode(F.sequence(F.col("_from") + 1, F.least("copies", F.col("_from") + COPIES).cast("int"))).alias("copy"))
    )
    inward = (_draw(seed, 2, "qid", "copy") < 0.5) & F.col("near_few").isNotNull()
    inward = inward | F.col("near_many").isNull()
    targets = F.when(inward, F.col("near_few")).otherwise(F.col("near_many"))
    pick = F.floor(_draw(seed, 3, "qid", "copy") * F.size("targets")).cast("int")
    step = _draw(seed, 4, "qid", "copy") * F.when(F.col("inward"), 1.0).otherwise(0.5)
    moved = (
        new.withColumn("inward", inward)
        .withColumn("targets", targets)
        .where(F.col("targets").isNotNull())
        .withColumn("to", F.col("targets")[pick]["to"])
        .withColumn("step", step)
    )
    return original.unionByName(
        moved.select(
            F.col("qid").alias(key),
            *[(F.col(f) + F.col("step") * (F.col("to")[i] - F.col(f))).alias(f) for i, f in enumerate(features)],
            F.lit(minority).alias(label),
            "copy",
        )
    )
