"""Column profiling, grouped statistics and univariate measures on any table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import pearson_p
from ..plans.quantiles import group_stats


def group_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each value column by group; of the whole table for no keys."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def describe(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max of each column, whole or by group."""
    stats = group_stats(df, keys, values, (0.25, 0.5, 0.75), approx=approx)
    return stats.select(*keys, "measure", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value; sort by ``rows`` descending to read it."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("rows"))


def most_common(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Most frequent value of ``column`` per group; the smallest value on a tie."""
    counted = value_counts(df, column, keys)
    if keys:
        top = counted.groupBy(*keys).agg(F.max("rows").alias("_top"))
        tied = counted.join(top, list(keys)).where(F.col("rows") == F.col("_top"))
    else:
        tied = counted.where(F.col("rows") == counted.agg(F.max("rows")).scalar())
    return tied.groupBy(*keys).agg(F.min(column).alias(column), F.max("rows").alias("rows"))


def latest_row(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values."""
    return df.agg(F.max(F.struct(*order, *columns)).alias("last")).select("last.*")


def distinct_count(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Number of distinct values of each column."""
    count = F.approx_count_distinct if approx else F.count_distinct
    if approx or len(columns) == 1:
        return df.agg(*[count(c).alias(f"distinct_{c}") for c in columns])
    return df.agg(*[count(F.col(c)).alias(f"distinct_{c}") for c in columns])


def first_last(df: DataFrame, columns: Sequence[str], key: str = "player", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """First and last value of each column per key."""
    at = F.struct(*order)
    picked: list[Column] = []
    for c in columns:
        picked += [F.min_by(c, at).alias(f"first_{c}"), F.max_by(c, at).alias(f"last_{c}")]
    return df.groupBy(key).agg(*picked)


def group_rate(df: DataFrame, key: str, flag: Column, min_size: int = 10) -> DataFrame:
    """Share of flagged rows and size per group; the rate is 0 for groups under ``min_size``."""
    n = F.count(F.lit(1))
    share = F.avg(flag.cast("double"))
    return df.groupBy(key).agg(n.alias("size"), F.when(n >= min_size, share).otherwise(F.lit(0.0)).alias("rate"))


def count_spread(df: DataFrame, owner: str, key: str, approx: bool = False) -> DataFrame:
    """Rows per (owner, key), then the median and population std of those counts per key."""
    counts = df.groupBy(owner, key).agg(F.count(F.lit(1)).alias("rows"))
    stats = group_stats(counts, [key], ["rows"], approx=approx, counts=True)
    return stats.select(
        key, F.col("n").alias("owners"), F.col("p50").alias("median_rows"), F.col("std_pop").alias("std_rows")
    )


def nonzero_median(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Median of the non-zero values of each column."""
    kept = df.select(*[F.when(F.col(c) != 0, F.col(c)).alias(c) for c in columns])
    return group_stats(kept, [], columns, approx=approx).select("measure", "n", F.col("p50").alias("median"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Number of rows meeting each condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (each once, with itself included), long form."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _pairs_long(wide, pairs, "corr")


def covariances(df: DataFrame, columns: Sequence[str], assume_centered: bool = False) -> DataFrame:
    """Maximum-likelihood covariance of every pair of columns; plain second moments if centred."""
    pairs = list(combinations_with_replacement(columns, 2))
    cell = (lambda a, b: F.avg(F.col(a) * F.col(b))) if assume_centered else F.covar_pop
    wide = df.agg(*[cell(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _pairs_long(wide, pairs, "cov")


def _pairs_long(wide: DataFrame, pairs: Sequence[tuple[str, str]], name: str) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias(name))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*cells)))


def pearson_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target and its two-sided p-value.

    One aggregation over the data; the p-value is computed on the one row per column it leaves.
    """
    both = lambda c: F.col(c).isNotNull() & F.col(target).isNotNull()
    cells = []
    for c in columns:
        cells += [F.corr(c, target).alias(f"r_{c}"), F.count_if(both(c)).alias(f"n_{c}")]
    wide = df.agg(*cells)
    long = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(f"r_{c}").alias("r"), F.col(f"n_{c}").alias("n"))
                    for c in columns
                ]
            )
        )
    )
    return long.withColumn("p", pearson_p("r", "n"))


def histogram(df: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """Rows in each of ``bins`` equal-width bins between the column's minimum and maximum.

    The last bin is closed.  ``log`` bins the natural logarithm of the column.
    """
    value = (F.ln(column) if log else F.col(column)).cast("double")
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    edges = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    low, width = edges["lo"], (edges["hi"] - edges["lo"]) / bins
    place = F.least(F.floor(F.try_divide(F.col("v") - low, width)), F.lit(bins - 1))
    counted = values.groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (low + F.col("id") * width).alias("bin_start"),
        (low + (F.col("id") + 1) * width).alias("bin_end"),
    )
    return every.join(counted, "bin", "left").na.fill(0, ["rows"])


def density_curve(df: DataFrame, column: str, key: str, points: int = 50, bins: int = 512) -> DataFrame:
    """Gaussian kernel density of ``column`` by class on an even grid of ``points``.

    Rows are counted into ``bins`` fine bins per class first; the kernel, with Scott's bandwidth
    ``std * n^(-1/5)``, is summed over bin centres.  Only binned counts meet the grid.
    """
    values = df.select(F.col(key), F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    shape = values.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        (F.stddev_samp("v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("bw"),
    ).where((F.col("bw") > 0))
    step = (F.col("hi") - F.col("lo")) / bins
    binned = (
        values.join(shape, key)
        .groupBy(key, "n", "lo", "hi", "bw", F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    centre = F.col("lo") + (F.col("bin") + 0.5) * step
    z = (F.col("x") - centre) / F.col("bw")
    return (
        binned.select("*", grid)
        .withColumn("x", at)
        .withColumn("part", F.col("m") * F.exp(-z * z / 2) / (F.col("n") * F.col("bw") * F.sqrt(F.lit(2 * 3.141592653589793))))
        .groupBy(key, "point", "x")
        .agg(F.sum("part").alias("density"))
    )


def box_summary(df: DataFrame, column: str, key: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and outliers by class."""
    quartiles = group_stats(df, [key], [column], (0.25, 0.5, 0.75)).select(key, "n", "p25", "p50", "p75")
    spread = F.col("p75") - F.col("p25")
    low, high = F.col("p25") - 1.5 * spread, F.col("p75") + 1.5 * spread
    value = F.col("_v")
    inside = value.between(low, high)
    counted = df.select(key, F.col(column).cast("double").alias("_v")).groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_m"))
    return (
        counted.join(quartiles, key)
        .groupBy(key, "n", "p25", "p50", "p75")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_m"))), F.lit(0)).alias("outliers"),
        )
    )


def null_summary(df: DataFrame) -> DataFrame:
    """Per column: type, nulls and non-null rows."""
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_rows"))
    kinds = dict(df.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("type"),
            (F.col("_rows") - F.col(c)).alias("nulls"),
            F.col(c).alias("present"),
        )
        for c in df.columns
    ]
    return wide.select(F.inline(F.array(*cells)))


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """z-scores with the population standard deviation; all numeric columns by default."""
    subquery, chosen = column_moments(df, columns)
    # The subquery is named once: each mention of it in an expression would be a copy of its plan.
    held, moments = df.withColumn("_moments", subquery), F.col("_moments")
    return held.select(
        *[
            ((F.col(c) - moments[f"mean_{c}"]) / _scale(moments, c)).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )


def _scale(moments: Column, c: str) -> Column:
    """A column's standard deviation, 1 for a constant column."""
    return F.when(moments[f"std_{c}"] == 0, F.lit(1.0)).otherwise(moments[f"std_{c}"])


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def column_moments(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[Column, list[str]]:
    """``mean_c`` and ``std_c`` (population) of each chosen column, as one struct from a subquery."""
    chosen = list(columns) if columns else [c for c, kind in df.dtypes if kind in NUMERIC or kind.startswith("decimal")]
    cells = []
    for c in chosen:
        cells += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return df.agg(F.struct(*cells)).scalar(), chosen


def unstandardize(df: DataFrame, original: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring z-scores back to the units of ``original``."""
    subquery, chosen = column_moments(original, columns)
    held, moments = df.withColumn("_moments", subquery), F.col("_moments")
    return held.select(
        *[
            (F.col(c) * _scale(moments, c) + moments[f"mean_{c}"]).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )


def binarize_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 where the z-score of a column is above 0, else 0."""
    scaled = standardize(df, columns)
    return scaled.select(*[(F.col(c) > 0).cast("int").alias(c) if c in columns else F.col(c) for c in scaled.columns])


