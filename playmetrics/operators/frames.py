"""Column edits, joins, set operations and top-k on any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_close
from ..plans.quantiles import group_stats
from ..plans.timeline import RowNumber, running
from .stats import most_common


def one_player(events: DataFrame, player: int) -> DataFrame:
    """All rows of one player."""
    return events.where(F.col("player") == player)


def without_boot(df: DataFrame, column: str, boot: str) -> DataFrame:
    """Drop boot-phase rows: the class is null or the boot label."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != boot))


def without_outliers(df: DataFrame, key: str, names: Sequence) -> DataFrame:
    """Drop the named keys."""
    return df.where(~F.col(key).isin(list(names)))


def without_maximum(df: DataFrame, column: str) -> DataFrame:
    """Drop the rows holding a column's maximum."""
    below = F.col(column) < df.agg(F.max(column)).scalar()
    return df.where(F.coalesce(below, F.lit(True)))


def membership(df: DataFrame, other: DataFrame, key: str, name: str = "found") -> DataFrame:
    """Flag rows whose key occurs in ``other``."""
    known = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def replace_sentinel(df: DataFrame, sentinel: float, value: float) -> DataFrame:
    """Replace a sentinel in every numeric column."""
    return df.replace(sentinel, value)


def split_common_value(df: DataFrame, column: str, common: float, flag: str, log_name: str) -> DataFrame:
    """Flag rows close to a common value, and take the logarithm elsewhere (0 where flagged)."""
    near = is_close(F.col(column), F.lit(common))
    return df.withColumn(flag, near).withColumn(log_name, F.when(near, F.lit(0.0)).otherwise(F.ln(column)))


def zero_count(columns: Sequence[str]) -> Column:
    """Number of zero fields in a row; nulls are not zero."""
    return sum((F.coalesce((F.col(c) == 0).cast("int"), F.lit(0)) for c in columns), F.lit(0))


def recode(column: str, codes: Mapping) -> Column:
    """Map category values to numbers; unknown values become null."""
    result = None
    for value, code in codes.items():
        test = F.col(column) == F.lit(value)
        result = F.when(test, F.lit(code)) if result is None else result.when(test, F.lit(code))
    return result


def padded_series(df: DataFrame, value: str, length: int, key: str = "player", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """A series per key of at least ``length`` positions, the last value repeated: long form.

    Values keep their position; only the missing tail is generated, at most ``length`` rows a key.
    """
    series = running(df.select(key, *order, value), RowNumber("position"), keys=(key,), order=order)
    series = series.select(key, "position", value)
    ends = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max_by(value, F.struct(*order)).alias(value))
    tail = ends.where(F.col("_n") < length).select(
        key, F.explode(F.sequence(F.col("_n") + 1, F.lit(length).cast("bigint"))).alias("position"), value
    )
    return series.unionByName(tail)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any")


def impute(df: DataFrame, column: str, strategy: str = "median") -> DataFrame:
    """Fill nulls with the column's median, mean or most common value (smallest on a tie)."""
    if strategy == "mode":
        fill = most_common(df, [], column).select(column)
    elif strategy == "mean":
        fill = df.agg(F.avg(column))
    else:
        fill = group_stats(df.select(column), [], [column]).select("p50")
    return df.withColumn(column, F.coalesce(column, fill.scalar()))


def by_level_full(left: DataFrame, right: DataFrame, key: str, metric: str, names: tuple[str, str]) -> DataFrame:
    """One metric of two populations side by side, keeping keys of either."""
    a = left.select(key, F.col(metric).alias(f"{metric}_{names[0]}"))
    b = right.select(key, F.col(metric).alias(f"{metric}_{names[1]}"))
    return a.join(b, key, "full")


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in order: each task keeps ``n`` rows and these are merged."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; the limit is applied in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(keys), list(columns), name, value)
