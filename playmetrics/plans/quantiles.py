"""Grouped statistics with exact quantiles for groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer.  Here two close
``percentile_approx`` marks bracket the wanted rank of each group, which Spark guarantees to within
``1 / accuracy`` of the group's rows.  The marks are written and go to the rows (`facts.with_facts`), which stay
where they are, and only what lies inside a bracket is shuffled, equal values as one row with a count; the rows below are one count for each task and group.  So a
group sorts about ``8 / accuracy`` of its rows.  The neighbours of the bracket are kept too, as
a quantile may lie between one of them and the bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle
from .facts import with_facts

ACCURACY = 10_000


def quantile_name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    quantiles: Sequence[float] = (0.5,),
    approx: bool = False,
    accuracy: int = ACCURACY,
    counts: bool = False,
) -> DataFrame:
    """One row per group and value column.

    Columns: ``keys``, ``measure`` (name of the value column), ``n`` (non-null values),
    ``total``, ``min``, ``max``, ``mean``, ``std`` (sample), ``std_pop`` and ``pNN`` for each
    quantile (linear interpolation between ranks).  ``approx`` skips the exact step.

    The exact step runs a job and reads ``df`` twice: settle what is costly to compute.

    ``counts`` states that the values are numbers of rows: d different counts need at least
    d * d / 2 rows, so a group of 10^12 rows has under 1.5 million of them and Spark's exact
    ``percentile``, which holds one entry per different value, does it in one step.
    """
    # Inside, keys have names of their own, so that a key may be called anything.
    inner = {f"_key{i}": k for i, k in enumerate(keys)}
    named = [F.col(k).alias(name) for name, k in inner.items()]
    stats = _group_stats(df.select(*named, *values), list(inner), values, quantiles, approx, accuracy, counts)
    return stats.select(*[F.col(c).alias(inner.get(c, c)) for c in stats.columns])


def _group_stats(
    df: DataFrame, keys: list[str], values: Sequence[str], quantiles: Sequence[float], approx: bool, accuracy: int, counts: bool
) -> DataFrame:
    if len(values) == 1 and keys:
        pairs = df.select(*keys, F.lit(values[0]).alias("measure"), F.col(values[0]).cast("double").alias("value"))
    else:
        cells = F.array(
            *[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values]
        )
        pairs = df.select(*keys, F.inline(cells))
    pairs = pairs.where(F.col("value").isNotNull())
    group = [*keys, "measure"]
    slack = 4.0 / accuracy
    targets = list(quantiles) if approx else [
        min(max(q + side, 0.0), 1.0) for q in quantiles for side in (-slack, slack)
    ]
    basic = [
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.stddev_pop("value").alias("std_pop"),
    ]
    names = ["n", "total", "min", "max", "mean", "std", "std_pop"]
    if not quantiles:
        return pairs.groupBy(*group).agg(*basic)
    if counts and not approx:
        found = pairs.groupBy(*group).agg(*basic, F.percentile("value", [float(q) for q in quantiles]).alias("_found"))
        return found.select(
            *group, *names, *[F.col("_found")[i].alias(quantile_name(q)) for i, q in enumerate(quantiles)]
        )
    spread = pairs.groupBy(*group).agg(
        *basic, F.percentile_approx("value", [float(t) for t in targets], accuracy).alias("_marks")
    )
    if approx:
        return spread.select(
            *group, *names, *[F.col("_marks")[i].alias(quantile_name(q)) for i, q in enumerate(quantiles)]
        )

    marks = settle(spread.select(*[F.col(c).alias(f"_g_{c}") for c in group], *names, "_marks"), "marks")
    matches = F.lit(True)
    for c in group:
        matches &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    # Below (-1), in (0) or above (1) each bracket.
    sides = [
        F.when(F.col("value") < F.col("_marks")[2 * i], -1).when(F.col("value") > F.col("_marks")[2 * i + 1], 1).otherwise(0)
        for i in range(len(quantiles))
    ]
    inside = F.lit(False)
    for side in sides:
        inside |= side == 0
    at = with_facts(pairs, marks, matches, F.col("n")).select(
        *group, "value", *names, F.array(*sides).alias("_sides"), F.when(inside, F.col("value")).alias("_inside")
    )
    # Numbers only, so that each task counts in a hash map and sorts nothing.
    counted = at.groupBy(*group, "_sides", "_inside").agg(
        F.count(F.lit(1)).alias("_m"),
        # Of the rows outside only the values next to a bracket are kept.
        F.min("value").alias("_least"),
        F.max("value").alias("_most"),
        *[F.first(c).alias(c) for c in names],
    )
    # One exchange by the group's first keys serves the sums here, the quantiles and `widen`.
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                (F.lit(float(q)) * (F.col("n") - 1)).alias("rank"),
                F.col("_sides")[i].alias("side"),
            )
            for i, q in enumerate(quantiles)
        ]
    )
    placed = counted.repartition(*(keys or ["measure"])).select("*", F.explode(brackets).alias("_b")).select(
        *group, "_m", F.struct(*names).alias("_basic"), F.col("_b.q").alias("_q"), F.col("_b.rank").alias("_rank"),
        F.col("_b.side").alias("_side"), F.when(F.col("_b.side") < 0, F.col("_most")).otherwise(F.col("_least")).alias("value"),
    )
    ordered = Window.partitionBy(*group, "_q").orderBy("value")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_cum", F.sum("_m").over(upto)).withColumn("_before", F.col("_cum") - F.col("_m"))
    floor, ceil = F.floor("_rank"), F.ceil("_rank")

    def at_rank(r: Column) -> Column:
        """The value of a rank: within the bracket, or just beside it."""
        here = (F.col("_before") <= r) & (r < F.col("_cum"))
        edge = F.when(F.col("_side") < 0, F.col("_cum") - 1).when(F.col("_side") > 0, F.col("_before"))
        known = F.when(here & F.coalesce(edge == r, F.lit(True)), F.col("value"))
        return F.max(known)

    low, share = F.col("_lo"), F.col("_rank") - F.floor("_rank")
    value = low + (F.col("_hi") - low) * share
    # The guarantee puts every rank into its bracket; should it ever fail, this must not pass unseen.
    sound = F.when(low.isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(value)
    per_quantile = ranked.groupBy(*group, "_q", "_rank").agg(
        at_rank(floor).alias("_lo"), at_rank(ceil).alias("_hi"), F.first("_basic").alias("_basic")
    )
    exact = per_quantile.groupBy(*group).agg(
        F.first("_basic").alias("_basic"),
        *[F.max(F.when(F.col("_q") == i, sound)).alias(quantile_name(q)) for i, q in enumerate(quantiles)],
    )
    return exact.select(*group, "_basic.*", *[quantile_name(q) for q in quantiles])


def widen(stats: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Turn `group_stats` rows into columns: ``wanted`` lists (measure, statistic, new name)."""
    return stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(s))).alias(name) for m, s, name in wanted]
    )
