"""Index growth by level and by day, trends."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import group_stats, widen
from ..plans.timeline import GRAIN, Prev, RowNumber, Total, position, running
from ..sources.events import day_of
from ..sources.tables import settle
from .blocks import change_sums, change_summary
from .stats import standardize


def key_change_per_player_level(
    events: DataFrame, grain: int = GRAIN, keys: Sequence[str] = ("player", "level")
) -> DataFrame:
    """The eight change measures per (player, level)."""
    rows = events.select(*keys, "ts", "event_id", "key_index", "power")
    linked = running(rows, Prev("before", ("key_index", "power")), keys=keys, grain=grain)
    delta = F.col("key_index") - F.col("before.key_index")
    power_delta = F.col("power") - F.col("before.power")
    at = position()
    return linked.groupBy(*keys).agg(
        *change_sums(delta, power_delta),
        F.max_by("key_index", at).alias("closing_value"),
        F.max_by("power", at).alias("closing_power"),
    )


def key_change_by_level(events: DataFrame, grain: int = GRAIN, approx: bool = False) -> DataFrame:
    """The eight change measures by level: players, median and mean."""
    return change_summary(key_change_per_player_level(events, grain), "level", approx)


def consume_to_keep_ratio(
    left: DataFrame, right: DataFrame, max_level: int | None = None, names: tuple[str, str] = ("left", "right"),
    grain: int = GRAIN,
) -> DataFrame:
    """Median consumption over median kept value by level, two populations side by side.

    Both populations go through one pass, told apart by a ``_side`` key.
    """
    columns = ["player", "ts", "event_id", "level", "key_index", "power"]
    both = left.select(*columns, F.lit(0).alias("_side")).unionByName(right.select(*columns, F.lit(1).alias("_side")))
    if max_level is not None:
        both = both.where(F.col("level") <= max_level)
    per_player = key_change_per_player_level(both, grain, ("_side", "player", "level"))
    stats = widen(
        group_stats(settle(per_player, "changes"), ["level", "_side"], ["down_volume", "closing_value"]),
        ["level", "_side"],
        [("down_volume", "p50", "_down"), ("closing_value", "p50", "_kept")],
    )
    ratio = F.try_divide("_down", "_kept")
    return stats.groupBy("level").agg(
        *[F.max(F.when(F.col("_side") == i, ratio)).alias(f"ratio_{name}") for i, name in enumerate(names)]
    )


def _day_no(first_day: int, utc_offset: int) -> Column:
    return (day_of(F.col("ts"), utc_offset) - F.lit(first_day)).cast("int")


def key_growth_by_days(
    events: DataFrame, first_day: int, days: int = 3, utc_offset: int = 0, approx: bool = False
) -> DataFrame:
    """Last index value of each player on day 0..days, for players present every day so far.

    Min, max, mean and median per day; no row after the first day without players.
    """
    daily = (
        events.withColumn("day_no", _day_no(first_day, utc_offset))
        .where(F.col("day_no").between(0, days))
        .groupBy("player", "day_no")
        .agg(F.max_by("key_index", position()).alias("value"))
    )
    present = F.row_number().over(Window.partitionBy("player").orderBy("day_no")) - 1
    unbroken = daily.withColumn("_seen", present).where(F.col("_seen") == F.col("day_no"))
    return widen(
        group_stats(unbroken if approx else settle(unbroken, "days"), ["day_no"], ["value"], approx=approx),
        ["day_no"],
        [
            ("value", "n", "players"),
            ("value", "min", "min_value"),
            ("value", "max", "max_value"),
            ("value", "mean", "mean_value"),
            ("value", "p50", "median_value"),
        ],
    )


def cumulative_change(
    events: DataFrame,
    begin: int | None = None,
    end: int | None = None,
    growth: bool = True,
    baseline: str = "first",
    keys: Sequence[str] = ("player",),
    grain: int = GRAIN,
) -> DataFrame:
    """Sum of rises (or falls) of the index in ``[begin, end]`` per player, 0 if none.

    The first row in range is compared with the player's first value ever (``baseline="first"``)
    or with the value on entry to the range (``"prior"``).  ``keys`` may hold ``player`` and a
    column that parts the range, such as a day number; each part then starts afresh.
    """
    keys = tuple(keys)
    in_range = F.lit(True)
    if begin is not None:
        in_range = in_range & (F.col("ts") >= begin)
    if end is not None:
        in_range = in_range & (F.col("ts") <= end)
    ranged = events.where(in_range).select(*keys, "ts", "event_id", "key_index")
    sign = 1 if growth else -1
    at = position()
    linked = running(ranged, Prev("before", ("key_index",)), keys=keys, grain=grain)
    step = (F.col("key_index") - F.col("before.key_index")) * sign
    inner = linked.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(step > 0, step)), F.lit(0)).alias("_inner"),
        F.min_by("key_index", at).alias("_entry"),
    )
    prior = F.min_by("key_index", at)
    if baseline == "prior":
        before = F.when(F.col("ts") < (begin if begin is not None else 0), F.col("key_index"))
        prior = F.coalesce(F.max_by(before, F.when(before.isNotNull(), at)), prior)
    base = events.groupBy("player").agg(prior.alias("_base"))
    first_step = F.greatest((F.col("_entry") - F.col("_base")) * sign, F.lit(0))
    change = F.coalesce(F.col("_inner") + first_step, F.lit(0)).alias("change")
    return base.join(inner, "player", "left").select(*[k for k in keys], change)


def repeat_by_day(
    events: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    value: str,
    first_day: int,
    days: int,
    utc_offset: int = 0,
) -> DataFrame:
    """Run a per-player operator for every day in one pass: wide table ``player, day_0, day_1, ...``.

    ``operator`` gets the rows of all wanted days with a ``day_no`` column, and groups by
    ``player`` and ``day_no``.  Players of the whole log are kept, with 0 where a day is empty.
    """
    daily = events.withColumn("day_no", _day_no(first_day, utc_offset)).where(F.col("day_no").between(0, days))
    return days_wide(operator(daily), events, value, days)


def days_wide(per_day: DataFrame, events: DataFrame, value: str, days: int) -> DataFrame:
    """``(player, day_no, value)`` to one column per day, for every player of the log."""
    wide = per_day.groupBy("player").agg(
        *[F.coalesce(F.sum(F.when(F.col("day_no") == d, F.col(value))), F.lit(0)).alias(f"day_{d}") for d in range(days + 1)]
    )
    names = [f"day_{d}" for d in range(days + 1)]
    return events.select("player").distinct().join(wide, "player", "left").na.fill(0, names)


def change_by_day(
    events: DataFrame, first_day: int, days: int, growth: bool = True, utc_offset: int = 0, grain: int = GRAIN
) -> DataFrame:
    """`cumulative_change` of each day, long form ``player, day_no, change``.

    Every day starts from the player's first value ever.
    """
    daily = events.withColumn("day_no", _day_no(first_day, utc_offset))
    begin = first_day * 86_400 - utc_offset
    return cumulative_change(
        daily, begin, begin + (days + 1) * 86_400 - 1, growth, keys=("player", "day_no"), grain=grain
    ).where(F.col("day_no").isNotNull())


def nth_active_day(per_day: DataFrame, players: DataFrame, value: str, n: int) -> DataFrame:
    """For k = 1..n the k-th non-zero daily value of a player, else 0; from ``player, day_no, value``."""
    rank = F.row_number().over(Window.partitionBy("player").orderBy("day_no"))
    active = per_day.where(F.col(value) != 0).withColumn("k", rank).where(F.col("k") <= n)
    wide = active.groupBy("player").agg(
        *[F.coalesce(F.max(F.when(F.col("k") == k, F.col(value))), F.lit(0)).alias(f"active_{k}") for k in range(1, n + 1)]
    )
    names = [f"active_{k}" for k in range(1, n + 1)]
    return players.select("player").distinct().join(wide, "player", "left").na.fill(0, names)


def first_last_diff(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last minus first value of each column per player."""
    at = position()
    return events.groupBy("player").agg(
        *[(F.max_by(c, at) - F.min_by(c, at)).alias(f"{c}_diff") for c in columns]
    )


def _shifted(scaled: list[Column], half: Column) -> list[Column]:
    """Coefficients in ``position / half - 1`` (constant first) as coefficients in the position."""
    out = []
    for k in range(len(scaled)):
        terms = [scaled[j] * F.lit(comb(j, k) * (-1.0) ** (j - k)) for j in range(k, len(scaled))]
        out.append(sum(terms[1:], terms[0]) / F.pow(half, F.lit(float(k))))
    return out


def poly_trend(
    events: DataFrame, value: str = "key_index", degree: int = 4, scaled: bool = False, grain: int = GRAIN
) -> DataFrame:
    """Least-squares polynomial of a value over a player's row positions 0, 1, ....

    Columns ``poly_<degree>`` .. ``poly_0``.  Positions are evenly spaced, so the polynomials that are
    orthogonal over them follow from their number alone: on x in [-1, 1], p[k+1] = x p[k] - b[k] p[k-1].
    The fit is one sum of value times p[k] per player and k, over the known norm of p[k]; no system is
    solved.  Players with fewer than ``degree + 1`` rows get the fit of the highest degree that their rows
    determine.  ``scaled`` turns each coefficient into a z-score over players.
    """
    rows = running(
        events.select("player", "ts", "event_id", value),
        RowNumber("rn"),
        Total("rows", F.lit(1)),
        grain=grain,
    )
    n, half = F.col("rows").cast("double"), F.col("_half")
    # b[k] = k^2 (n^2 - k^2) / (4 (4 k^2 - 1)), in units of half the span.
    ratio = lambda k: F.lit(k * k / (4.0 * (4 * k * k - 1))) * (n * n - k * k) / (half * half)
    b, p = [F.col(f"_b{k}") for k in range(degree + 1)], [F.col(f"_p{k}") for k in range(degree + 1)]
    named = rows.select("player", "rows", "rn", F.col(value).cast("double").alias("_y"), F.greatest((n - 1) / 2.0, F.lit(0.5)).alias("_half"))
    named = named.withColumns({"_x": (F.col("rn") - 1 - (n - 1) / 2.0) / half, "_p0": F.lit(1.0)} | {f"_b{k}": ratio(k) for k in range(1, degree + 1)})
    for k in range(1, degree + 1):
        named = named.withColumn(f"_p{k}", F.col("_x") * p[k - 1] - b[k - 1] * p[k - 2] if k > 1 else F.col("_x"))
    known = [f"_b{k}" for k in range(1, degree + 1)]
    sums = named.groupBy("player", "rows", "_half", *known).agg(*[F.sum(F.col("_y") * p[k]).alias(f"_s{k}") for k in range(degree + 1)])
    norm, weights = n, {}
    for k in range(degree + 1):
        norm = norm * b[k] if k else norm
        weights[f"_w{k}"] = F.when(n > k, F.col(f"_s{k}") / norm).otherwise(F.lit(0.0))
    # Each orthogonal polynomial written out in powers of x, then their weighted sum.
    powers = [[F.lit(1.0)]]
    for k in range(1, degree + 1):
        raised = [F.lit(0.0), *powers[k - 1]]
        powers.append([c - b[k - 1] * powers[k - 2][i] if k > 1 and i < k - 1 else c for i, c in enumerate(raised)])
    fit = {
        f"_f{i}": sum((F.col(f"_w{k}") * powers[k][i] for k in range(i + 1, degree + 1)), F.col(f"_w{i}") * powers[i][i])
        for i in range(degree + 1)
    }
    fitted = sums.withColumns(weights).withColumns(fit)
    names = [f"poly_{degree - i}" for i in range(degree + 1)]
    scaled_fit = [F.col(f"_f{i}") for i in range(degree + 1)]
    # x is 0 in the middle; a single row is its own middle, at position 0.
    moved = _shifted(scaled_fit, half)
    single = F.col("rows") == 1
    fits = fitted.select(
        "player", *[F.when(single, scaled_fit[k]).otherwise(moved[k]).alias(f"poly_{k}") for k in range(degree, -1, -1)]
    )
    return standardize(fits, names) if scaled else fits
