"""Ordered per-player scans that survive very long histories.

Short histories are plain windows by their keys: one shuffle, shared by all scans that build on each other.
A history with more rows than ``grain`` (a bot, a shared account, a default id may hold a third of
all rows) would be one task's work, so it is cut by rows into stretches (`stretches.split`):

1. windows run inside a stretch;
2. each stretch is reduced to one summary row, where it lies;
3. a window over the summaries, one per ``grain`` rows, gives each stretch what came before it;
4. the summaries are joined back on ``(keys, stretch)``, the partitioning the rows already have.

The result is that of the plain window for every grain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .stretches import GRAIN, STRETCH, renamed, same, split

ORDER = ("ts", "event_id")


def position(order: Sequence[str] = ORDER) -> Column:
    """The sort position of a row as one comparable value."""
    return F.struct(*order)


@dataclass(frozen=True)
class Prev:
    """``name``: struct of ``columns`` as they were on the previous row; null on the first."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class RowNumber:
    """``name``: 1-based position of the row in its history."""

    name: str


@dataclass(frozen=True)
class RunSum:
    """``name``: sum of ``value`` over the rows so far, with or without the current one."""

    name: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class LinkSum:
    """``name``: sum so far of ``value(previous, current)``, both structs of ``columns``.

    The first row of a history has no previous row and adds ``first``.
    """

    name: str
    columns: tuple[str, ...]
    value: Callable[[Column, Column], Column]
    first: int = 1


@dataclass(frozen=True)
class LastSeen:
    """``name``: latest non-null ``value`` before the row (or up to it).

    ``numbered``: the result is ``struct(rn, value)``, ``rn`` the row number it came from.
    """

    name: str
    value: Column
    inclusive: bool = False
    numbered: bool = False


@dataclass(frozen=True)
class FirstSeen:
    """``name``: earliest non-null ``value`` up to the row; ``numbered`` as in `LastSeen`."""

    name: str
    value: Column
    numbered: bool = False


@dataclass(frozen=True)
class Total:
    """``name``: sum, min or max of ``value`` over the whole history, on every row."""

    name: str
    value: Column
    how: str = "sum"


Spec = Prev | RowNumber | RunSum | LinkSum | LastSeen | FirstSeen | Total
_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _payload(spec: LastSeen | FirstSeen) -> Column:
    if spec.numbered:
        value = F.struct(F.col("_rn").cast("bigint").alias("rn"), spec.value.alias("value"))
        return F.when(spec.value.isNotNull(), value)
    return spec.value


class Histories:
    """Rows of histories, to which ordered columns are added step by step.

    Give it only the columns that are needed: all of them travel.  A null key is a key of its own, a
    null in the order comes first.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str] = ("player",),
        grain: int = GRAIN,
        order: Sequence[str] = ORDER,
    ) -> None:
        self.keys, self.order = list(keys), list(order)
        short, long = split(df, self.keys, self.order, grain)
        self.short, self.long = short, None if long is None else long.repartition(*self.keys, STRETCH)

    def let(self, **columns: Column) -> Histories:
        """Add columns computed from a row alone."""
        return self._each(lambda rows: rows.withColumns(columns))

    def where(self, condition: Column) -> Histories:
        """Keep some rows; later scans see only these."""
        return self._each(lambda rows: rows.where(condition))

    def _each(self, change: Callable[[DataFrame], DataFrame]) -> Histories:
        self.short = change(self.short)
        self.long = None if self.long is None else change(self.long)
        return self

    def done(self) -> DataFrame:
        return self.short if self.long is None else self.short.unionByName(self.long.drop(STRETCH))

    def add(self, *specs: Spec) -> Histories:
        """Add one column per spec, computed over each history in order."""
        self.short = _whole(self.short, specs, self.keys, self.order)
        self.long = None if self.long is None else _in_stretches(self.long, specs, self.keys, self.order)
        return self


def _numbered(rows: DataFrame, specs: Sequence[Spec], inside: WindowSpec) -> DataFrame:
    """With the helper columns of the specs: row number, and the row before of linked sums."""
    if any(isinstance(s, RowNumber) or getattr(s, "numbered", False) for s in specs):
        rows = rows.withColumn("_rn", F.row_number().over(inside))
    for s in specs:
        if isinstance(s, LinkSum):
            rows = rows.withColumn(f"_l_{s.name}", F.lag(F.struct(*s.columns)).over(inside))
    return rows


def _whole(rows: DataFrame, specs: Sequence[Spec], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Histories that one task can hold: plain windows."""
    columns, parts = rows.columns, Window.partitionBy(*keys)
    inside = parts.orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for s in specs:
        match s:
            case Prev():
                value = F.lag(F.struct(*s.columns)).over(inside)
            case RowNumber():
                value = F.col("_rn").cast("bigint")
            case RunSum():
                value = F.coalesce(F.sum(s.value).over(upto if s.inclusive else earlier), F.lit(0))
            case LinkSum():
                before = F.col(f"_l_{s.name}")
                step = F.when(before.isNotNull(), s.value(before, F.struct(*s.columns))).otherwise(F.lit(s.first))
                value = F.sum(step).over(upto)
            case LastSeen():
                value = F.last(_payload(s), ignorenulls=True).over(upto if s.inclusive else earlier)
            case FirstSeen():
                value = F.first(_payload(s), ignorenulls=True).over(upto)
            case Total():
                value = _FOLDS[s.how](s.value).over(parts)
        out.append(value.alias(s.name))
    return _numbered(rows, specs, inside).select(*columns, *out)


def _in_stretches(rows: DataFrame, specs: Sequence[Spec], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Histories in stretches: inside each, then with what it inherits."""
    part, columns = [*keys, STRETCH], rows.columns
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(rows.dtypes)
    rows = _numbered(rows, specs, inside)
    at = position(order)
    local, summary = [], [F.count(F.lit(1)).alias("_n")]
    for s in specs:
        part_name = f"_s_{s.name}"
        match s:
            case Prev():
                image = F.struct(*s.columns)
                local.append(F.lag(image).over(inside).alias(s.name))
                summary.append(F.max_by(image, at).alias(part_name))
            case RowNumber():
                local.append(F.col("_rn").cast("bigint").alias(s.name))
            case RunSum():
                frame = upto if s.inclusive else earlier
                local.append(F.coalesce(F.sum(s.value).over(frame), F.lit(0)).alias(s.name))
                summary.append(F.sum(s.value).alias(part_name))
            case LinkSum():
                image, before = F.struct(*s.columns), F.col(f"_l_{s.name}")
                step = F.when(before.isNotNull(), s.value(before, image)).otherwise(F.lit(0))
                local.append(F.sum(step).over(upto).alias(s.name))
                ends = F.struct(
                    F.sum(step).alias("sum"),
                    F.min_by(image, at).alias("first"),
                    F.max_by(image, at).alias("last"),
                )
                summary.append(ends.alias(part_name))
            case LastSeen() | FirstSeen():
                value = _payload(s)
                seen = F.when(value.isNotNull(), at)
                if isinstance(s, LastSeen):
                    frame = upto if s.inclusive else earlier
                    local.append(F.last(value, ignorenulls=True).over(frame).alias(s.name))
                    summary.append(F.max_by(value, seen).alias(part_name))
                else:
                    local.append(F.first(value, ignorenulls=True).over(upto).alias(s.name))
                    summary.append(F.min_by(value, seen).alias(part_name))
            case Total():
                summary.append(_FOLDS[s.how](s.value).alias(part_name))

    # The summaries read every column of the rows, so that both branches ask for the same
    # exchange and Spark builds it once.
    whole = F.max(F.xxhash64(*[c for c in columns if not kinds[c].startswith("map")]))
    stretches = rows.groupBy(*part).agg(*summary, whole.alias("_whole")).where(F.col("_whole").isNotNull())
    given = renamed(_carry(stretches, specs, keys), part)
    ready = rows.select("*", *local)
    joined = ready.join(given, same(ready, given, part))
    return joined.select(*columns, *[_combined(s).alias(s.name) for s in specs])


def _combined(s: Spec) -> Column:
    """A row's value from its own stretch and what the stretch inherits."""
    here, before = F.col(s.name), F.col(f"_c_{s.name}")
    match s:
        case Prev():
            return F.coalesce(here, before)
        case RowNumber():
            return here + F.col("_base")
        case RunSum() | LinkSum():
            return here + F.coalesce(before, F.lit(0))
        case Total():
            return before
    if s.numbered:
        here = _moved(here)
    return F.coalesce(here, before) if isinstance(s, LastSeen) else F.coalesce(before, here)


def _moved(value: Column) -> Column:
    """A numbered value with its row number counted from the start of the history."""
    shifted = F.struct((value["rn"] + F.col("_base")).alias("rn"), value["value"].alias("value"))
    return F.when(value.isNotNull(), shifted)


def _carry(summary: DataFrame, specs: Sequence[Spec], keys: Sequence[str]) -> DataFrame:
    """What each stretch inherits from the stretches before it; one row per stretch."""
    stretches = Window.partitionBy(*keys).orderBy(STRETCH)
    before = stretches.rowsBetween(Window.unboundedPreceding, -1)
    upto = stretches.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = stretches.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    based = summary.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    for s in specs:
        if isinstance(s, LinkSum):
            based = based.withColumn(f"_p_{s.name}", F.lag(F.col(f"_s_{s.name}.last")).over(stretches))
    out = []
    for s in specs:
        value = F.col(f"_s_{s.name}")
        if getattr(s, "numbered", False):
            value = _moved(value)
        match s:
            case Prev():
                carried = F.lag(value).over(stretches)
            case RunSum():
                carried = F.sum(value).over(before)
            case LinkSum():
                # The first row of a stretch is linked to the last row of the one before.
                prior = F.col(f"_p_{s.name}")
                link = F.when(prior.isNotNull(), s.value(prior, value["first"])).otherwise(F.lit(s.first))
                carried = F.coalesce(F.sum(value["sum"]).over(before), F.lit(0)) + F.sum(link).over(upto)
            case LastSeen():
                carried = F.last(value, ignorenulls=True).over(before)
            case FirstSeen():
                carried = F.first(value, ignorenulls=True).over(before)
            case Total():
                carried = _FOLDS[s.how](value).over(whole)
            case _:
                continue
        out.append(carried.alias(f"_c_{s.name}"))
    return based.select(*keys, STRETCH, "_base", *out)


def running(
    df: DataFrame,
    *specs: Spec,
    keys: Sequence[str] = ("player",),
    grain: int = GRAIN,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """One scan: add one column per spec, computed over each history in ``order``."""
    return Histories(df, keys, grain, order).add(*specs).done()
