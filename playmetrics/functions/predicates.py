"""Predicates on actions and day slots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def match(column: Column | str, wanted: str | Sequence[str], how: str = "exact") -> Column:
    """Does an action match?

    ``exact``: equal to ``wanted``; ``in`` / ``not_in``: (not) a member of the list;
    ``substring``: contained in the string ``wanted``.
    """
    col = F.col(column) if isinstance(column, str) else column
    if how == "exact":
        return col == F.lit(wanted)
    if how == "in":
        return col.isin(list(wanted))
    if how == "not_in":
        return ~col.isin(list(wanted))
    if how == "substring":
        return F.instr(F.lit(wanted), col) > 0
    raise ValueError(f"unknown match: {how}")


def action_is(column: Column | str, wanted: str | Sequence[str]) -> Column:
    """Exact match for one action, membership for a list."""
    return match(column, wanted, "exact" if isinstance(wanted, str) else "in")


def has_keyword(column: Column | str, keywords: Sequence[str]) -> Column:
    """Any of the keywords is contained in the action."""
    col = F.col(column) if isinstance(column, str) else column
    return reduce(or_, [F.contains(col, F.lit(k)) for k in keywords])


def last_segment(column: Column | str, sep: str = "/") -> Column:
    """Last part of a separated UI path."""
    return F.substring_index(column, sep, -1)


def day_slot(hour: Column) -> Column:
    """Hour of day to slot: 8-12 morning, 13-14 noon, 15-18 afternoon, else night."""
    return (
        F.when(hour.between(8, 12), "morning")
        .when(hour.between(13, 14), "noon")
        .when(hour.between(15, 18), "afternoon")
        .otherwise("night")
    )


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equality within a tolerance relative to ``b``."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
