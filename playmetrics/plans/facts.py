"""Joining rows to one row of facts for each key, however many rows a key has.

A plain join deals all rows of a key to one task, or broadcasts the rows because they compress well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stretches import GRAIN

#: Facts that every task may hold: a few hundred bytes each.
FEW = 20_000


def with_facts(rows: DataFrame, facts: DataFrame, on: Column, size: Column) -> DataFrame:
    """Rows with the facts of their key; rows without facts are left out.

    ``facts``: a written table (it is counted) with one row per key and no column of ``rows``; ``size`` is the
    number of rows that a key has.  A few facts go to the rows.  Of more facts only those of keys with more than
    ``GRAIN`` rows do, of which there is one in that many rows at most; the other keys are joined by key.
    """
    if facts.count() <= FEW:
        return rows.join(F.broadcast(facts), on)
    large = facts.where(size > GRAIN).withColumn("_large", F.lit(True))
    marked = rows.join(F.broadcast(large), on, "left")
    rest = marked.where(F.col("_large").isNull()).select(*rows.columns)
    met = rest.join(facts.where(size <= GRAIN).hint("merge"), on)
    return marked.where("_large").drop("_large").unionByName(met)
