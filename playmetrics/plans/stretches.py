"""Histories of any length, cut by rows into stretches that tasks can hold.

Most histories are short: they are ordered whole, each in one task, after one shuffle.  Those with
more rows than ``grain`` (a bot, a shared account, a default id that holds a third of all rows) are
cut where the rows are: Spark samples their positions and deals the rows into ranges of about ``grain``
rows, so a busy hour gives many stretches and a quiet month one, and a busy second is cut by event id.

`Relay` follows a chain through such histories, where what happens at a row depends on where the event
before fell.  Each stretch first becomes a table that says, for each of the few states in which the
chain can come in, in which state it goes out.  The tables of a history are then put
together one after the other, without their rows, and each stretch is walked from the state
that really came in.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle

GRAIN = 1_000_000
STRETCH = "_stretch"
#: Most stretches that one job makes.
MOST_STRETCHES = 100_000

#: Inputs lately seen to hold no long history. A note that is out of date costs speed, no result.
_SHORT: OrderedDict[tuple, None] = OrderedDict()


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equal in all columns, nulls included."""
    condition = F.lit(True)
    for c in columns:
        condition &= left[c].eqNullSafe(right[f"_{c}"])
    return condition


def renamed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The key columns with a leading underscore, for `same`."""
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def split(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], grain: int, bound: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short histories, and those of long ones with their ``_stretch`` (None if there are none).

    ``bound`` has at least as many rows per history as ``df`` and is cheaper to count.  Stretches ascend
    in ``order`` within a history.
    """
    counted = (df if bound is None else bound).select(*keys)
    note = (id(df.sparkSession), counted.semanticHash(), grain)
    if note in _SHORT:
        _SHORT.move_to_end(note)
        return df, None
    long = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > grain)
    size = long.agg(F.sum("_n").alias("rows")).first()["rows"]
    if size is None:
        _SHORT[note] = None
        if len(_SHORT) > 256:
            _SHORT.popitem(last=False)
        return df, None
    named = settle(renamed(long.drop("_n"), keys), "long")
    parts = min(MOST_STRETCHES, -(-size // grain))
    ranged = df.join(named, same(df, named, keys), "left_semi").repartitionByRange(parts, *keys, *order)
    held = settle(ranged.withColumn(STRETCH, F.spark_partition_id()), "stretches")
    return df.join(named, same(df, named, keys), "left_anti"), held


Rows = dict[str, np.ndarray]
State = tuple[int, ...]


@dataclass(frozen=True)
class Relay:
    """A chain through rows in order.  A state is a tuple of whole numbers, empty before the first row.

    ``walk`` turns rows and the state before them into result columns and the state after them.
    ``table`` turns a stretch into a matrix of whole numbers, from which ``step`` finds the state
    after the stretch for a state before it.
    """

    walk: Callable[[Rows, State], tuple[Rows, State]]
    table: Callable[[Rows], np.ndarray]
    step: Callable[[np.ndarray, State], State]


def _groups(batch: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, stop) of the groups of a sorted batch."""
    codes = np.zeros(len(batch), np.int64)
    changed = np.zeros(len(batch), bool)
    changed[0] = True
    for k in keys:
        codes, _ = pd.factorize(batch[k], use_na_sentinel=False)
        changed[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(changed)
    named = batch[list(keys)].iloc[starts]
    for key, start, stop in zip(named.itertuples(index=False, name=None), starts, [*starts[1:], len(batch)], strict=True):
        yield tuple(None if pd.isna(x) else x for x in key), int(start), int(stop)


def _walker(relay: Relay, keys: Sequence[str], columns: Sequence[str], made: Sequence[str], given: bool):
    marks = [*keys, STRETCH] if given else list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), ()
        for batch in batches:
            if batch.empty:
                continue
            arrays = {c: batch[c].to_numpy() for c in columns}
            parts, names, sizes = [], [], []
            for found, start, stop in _groups(batch, marks):
                if found != key:
                    key, state = found, tuple(int(x) for x in batch["_state"].iloc[start]) if given else ()
                part, state = relay.walk({c: a[start:stop] for c, a in arrays.items()}, state)
                parts.append(part)
                names.append(found)
                sizes.append(len(part[made[0]]))
            out = {k: np.repeat(np.array([n[i] for n in names]), sizes) for i, k in enumerate(keys)}
            out |= {c: np.concatenate([p[c] for p in parts]) for c in made}
            yield pd.DataFrame(out)

    return run


def _tables(relay: Relay, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order))
        cells = np.ascontiguousarray(relay.table({c: rows[c].to_numpy() for c in columns}), np.int64)
        named = {k: rows[k].iloc[:1].to_list() for k in (*keys, STRETCH)}
        return pd.DataFrame({**named, "height": [len(cells)], "cells": [cells.tobytes()]})

    return run


def _carrier(relay: Relay, keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), ()
        for batch in batches:
            states = []
            for found, start, stop in _groups(batch, keys) if len(batch) else ():
                if found != key:
                    key, state = found, ()
                for height, cells in zip(batch["height"].iloc[start:stop], batch["cells"].iloc[start:stop], strict=True):
                    states.append(list(state))
                    state = relay.step(np.frombuffer(cells, np.int64).reshape(height, -1), state)
            yield batch[[*keys, STRETCH]].assign(_state=states)

    return run


def follow(
    df: DataFrame,
    relay: Relay,
    made: str,
    keys: Sequence[str],
    order: Sequence[str],
    grain: int = GRAIN,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Walk all histories: ``keys`` and the columns ``made`` (a schema) that the relay makes."""
    columns = [c for c in df.columns if c not in keys]
    kinds = dict(df.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    names = [part.split()[0] for part in made.split(", ")]
    short, long = split(df, keys, order, grain, bound)
    # A history may arrive in several batches; only its state is kept between them.
    placed = short.repartition(*keys).sortWithinPartitions(*keys, *order)
    out = placed.mapInPandas(_walker(relay, keys, columns, names, False), f"{named}, {made}")
    if long is None:
        return out
    tables = long.groupBy(*keys, STRETCH).applyInPandas(
        _tables(relay, keys, order, columns), f"{named}, {STRETCH} int, height int, cells binary"
    )
    states = tables.repartition(*keys).sortWithinPartitions(*keys, STRETCH).mapInPandas(
        _carrier(relay, keys), f"{named}, {STRETCH} int, _state array<bigint>"
    )
    known = renamed(settle(states, "states"), [*keys, STRETCH])
    started = long.join(known, same(long, known, [*keys, STRETCH])).select(*keys, *columns, STRETCH, "_state")
    walked = started.repartition(*keys, STRETCH).sortWithinPartitions(*keys, STRETCH, *order)
    return out.unionByName(walked.mapInPandas(_walker(relay, keys, columns, names, True), f"{named}, {made}"))
