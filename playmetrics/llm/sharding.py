"""Even shards by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group that stays together. Packing runs on two levels, so that no task
and no driver ever holds all groups:

1. Groups are dealt by their digest to packers. A packer takes its groups in decreasing size and puts
   each into the open bundle with the tightest remaining room that still holds it, found in a
   balanced tree (an AA tree ordered by room). A bundle has room for a 64th of a shard.
2. Of two bundles of one packer, one is more than half full at least, so there are at most
   2 * 64 * shards + packers bundles, whatever the data. These are packed the same way on the
   driver, into the smallest capacity that needs no more than the wanted number of shards; what that
   leaves uneven (the last shard opened) is levelled by moving single bundles.

A group larger than an even share cannot be kept whole with even shards: it is cut, by a hash of
the ids, into pieces of about a quarter of a share. There are fewer such groups than shards.

Defined cases: a null text has no bytes and is grouped with the empty text; every row adds a fixed
overhead; ties in size are broken by digest; rows that share an id keep together with their text; a
null id takes part like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle
from .common import text_of

BUNDLES_A_SHARD = 64
GROUPS_A_PACKER = 50_000
MOST_PACKERS = 4_096
ROWS_A_STRETCH = 50_000
PIECES_A_SHARE = 4


class Room:
    """A balanced (AA) tree of open bins, ordered by remaining room, then number."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is [key, level, left, right]

    @staticmethod
    def _skew(n):
        left = n[2]
        if left is not None and left[1] == n[1]:
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        right = n[3]
        if right is not None and right[3] is not None and right[3][1] == n[1]:
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def add(self, key) -> None:
        def put(n):
            if n is None:
                return [key, 1, None, None]
            side = 2 if key < n[0] else 3
            n[side] = put(n[side])
            return self._split(self._skew(n))

        self.root = put(self.root)

    def tightest(self, size):
        """The smallest key with room for ``size``, or None."""
        n, found = self.root, None
        while n is not None:
            if n[0][0] >= size:
                n, found = n[2], n[0]
            else:
                n = n[3]
        return found

    def remove(self, key) -> None:
        def lower(n):
            most = 1 + min(n[2][1] if n[2] else 0, n[3][1] if n[3] else 0)
            if most < n[1]:
                n[1] = most
                if n[3] is not None and n[3][1] > most:
                    n[3][1] = most
            n = self._skew(n)
            if n[3] is not None:
                n[3] = self._skew(n[3])
                if n[3][3] is not None:
                    n[3][3] = self._skew(n[3][3])
            n = self._split(n)
            if n[3] is not None:
                n[3] = self._split(n[3])
            return n

        def cut(n, key):
            if key < n[0]:
                n[2] = cut(n[2], key)
            elif n[0] < key:
                n[3] = cut(n[3], key)
            elif n[2] is None:
                return n[3]
            else:
                before = n[2]
                while before[3] is not None:
                    before = before[3]
                n[0] = before[0]
                n[2] = cut(n[2], before[0])
            return lower(n)

        self.root = cut(self.root, key)


def best_fit(sizes: Iterable[int], capacity: int) -> Iterator[int]:
    """The bin of each size, taken in the order given; a size above the capacity gets its own bin."""
    room, bins = Room(), 0
    for size in sizes:
        found = room.tightest(size)
        if found is None:
            left, number = capacity - size, bins
            bins += 1
        else:
            room.remove(found)
            left, number = found[0] - size, found[1]
        if left > 0:
            room.add((left, number))
        yield number


def smallest_capacity(sizes: list[int], bins: int) -> list[int]:
    """Pack decreasing ``sizes`` into at most ``bins`` bins of the least capacity that search finds."""
    total = sum(sizes)
    low, high = max([-(-total // bins), *sizes[:1]]), max(total, 1)
    packed = list(best_fit(sizes, high))
    while low < high:
        middle = (low + high) // 2
        tried = list(best_fit(sizes, middle))
        if max(tried, default=0) < bins:
            packed, high = tried, middle
        else:
            low = middle + 1
    return packed


def level(sizes: list[int], packed: list[int], bins: int) -> list[int]:
    """Move items from the fullest possible to the emptiest bin as long as that brings the two closer."""
    packed, totals = list(packed), [0] * bins
    inside: list[list[int]] = [[] for _ in range(bins)]
    for item, number in enumerate(packed):
        totals[number] += sizes[item]
        inside[number].append(item)
    for _ in range(8 * len(sizes)):
        empty = min(range(bins), key=totals.__getitem__)
        for full in sorted(range(bins), key=totals.__getitem__, reverse=True):
            gap = totals[full] - totals[empty]
            fits = [i for i in inside[full] if 0 < sizes[i] < gap]
            if fits:
                break
        else:
            break
        item = min(fits, key=lambda i: abs(gap - 2 * sizes[i]))
        inside[full].remove(item)
        inside[empty].append(item)
        packed[item] = empty
        totals[full] -= sizes[item]
        totals[empty] += sizes[item]
    return packed


def _row_sizes(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def shard_by_bytes(
    docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, size, crc, digest, shard, slot``: each row's shard and its gapless place in it."""
    spark = docs.sparkSession
    rows = settle(_row_sizes(docs, id_col, text_col, overhead), "sizes")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    share = max(1, -(-(total or 0) // shards))

    # Fewer groups than shards are above a share: their sizes sum up to the total at most.
    large = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share)
    cuts = large.select(F.col("digest").alias("cut"), F.ceil(PIECES_A_SHARE * F.col("bytes") / share).cast("bigint").alias("pieces"))
    piece = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("pieces")))
    rows = rows.join(F.broadcast(cuts), F.col("digest") == F.col("cut"), "left").select(
        "id", "size", "crc", "digest", piece.cast("bigint").alias("piece")
    )
    groups = settle(rows.groupBy("digest", "piece").agg(F.sum("size").alias("bytes")), "groups")

    packers = min(MOST_PACKERS, 1 + groups.count() // GROUPS_A_PACKER)
    capacity = max(1, share // BUNDLES_A_SHARD)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def listed():
            for batch in batches:
                yield from zip(batch["packer"], batch["bytes"], batch["digest"], batch["piece"], strict=True)

        room, at, bins, out = Room(), None, 0, []
        for packer, size, digest, piece in listed():
            if packer != at:
                room, at, bins = Room(), packer, 0
            found = room.tightest(size)
            if found is None:
                left, number, bins = capacity - size, bins, bins + 1
            else:
                room.remove(found)
                left, number = found[0] - size, found[1]
            if left > 0:
                room.add((left, number))
            out.append((packer, number, size, digest, piece))
            if len(out) == 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["packer", "bundle", "bytes", "digest", "piece"]
    bundled = settle(
        groups.withColumn("packer", F.pmod(F.xxhash64("digest", "piece"), F.lit(packers)))
        .repartition(packers, "packer")
        .sortWithinPartitions("packer", F.desc("bytes"), "digest", "piece")
        .mapInPandas(pack, "packer bigint, bundle bigint, bytes bigint, digest binary, piece bigint"),
        "bundles",
    )
    # At most 2 * 64 * shards + packers rows.
    bundles = bundled.groupBy("packer", "bundle").agg(F.sum("bytes").alias("bytes")).collect()
    bundles.sort(key=lambda b: (-b["bytes"], b["packer"], b["bundle"]))
    sizes = [b["bytes"] for b in bundles]
    bins = level(sizes, smallest_capacity(sizes, shards), shards)
    placed = spark.createDataFrame(
        [(b["packer"], b["bundle"], n) for b, n in zip(bundles, bins, strict=True)], "packer bigint, bundle bigint, shard int"
    )
    where = bundled.join(F.broadcast(placed), ["packer", "bundle"]).select(
        F.col("digest").alias("d"), F.col("piece").alias("p"), "shard"
    )
    joined = rows.join(where, (F.col("digest") == F.col("d")) & (F.col("piece") == F.col("p"))).select(
        "id", "size", "crc", "digest", "shard"
    )
    return with_slots(joined, count, F.xxhash64("id", "digest"), "id", "digest")


def with_slots(rows: DataFrame, count: int, spread: Column, *order: str) -> DataFrame:
    """Add ``slot``, a gapless number from 0 within each ``shard``.

    Rows of a shard are numbered in stretches dealt by a hash; the stretches' counts (one small row
    for every ``ROWS_A_STRETCH`` rows and shard) give their offsets.
    """
    stretches = 1 + count // ROWS_A_STRETCH
    rows = settle(rows.withColumn("stretch", F.pmod(spread, F.lit(stretches * 8))), "placed")
    counts = rows.groupBy("shard", "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy(*order)) - 1
    return (
        rows.withColumn("at", at)
        .join(offsets, ["shard", "stretch"])
        .withColumn("slot", (F.col("at") + F.col("before")).cast("bigint"))
        .drop("stretch", "at", "before")
    )
