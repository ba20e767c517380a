"""Removal of repeated strings of a fixed length, found with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else. Two steps bring
the strings that may be equal together without moving the text of all of them:

1. The anchor of a string is the leftmost of its 16-byte pieces with the least hash: equal strings
   have equal anchors at equal offsets. Neighbouring strings with one anchor make up a slice. Only
   hashes of anchors and slices are counted over the corpus: an anchor seen once cannot repeat, and
   slices seen twice repeat as a whole.
2. Different slices of one anchor may share some strings. One copy of each is fetched, and their
   suffixes are sorted in two stages: those smaller than their successor directly, the others
   induced by a scan over the buckets; common prefixes of neighbours in that order tell the strings
   that repeat. An anchor with many different slices (a passage in very many documents has one where
   it begins and ends) is cut by offset into blocks; strings of a block share a core of bytes, so
   blocks with different cores are told apart by its hash, equal blocks collapse, and blocks of one
   string need no sorting. No task depends on how often a passage occurs: joins on an anchor or a slice that
   holds over a ``HOT``-th of all slices are salted. At most ``HOT`` are, so that list is broadcast.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all bytes; rows that
share id and text are separate documents and so repeat each other; null ids are allowed; periodic
text repeats itself; long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .common import columns_free, text_of

PIECE = 16
#: Documents are hashed together up to so many bytes (a longer one by itself).
TOGETHER = 2_000_000
#: Bytes of slices that are sorted together; a group of slices is not larger than this times two.
SORTED = 200_000
#: Different slices of one anchor that are sorted as they are; more are cut into blocks of strings.
MOST_SLICES = 250
#: Strings in a block, coarse to fine; blocks of over a quarter of a string are left out.
BLOCKS = (64, 8, 1)
#: An anchor or a slice is dealt to several tasks if it holds more than this part of all slices.
HOT = 1_024
SEPARATOR = b"\xff"
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


#: Suffixes are compared by so many bytes when they are sorted directly.
DEPTH = 512
#: A difference of two 8-byte words below the k-th step leaves k + 1 leading bytes equal.
BYTE_STEPS = np.array([1 << (64 - 8 * k) for k in range(1, 8)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number; the last places are padded with zeros."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(len(padded) // 8 * 8, np.uint64)
    for j in range(8):
        part = padded[j : j + (len(padded) - j) // 8 * 8].view(">u8")
        out[j::8][: len(part)] = part[: len(out[j::8])]
    return out[: len(data)]


def anchor_places(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces, and for the string at each place the place of its anchor."""
    words = words_at(data)
    with np.errstate(over="ignore"):
        h = words[: len(data) - PIECE + 1] * np.uint64(MIX[0])
        h ^= h >> np.uint64(29)
        h += words[8 : 8 + len(h)] * np.uint64(MIX[1])
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX[2])
        h ^= h >> np.uint64(31)
    span = length - PIECE + 1
    least, place, width = h, np.arange(len(h), dtype=np.int32), 1
    while width * 2 <= span:
        left, right = least[:-width], least[width:]
        later = right < left
        least = np.where(later, right, left)
        place = np.where(later, place[width:], place[:-width])
        width *= 2
    if width < span:
        shift = span - width
        later = least[shift:] < least[:-shift]
        place = np.where(later, place[shift:], place[:-shift])
    return h, place


def slices_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For texts put together: document number, anchor hash, slice hash, anchor place, first and last string.

    Places count from the start of the document.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h, place = anchor_places(data, length)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    whole = np.arange(len(place)) + length <= ends[owner]
    starts = np.flatnonzero(whole)
    at = place[starts]
    fresh = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])))[: len(starts)]
    first = starts[fresh]
    last = starts[np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1] if len(starts) else starts
    raw = data.tobytes()
    digest = xxhash.xxh3_64_intdigest
    parts = np.fromiter((digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    docs, anchors = owner[first], at[fresh]
    base = (ends - sizes)[docs]
    return docs, h[anchors].view(np.int64), parts.view(np.int64), anchors - base, first - base, last - base


def two_stage(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """The suffixes of ``data`` in order, by their first ``depth`` bytes at least.

    A suffix smaller than its successor is sorted directly. The others fill the front of their first
    byte's bucket, in the order in which a scan from the left meets their successors.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(data, np.uint8)
    # A run of one byte is smaller than its successor if the byte behind it is larger.
    differs = np.flatnonzero(codes[1:] != codes[:-1])
    run_end = np.append(differs, n - 1)
    following = np.append(codes[differs + 1].astype(np.int16), -1)
    smaller = np.repeat(following > codes[run_end], np.diff(np.concatenate(([-1], run_end))))
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: data[i : i + depth])
    counts = np.bincount(codes, minlength=256)
    heads = (np.cumsum(counts) - counts).tolist()
    order = [-1] * n
    at = (np.cumsum(counts) - np.bincount(codes[smaller], minlength=256)).tolist()
    for i in direct:
        code = data[i]
        order[at[code]] = i
        at[code] += 1
    induced = (~smaller).tolist()
    code = data[n - 1]
    order[heads[code]] = n - 1
    heads[code] += 1
    for k in range(n):
        i = order[k] - 1
        if i >= 0 and induced[i]:
            code = data[i]
            order[heads[code]] = i
            heads[code] += 1
    return np.array(order)


def common_prefixes(data: bytes, order: np.ndarray, limit: int) -> np.ndarray:
    """Common bytes of each suffix and the one before it in the order, counted up to ``limit``."""
    words = np.append(words_at(np.frombuffer(data, np.uint8)), np.zeros(limit + 8, np.uint64))
    out = np.zeros(len(order), np.int64)
    pairs = np.arange(1, len(order))
    a, b = order[pairs - 1], order[pairs]
    for k in range(0, limit, 8):
        apart = words[a + k] ^ words[b + k]
        same = apart == 0
        if (~same).any():
            exact = (apart[~same][:, None] < BYTE_STEPS).sum(axis=1)
            out[pairs[~same]] = np.minimum(k + exact, limit)
        pairs, a, b = pairs[same], a[same], b[same]
        if not len(pairs):
            break
    out[pairs] = limit
    ends = np.minimum(len(data) - order, limit)
    out[1:] = np.minimum(out[1:], np.minimum(ends[1:], ends[:-1]))
    return out


def repeated_strings(slices: list[bytes], length: int) -> list[np.ndarray]:
    """For each slice the places at which a string starts that also starts elsewhere in the slices."""
    data = SEPARATOR.join(slices) + SEPARATOR
    order = two_stage(data, length)
    common = common_prefixes(data, order, length)
    found = np.zeros(len(data) + 1, bool)
    hit = np.flatnonzero(common >= length)
    found[order[hit]] = True
    found[order[hit - 1]] = True
    out, at = [], 0
    for s in slices:
        strings = len(s) - length + 1
        out.append(np.flatnonzero(found[at : at + strings]))
        at += len(s) + 1
    return out


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


RANGES = "anchor bigint, part bigint, low int, high int"
SLICES = "anchor bigint, part bigint, near bigint, same bigint, low int, high int, slice binary"


def find_slices(docs: DataFrame, length: int) -> DataFrame:
    """``key, anchor, part, place, first, last`` of every slice of every document (``key``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "anchor", "part", "place", "first", "last"]
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            texts, held, size = [], [], 0
            for i, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                if len(data) >= length:
                    texts.append(data)
                    held.append(i)
                    size += len(data)
                if texts and (size >= TOGETHER or i + 1 == batch.num_rows):
                    owner, *rest = slices_of(texts, length)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[np.array(held)[owner]]), *map(pa.array, rest)], names)
                    texts, held, size = [], [], 0
            if texts:
                owner, *rest = slices_of(texts, length)
                yield pa.RecordBatch.from_arrays([pa.array(keys[np.array(held)[owner]]), *map(pa.array, rest)], names)

    return docs.mapInArrow(run, "key bigint, anchor bigint, part bigint, place bigint, first bigint, last bigint")


def fetch_slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted slices (``key, anchor, part, place, first, last``), as ``SLICES``.

    ``near`` and ``same`` start as the anchor and the slice hash: slices are sorted with those of one
    ``near``, and are equal in all their strings if ``same`` is equal too.
    """
    listed = wanted.groupBy(F.col("key").alias("k")).agg(
        F.collect_list(F.struct("anchor", "part", "place", "first", "last")).alias("cuts")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"], batch["cuts"], strict=True):
                data = text.encode()
                for c in cuts:
                    low, high = c["place"] - c["last"], c["place"] - c["first"]
                    slice_ = data[c["first"] : c["last"] + length]
                    out.append((c["anchor"], c["part"], c["anchor"], c["part"], low, high, slice_))
            yield pd.DataFrame(out, columns=[p.split()[0] for p in SLICES.split(", ")])

    return docs.join(listed, F.col("key") == F.col("k")).select("text", "cuts").mapInPandas(run, SLICES)


def cut_slices(slices: DataFrame, block: int, length: int, bare: bool = False) -> DataFrame:
    """Slices cut into blocks of ``block`` string offsets; ``near`` hashes the core, ``same`` the block.

    ``bare``: without the bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for number in range(r.low // block, r.high // block + 1):
                    low, high = max(r.low, number * block), min(r.high, number * block + block - 1)
                    part = r.slice[r.high - high : r.high - low + length]
                    core = r.slice[r.high - number * block : r.high + length - number * block - block + 1]
                    near = digest(b"%d,%d,%d," % (r.anchor, block, number) + core)
                    same = digest(b"%d,%d," % (low, high) + part)
                    out.append((r.anchor, r.part, _signed(near), _signed(same), low, high, None if bare else part))
            yield pd.DataFrame(out, columns=[p.split()[0] for p in SLICES.split(", ")])

    return slices.select(*[p.split()[0] for p in SLICES.split(", ")]).mapInPandas(run, SLICES)


def hot_ones(counted: DataFrame, by: list[str], total: int) -> DataFrame:
    """The ``by`` columns and ``salts`` of what occurs ``times`` more often than the ``HOT``-th part of ``total``."""
    salts = F.ceil(F.col("times") * HOT / F.lit(max(total, 1))).cast("int").alias("salts")
    return settle(counted.where(F.col("times") * HOT > total).select(*by, salts), "hot")


def salted_join(rows: DataFrame, other: DataFrame, hot: DataFrame, by: list[str], spread: list[str]) -> DataFrame:
    """Rows joined to ``other`` on ``by``; hot keys are dealt by a hash of ``spread``, their rows of ``other`` copied to each salt."""
    known = hot.select(*[F.col(c).alias(f"hot_{c}") for c in by], "salts")
    salts = F.coalesce("salts", F.lit(1))

    def told(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(known), [F.col(c) == F.col(f"hot_{c}") for c in by], "left")

    dealt = told(rows).select(*rows.columns, F.pmod(F.xxhash64(*spread), salts).cast("int").alias("salt"))
    copied = told(other).select(
        *[F.col(c).alias(f"on_{c}") if c in by else F.col(c) for c in other.columns],
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("on_salt"),
    )
    keys = [*by, "salt"]
    return dealt.join(copied, [F.col(c) == F.col(f"on_{c}") for c in keys]).drop("salt", *[f"on_{c}" for c in keys])


def _live(slices: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """The slices that can share a string with another of their anchor, and how many they are (``slices``).

    Strings are taken in blocks of a third of a string's length; two slices that share a string share the
    core of its block. Only hashes of cores are dealt out.
    """
    block = max(1, length // 3)
    cores = settle(cut_slices(slices, block, length, bare=True).select("anchor", "part", "near"), "cores")
    met = cores.groupBy(F.col("near").alias("n")).agg(F.min("part").alias("least"), F.max("part").alias("greatest"))
    shared = settle(met.where(F.col("least") != F.col("greatest")).select("n"), "shared")
    live = cores.join(shared, F.col("near") == F.col("n")).select("anchor", "part").distinct()
    sizes = live.groupBy("anchor").agg(F.count("*").alias("slices"))
    sized = salted_join(live, sizes, hot, ["anchor"], ["part"]).select(F.col("anchor").alias("a"), F.col("part").alias("p"), "slices")
    return slices.join(settle(sized, "sized"), (F.col("anchor") == F.col("a")) & (F.col("part") == F.col("p"))).drop("a", "p")


def sort_slices(slices: DataFrame, length: int) -> DataFrame:
    """``RANGES`` of offsets at which repeated strings start, by suffix arrays over groups of one ``near``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, near = [], 0, None

        def done():
            kept = {(r.near, r.same, r.anchor, r.part, r.low, r.high): r for r in held}
            # Slices that are equal in all their strings are one here; that they repeat is known already.
            alone = list({(r.near, r.same): r for r in kept.values()}.values())
            out = {}
            for r, places in zip(alone, repeated_strings([r.slice for r in alone], length), strict=True):
                out[r.near, r.same] = [(r.high - b, r.high - a) for a, b in _runs(places)]
            rows = [(r.anchor, r.part, low, high) for r in kept.values() for low, high in out[r.near, r.same]]
            return pd.DataFrame(rows, columns=["anchor", "part", "low", "high"])

        for batch in batches:
            for r in batch.itertuples(index=False):
                if held and r.near != near and size >= SORTED:
                    yield done()
                    held, size = [], 0
                near = r.near
                held.append(r)
                size += len(r.slice)
        if held:
            yield done()

    return slices.drop("slices").repartition("near").sortWithinPartitions("near", "same", "anchor", "part").mapInPandas(run, RANGES)


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """``key, first, last``: ranges of places at which repeated strings start."""
    found = settle(find_slices(docs, length), "slices")
    total = found.count()
    anchors = found.groupBy("anchor").agg(F.count("*").alias("times"), F.min("part").alias("least"), F.max("part").alias("greatest"))
    repeated = settle(anchors.where("times > 1").select("anchor", "times", (F.col("least") != F.col("greatest")).alias("mixed")), "anchors")
    hot = hot_ones(repeated, ["anchor"], total)
    seen = settle(salted_join(found, repeated.drop("times"), hot, ["anchor"], ["key", "place"]), "repeated")
    # Slices seen twice repeat as a whole.
    parts = settle(
        seen.groupBy("anchor", "part", "mixed").agg(F.count("*").alias("times"), F.min(F.struct("key", "first", "last", "place")).alias("one")),
        "parts",
    )
    whole = parts.where("times > 1").select("anchor", "part")
    # Anchors with different slices, unless all of them repeat as a whole.
    open_anchors = (
        parts.where("mixed")
        .groupBy("anchor")
        .agg(F.min("times").alias("fewest"))
        .where("fewest = 1")
    )
    wanted = salted_join(parts, open_anchors, hot, ["anchor"], ["part"]).select(
        "one.key", "anchor", "part", "one.place", "one.first", "one.last"
    )
    slices = settle(fetch_slices(docs, wanted, length), "bytes")
    slices = settle(_live(slices, hot, length), "live")
    ranges = None
    for block in [*[b for b in BLOCKS if 4 * b <= length], 0]:
        sorted_ = settle(sort_slices(slices.where(F.col("slices") <= MOST_SLICES), length), "sorted")
        ranges = sorted_ if ranges is None else ranges.unionByName(sorted_)
        many = slices.where(F.col("slices") > MOST_SLICES)
        if not block or many.isEmpty():
            break
        cut = settle(cut_slices(many, block, length), "blocks")
        # Equal blocks of different slices repeat as a whole.
        equal = cut.groupBy(F.col("near").alias("n"), F.col("same").alias("s")).agg(F.min("part").alias("least"), F.max("part").alias("greatest"))
        twice = settle(equal.where(F.col("least") != F.col("greatest")).select("n", "s"), "equal")
        both = (F.col("near") == F.col("n")) & (F.col("same") == F.col("s"))
        ranges = ranges.unionByName(settle(cut.join(twice, both).select("anchor", "part", "low", "high"), "blocks-whole"))
        groups = equal.groupBy("n").agg(F.count("*").alias("slices")).where(F.col("slices") > 1)
        slices = settle(cut.join(settle(groups, "groups"), F.col("near") == F.col("n")).drop("n"), "live")
    here = seen.select("key", "anchor", "part", "place", "first", "last")
    slice_ = ["anchor", "part"]
    hot_parts = hot_ones(parts, slice_, total)
    all_of = salted_join(here, whole, hot_parts, slice_, ["key", "place"])
    some_of = salted_join(here, ranges, hot_parts, slice_, ["key", "place"])
    return all_of.select("key", "first", "last").unionByName(
        some_of.select("key", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low")).alias("last"))
    )


def remove_repeated(
    docs: DataFrame, length: int = 400, carry: list[str] | None = None, text_col: str = "text"
) -> DataFrame:
    """The ``carry`` columns, ``n_bytes``, ``spans`` (removed byte runs: start, stop) and ``kept`` (binary)."""
    carry = ["doc_id"] if carry is None else carry
    held = F.struct(*[F.col(f"`{c}`") for c in carry])
    keyed = docs.select(
        F.xxhash64(*[F.col(f"`{c}`") for c in carry], text_of(text_col)).alias("key"), text_of(text_col).alias("text"), held.alias("held")
    )
    ranges = repeated_ranges(keyed.select("key", "text"), length).distinct()
    listed = ranges.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    kind = keyed.schema["held"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for r in sorted(ranges.as_py() or [], key=lambda r: (r["first"], r["last"])):
                    if runs and r["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r["last"] + length)
                    else:
                        runs.append([r["first"], r["last"] + length])
                edges = [0, *[e for run in runs for e in run], len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("held"), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
                ["held", "n_bytes", "spans", "kept"],
            )

    names = columns_free(docs.select(*[F.col(f"`{c}`") for c in carry]), "n_bytes", "spans", "kept")
    out = keyed.join(listed, F.col("key") == F.col("k"), "left").select("held", "text", "ranges")
    done = out.mapInArrow(run, f"held {kind}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return done.select("held.*", *[F.col(a).alias(b) for a, b in zip(("n_bytes", "spans", "kept"), names, strict=True)])
