"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its word shingles' hashes have it.
For a radius r, bit i gets the code 1 + i mod (2^(r+1) - 1), a non-zero vector of r+1 bits. Table v
(any non-zero vector) looks at the bits whose code has an odd overlap with v. The codes of up to r
differing bits span at most r dimensions, so some v is orthogonal to all of them: in that table the
pair agrees on every bit looked at. No pair within the radius is missed, whatever the data.

Inside a bucket no pairs are formed. For r = 2, each member is filed under itself and under itself
with one of the bits that the table does not look at flipped; two members within two bits meet
under a common middle, and all members under a middle are within two bits of each other. A middle
has at most 65 members, so neither a bucket nor a middle can become hot. General radii up to 2 are
supported this way (0: equal fingerprints only, 1: a member files the others under itself).

Defined cases: a null text counts as empty; no words give fingerprint zero, which is linked like any
other; fewer words than a shingle make one shingle; ties and repeated rows get equal results; null
ids are passed by when the smallest id is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .common import text_of
from .links import components
from .places import PATH, ROW, with_places, without

BITS = 64
SEED = 42


def fingerprint(text: str, size: int) -> int:
    """The SimHash of one text as an unsigned number; A-Z are lower-cased, words split at ASCII space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id, fp`` and the ``carry`` columns: the fingerprint of every row as a signed long with the same bits."""
    given = docs.select(F.col(id_col).alias("id"), *carry, text_of(text_col).alias("text"))
    kinds = dict(given.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch["text"]], np.uint64)
            yield batch[["id", *carry]].assign(fp=found.view(np.int64))

    return given.mapInPandas(score, f"id {kinds['id']}, {''.join(f'{c} {kinds[c]}, ' for c in carry)}fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The bits that each table looks at, as signed longs."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def links_within(points: DataFrame, radius: int) -> DataFrame:
    """``u, v`` links between the distinct fingerprints ``fp`` that differ in up to ``radius`` bits.

    Not every pair is listed, but linked points are connected through listed pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("a radius of 0, 1 or 2 bits is supported")
    masks = covering_masks(radius)
    table = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    )
    filed = points.select("fp", table.alias("b")).select("fp", "b.t", "b.key")
    shared = filed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = filed.join(shared, ["t", "key"]).select("t", "fp")
    flips = []
    for m in masks:
        free = [i for i in range(BITS) if not (m >> i) & 1]
        ones = [(1 << i) - (1 << BITS) if i == BITS - 1 else 1 << i for i in free]
        flips.append(F.array(F.lit(0).cast("bigint"), *[F.lit(x).cast("bigint") for x in (ones if radius else [])]))
    step = F.element_at(F.array(*flips), F.col("t") + 1)
    middles = members.select("fp", F.explode(step).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"))
    if radius == 1:
        # A link needs one end to be the middle itself.
        return (
            middles.where("fp <> mid")
            .distinct()
            .join(points.select(F.col("fp").alias("mid")), "mid")
            .select(F.col("fp").alias("u"), F.col("mid").alias("v"))
        )
    met = middles.groupBy("mid").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("u"), F.explode("met").alias("v")).where("u <> v").distinct()


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """``point, root``: the smallest fingerprint that each fingerprint of ``rows`` reaches over links."""
    points = settle(rows.select("fp").distinct(), "points")
    linked = components(links_within(points, radius))
    found = points.join(linked, points["fp"] == linked["node"], "left")
    return settle(found.select(F.col("fp").alias("point"), F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(
    docs: DataFrame, size: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, component``: each row's fingerprint and the smallest id reachable over links."""
    rows = settle(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = _classes(rows, radius)
    least = rows.groupBy("fp").agg(F.min("id").alias("first"))
    firsts = least.join(classes, F.col("fp") == F.col("point")).groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component"))
    named = settle(classes.join(firsts, F.col("root") == F.col("r")).select("point", "component"), "components")
    return rows.join(named, F.col("fp") == F.col("point")).select("id", "fp", "component")


def one_of_each(docs: DataFrame, size: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns; a null id comes last.

    Of several rows with that id one stays. Only rows that go, and a few others, are moved to be told apart.
    """
    held = with_places(docs)
    rows = settle(fingerprints(held, size, id_col, text_col, (PATH, ROW)), "fingerprints")
    classes = _classes(rows, radius)
    order = F.struct(F.col("id").isNull().alias("none"), "id", PATH, ROW)
    # Reduced by fingerprint first: a group of copies is one row when it meets its class.
    least = rows.groupBy("fp").agg(F.min(order).alias("first"))
    firsts = least.join(classes, F.col("fp") == F.col("point")).groupBy("root").agg(F.min("first").alias("first"))
    stay = firsts.select(F.col(f"first.{PATH}").alias(PATH), F.col(f"first.{ROW}").alias(ROW))
    return without(held, settle(rows.select(PATH, ROW).join(stay, [PATH, ROW], "left_anti"), "dropped"))


# Near copies at a stated similarity of whole texts ----------------------------------------------
#
# At a shingle similarity of 0.8 the fingerprints of whole texts differ in some ten bits, which no
# covering family can serve with selective buckets. So each distinct shingle set is filed under its
# first |S| - ceil(0.8 |S|) + 1 shingles in one order of all shingles: two sets that are similar enough
# share a filed shingle, whatever the order. Shingles that are frequent in a sample come last, which
# keeps the groups small and decides nothing else. Only links that connect matter: members of a group
# are first compared with two of them, then all pairs that are not connected yet are compared.

#: One in so many documents is counted to know the frequent shingles, and so many of these are kept.
COUNTED, FREQUENT = 8, 1 << 20
#: Members of a block; the pairs of a larger group are dealt out by pairs of blocks.
BLOCK = 256
#: Guards a rounded product of similarity and size from counting as the next whole number.
TINY = 1e-9


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles as signed longs, in ascending order; case is kept."""
    words = text.encode().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    spans = zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts)).view(np.int64))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``a, set`` of ``id, text``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"a": batch["id"], "set": [shingle_set(t, size) for t in batch["text"]]})

    return texts.mapInPandas(cut, "a bigint, set array<bigint>")


def _prefixes(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """``id, n, whole, keys``: the number of shingles, a digest of the set, and the shingles it is filed under."""
    counted = _sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0), size).select(F.explode("set").alias("key"))
    often = counted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    often = often.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    ranks = texts.sparkSession.sparkContext.broadcast((often["key"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count = ranks.value
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                found = shingle_set(t, size)
                whole, n = xxhash.xxh3_128_digest(found.tobytes()), len(found)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    found = found[np.argsort(np.where(known[at] == found, count[at], 0), kind="stable")]
                rows.append((i, n, whole, found[: n - math.ceil(similarity * n - TINY) + 1]))
            yield pd.DataFrame(rows, columns=["id", "n", "whole", "keys"])

    return texts.mapInPandas(file, "id bigint, n bigint, whole binary, keys array<bigint>")


def similar_pairs(docs: DataFrame, similarity: float, size: int, id_col: str, text_col: str = "text") -> DataFrame:
    """``u, v`` links between rows (ids unique) whose shingle sets have the similarity or more.

    Not every pair is listed, but similar rows are connected through listed pairs. A group whose
    members stay apart costs the square of its size, dealt out in blocks.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("text"))
    rows = settle(_prefixes(texts, similarity, size), "prefixes")
    firsts = rows.groupBy("whole").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    same = rows.join(firsts.where("rows > 1").select("whole", "first"), "whole").where("id <> first")
    equal = settle(same.select(F.col("id").alias("u"), F.col("first").alias("v")), "equal-sets")
    one_each = rows.join(equal.select(F.col("u").alias("id")), "id", "left_anti")
    filed = one_each.select("id", "n", F.posexplode("keys").alias("pos", "key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    filed = settle(filed.join(shared, "key"), "filed")

    def could(a: str, b: str):
        """Whether sizes allow the similarity, and the key can be the first one that both have."""
        (na, pa), (nb, pb) = ((F.col(f"{x}.n"), F.col(f"{x}.pos")) for x in (a, b))
        common = F.lit(similarity / (1 + similarity)) * (na + nb) - TINY
        sizes = F.least(na, nb) >= F.lit(similarity) * F.greatest(na, nb) - TINY
        return (F.col(f"{a}.id") != F.col(f"{b}.id")) & sizes & (F.least(na - pa, nb - pb) >= common)

    def alike(met: DataFrame, name: str) -> DataFrame:
        pairs = settle(met.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct(), f"asked-{name}")
        asked = pairs.select(F.col("u").alias("a")).union(pairs.select(F.col("v").alias("a"))).distinct()
        sets = settle(_sets(texts.join(asked, F.col("id") == F.col("a"), "left_semi"), size), f"sets-{name}")
        both = pairs.join(sets.withColumnsRenamed({"a": "u", "set": "su"}), "u").join(sets.withColumnsRenamed({"a": "v", "set": "sv"}), "v")
        common = F.size(F.array_intersect("su", "sv"))
        return settle(both.where(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v"), f"alike-{name}")

    # The member with the fewest rarer shingles is the one that variants come from; the other is the same in many groups.
    member, mixed = F.struct("id", "n", "pos"), F.xxhash64("id")
    heads = F.array_distinct(F.array(F.min_by(member, F.struct("pos", mixed)), F.min_by(member, mixed)))
    leaders = filed.groupBy("key").agg(heads.alias("heads"))
    led = filed.select("key", member.alias("a")).join(leaders, "key").select("a", F.explode("heads").alias("b"))
    near = alike(led.where(could("a", "b")), "led")

    linked = components(near)
    placed = filed.join(linked, F.col("id") == F.col("node"), "left").select("key", "members", member.alias("m"), F.coalesce("root", "id").alias("part"))
    placed = settle(placed, "placed")
    apart = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rest = placed.join(apart.select("key"), "key").withColumn("blocks", blocks)
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("m.id", "key"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = rest.select("key", F.col("m").alias("a"), F.col("part").alias("pa"), F.col("mine").alias("i"), F.explode(every).alias("j"))
    other = rest.select("key", F.col("m").alias("b"), F.col("part").alias("pb"), F.explode(every).alias("i"), F.col("mine").alias("j"))
    met = one.join(other, ["key", "i", "j"]).where((F.col("a.id") < F.col("b.id")) & (F.col("pa") != F.col("pb")) & could("a", "b"))
    return equal.unionByName(near).unionByName(alike(met.select("a", "b"), "apart"))


def near_copies(
    docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, component`` for rows with unique long ids: the smallest id reachable over links.

    Links join rows whose fingerprints differ in up to ``radius`` bits, and rows whose shingle sets
    have ``similarity`` or more.
    """
    exact = near_duplicates(docs, size, radius, id_col, text_col)
    edges = exact.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
    linked = components(edges.unionByName(similar_pairs(docs, similarity, size, id_col, text_col)))
    ids = docs.select(F.col(id_col).alias("id"))
    return ids.join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))
