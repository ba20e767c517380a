"""A Merkle manifest of a table: one leaf per row, one tree per group, one tree over the groups.

Leaves of a group ascend by id. Their places are not found by sorting rows: the ids of a group form a
bitmap of 64-bit words of which only those with a set bit are kept, merged by partial aggregation; a popcount
directory holds for every word how many ids come before it, in two steps (words in a block of 1,024,
blocks of a group). A row asks for its rank: the directory's count and the set bits below its own.

Nodes are then filed in slot arrays keyed by (group, place / 256); each array is reduced by as many
levels as it can be at once and hands one node to the next round. Sibling digests come back down the
same arrays, so a row never meets more than its own array and the path above it.

Ids that repeat, and null ids, have no place of their own in a bitmap. Rows of such words are ranked by (id, leaf) in a
global order, equal rows as one with a count. A null id comes before all others, a null group before all
groups. A null in any column of a leaf is written ``-``. An empty table gives no rows. Names of further columns do
not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import running_total
from ..sources.tables import settle

#: Most nodes in a slot array.
SLOTS = 256

#: Word of null ids: below any other, as ids are shifted by six bits.
NO_WORD = -(1 << 60)

#: Copies of one row that are written out by one task.
COPIES = 10_000


def digest(text: Column) -> Column:
    """Lowercase hex of the sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value with its length in bytes, a null as ``-``."""
    parts = []
    for value in values:
        text = value.cast("string")
        named = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(named, F.lit("-")))
    return digest(F.concat(*parts))


def _below(bits: str) -> Column:
    """Set bits of a word below the row's own."""
    return F.expr(f"bit_count({bits} & ~shiftleft(-1L, cast(id & 63 AS INT)))")


def id_directory(rows: DataFrame) -> DataFrame:
    """``grp, word, bits, n, total, base``: words of the id bitmaps with the rows before each in its group."""
    words = settle(
        rows.groupBy("grp", "word").agg(
            F.expr("bit_or(shiftleft(1L, cast(id & 63 AS INT)))").alias("bits"), F.count(F.lit(1)).alias("n")
        ),
        "words",
    ).withColumn("block", F.shiftright("word", 10))
    blocks = words.groupBy("grp", "block").agg(F.sum("n").alias("block_n"))
    blocks = settle(running_total(blocks, ["grp", "block"], F.col("block_n"), "before"), "directory")
    groups = blocks.groupBy("grp").agg(F.sum("block_n").alias("total"), F.min("before").alias("first"))
    inside = Window.partitionBy("grp", "block").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    local = words.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (
        local.join(blocks, ["grp", "block"])
        .join(groups, "grp")
        .select("grp", "word", "bits", "n", "total", (F.col("before") - F.col("first") + F.col("local")).alias("base"))
    )


def places(rows: DataFrame) -> DataFrame:
    """``grp, pos, total, digest, held`` of every leaf: its rank in its group by (id, leaf).

    ``rows`` has ``grp, id, leaf, other``.
    """
    rows = rows.withColumn("word", F.coalesce(F.expr("shiftright(id, 6)"), F.lit(NO_WORD)))
    directory = settle(id_directory(rows), "ranks")
    shared = F.col("n") > F.coalesce(F.expr("bit_count(bits)"), F.lit(0))
    found = rows.join(directory, ["grp", "word"])
    held = F.struct("id", "other").alias("held")
    out = found.where(~shared).select(
        "grp", (F.col("base") + _below("bits")).alias("pos"), "total", F.col("leaf").alias("digest"), held
    )
    if directory.where(shared).isEmpty():
        return out
    equal = found.where(shared).groupBy("grp", "word", "id", "leaf").agg(
        F.count(F.lit(1)).alias("m"), F.first("other").alias("other"), F.first("base").alias("base"), F.first("total").alias("total")
    )
    ranked = settle(running_total(equal, ["grp", "word", "id", "leaf"], F.col("m"), "before"), "shared")
    firsts = ranked.groupBy("grp", "word").agg(F.min("before").alias("first"))
    start = F.col("base") + F.col("before") - F.col("first")
    pieces = (
        ranked.join(firsts, ["grp", "word"])
        .withColumn("start", start)
        .withColumn("skip", F.explode(F.expr(f"sequence(0L, m - 1, {COPIES}L)")))
        .repartition("grp", "id", "leaf", "skip")
        .withColumn("copy", F.explode(F.expr(f"sequence(skip, least(m, skip + {COPIES}) - 1)")))
    )
    return out.unionByName(
        pieces.select("grp", (F.col("start") + F.col("copy")).alias("pos"), "total", F.col("leaf").alias("digest"), held)
    )


def _steps(arity: int) -> int:
    """Levels that one slot array is reduced by."""
    k = 1
    while arity ** (k + 1) <= SLOTS:
        k += 1
    return k


def _parents(arity: int):
    """One level up: each run of ``arity`` nodes becomes its digest."""

    def up(level: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(level), F.lit(arity))
        return F.transform(starts, lambda s: digest(F.array_join(F.slice(level, s, arity), "")))

    return up


def climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Slot arrays of all rounds, lowest first: ``grp, block, total, slots, levels``.

    ``nodes`` has ``grp, pos, total, digest, held``; ``total`` is the group's number of nodes.
    """
    k = _steps(arity)
    width, up = arity**k, _parents(arity)
    powers = F.array(*[F.lit(arity**i).cast("bigint") for i in range(k)])
    rounds: list[DataFrame] = []
    while True:
        arrays = nodes.groupBy("grp", F.expr(f"pos div {width}").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", "held"))).alias("slots"), F.first("total").alias("total")
        )
        # Levels: all of the array's where the group goes on, else until one node is left.
        depth = F.size(F.filter(powers, lambda p: p < F.col("total")))
        steps = F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), depth)
        levels = F.aggregate(
            steps,
            F.array(F.col("slots.digest")),
            lambda made, _: F.concat(made, F.array(up(F.element_at(made, -1)))),
        )
        rounds.append(settle(arrays.withColumn("levels", levels), "slots"))
        # One number: whether any group has more than one array.
        if rounds[-1].where(F.col("total") > width).isEmpty():
            return rounds
        nodes = rounds[-1].where(F.col("total") > width).select(
            "grp",
            F.col("block").alias("pos"),
            F.expr(f"(total + {width - 1}) div {width}").alias("total"),
            _top().alias("digest"),
            F.lit(None).cast("int").alias("held"),
        )


def _top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def tops(rounds: list[DataFrame], arity: int) -> DataFrame:
    """``grp, digest``: the last node of each group."""
    width = arity ** _steps(arity)
    out = None
    for level in rounds:
        done = level.where(F.col("total") <= width).select("grp", _top().alias("digest"))
        out = done if out is None else out.unionByName(done)
    return out


def descend(rounds: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """``digest, held, path`` of every lowest node, with the columns of ``above``.

    ``above`` has ``grp``, the ``path`` over the group's last node and what else its rows carry.
    A path lists, level by level, what stands before and after the node in its run.
    """
    k = _steps(arity)
    width = arity**k
    powers = F.array(*[F.lit(arity**i) for i in range(k)])
    carried = [c for c in above.columns if c not in ("grp", "path")]

    def siblings(slot: Column):
        def at(level: Column, height: Column) -> Column:
            j = F.floor(slot / F.element_at(powers, height + 1)).cast("int")
            first = j - j % arity
            before = F.array_join(F.slice(level, first + 1, j - first), "")
            after = F.array_join(F.slice(level, j + 2, first + (arity - 1) - j), "")
            return F.struct(before.alias("before"), after.alias("after"))

        return at

    def child(node: Column, slot: Column) -> Column:
        lower = F.slice(F.col("levels"), F.lit(1), F.size("levels") - 1)
        path = F.concat(F.transform(lower, siblings(slot)), F.col("path"))
        return F.struct(node["pos"].alias("pos"), node["digest"].alias("digest"), node["held"].alias("held"), path.alias("path"))

    below = None
    for level in reversed(rounds):
        known = level.where(F.col("total") <= width).join(above, "grp")
        if below is not None:
            paths = below.select("grp", F.col("pos").alias("block"), "path", *carried)
            rest = level.where(F.col("total") > width).join(paths, ["grp", "block"])
            known = known.unionByName(rest)
        below = known.select("grp", *carried, F.inline(F.transform("slots", child)))
    return below


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, presented: Column | None = None, arity: int = 2) -> DataFrame:
    """``id, leaf, subroot, root, path, folded``: one row per row.

    ``leaf`` is the digest of a row; runs of ``arity`` nodes become one. ``presented`` is another
    digest to be verified for a row, or null for its own; ``folded`` is the root that follows from it and the
    row's ``path``.
    """
    group = F.col(group_col)
    grp = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))
    other = F.lit(None).cast("string") if presented is None else presented
    leaves = settle(
        rows.select(grp.alias("grp"), F.col(id_col).cast("bigint").alias("id"), leaf.alias("leaf"), other.alias("other")), "leaves"
    )
    trees = climb(places(leaves), arity)
    roots = settle(tops(trees, arity), "subroots")
    ordered = running_total(roots, ["grp"], F.lit(1), "pos").select(
        F.lit("").alias("grp"), "pos", F.lit(roots.count()).cast("bigint").alias("total"), "digest", F.col("grp").alias("held")
    )
    crown = climb(ordered, arity)
    empty = F.array().cast("array<struct<before:string,after:string>>")
    root = tops(crown, arity).select("grp", F.col("digest").alias("root"), empty.alias("path"))
    above = descend(crown, root, arity).select(F.col("held").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    below = descend(trees, settle(above, "crown"), arity)
    folded = F.aggregate(
        "path",
        F.coalesce("held.other", "digest"),
        lambda node, step: digest(F.concat(step["before"], node, step["after"])),
    )
    return below.select(F.col("held.id").alias("id"), F.col("digest").alias("leaf"), "subroot", "root", "path", folded.alias("folded"))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))
