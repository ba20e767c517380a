"""Exact top-k search by integer inner product over a bit-sliced index.

Vectors are quantised to integers. The index holds, for a block of rows and for each attribute (dimension),
the bits of the attribute as bitmaps over the rows: one bitmap per bit, a slice. For a query the
highest slices of all attributes, each shifted by the set bits of the query's weight, are added
by carry-save bitmap arithmetic into the slices of a partial score; negative weights take complements. What
the lower slices could still add is bounded by the weights, so the rows whose partial score is that
close to the k-th highest hold all answers. The k-th highest is read off from the most
significant slice downward, and so are the rows at or above the bound: the boundary rows, whose scores are
then resolved exactly.

Equal vectors are one entry of the index with their smallest ids, as many as can be in an answer, and
equal queries are one query. Blocks of queries meet blocks of entries; each such pair returns its own
best rows, and the best of those are the answer. All entries are indexed and every answer is exact.

Rows whose vector is null, empty, or holds a null or non-finite component take no part, nor do rows without id. A
component is cut to +-2^28 after scaling. A shorter vector counts as filled up with zeros. Rows that
repeat id and vector count as one row; a row is no answer to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

#: Entries of an index block, and queries that meet it in one task.
BLOCK, QUERIES = 32_768, 256

#: Slices of an attribute that are added, from the highest.
ADDED = 6

#: Largest component after scaling.
LIMIT = 1 << 28


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the row takes no part."""
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when((F.size(vector) > 0) & finite, whole)


class SlicedBlock:
    """The slices of some integer rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.low = rows, rows.min(axis=0)
        shifted = (rows - self.low).astype(np.int64)
        self.bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)])
        count = len(rows)
        self.words = -(-count // 64)
        padded = np.zeros((self.words * 64, rows.shape[1]), np.int64)
        padded[:count] = shifted
        most = max(int(self.bits.max()), 1)
        self.slices = np.empty((rows.shape[1], most, self.words), np.uint64)
        for b in range(most):
            plane = np.packbits((padded >> b & 1).astype(np.uint8), axis=0, bitorder="little")
            self.slices[:, b] = np.ascontiguousarray(plane.T).view(np.uint64)
        full = np.zeros(self.words * 64, np.uint8)
        full[:count] = 1
        self.every = np.packbits(full, bitorder="little").view(np.uint64)

    def partial(self, weights: np.ndarray, added: int) -> tuple[list[np.ndarray], int, int]:
        """Slices of the partial score, its shift, and how much the true score can exceed it.

        With constants left out: true = partial * 2^shift + rest, 0 <= rest <= slack.
        """
        used = [d for d in range(len(weights)) if weights[d] and self.bits[d]]
        if not used:
            return [], 0, 0
        shift = max(0, max(int(self.bits[d]) for d in used) - added)
        columns: dict[int, list[tuple[int, int]]] = {}
        slack = 0
        for d in used:
            size, bits = abs(int(weights[d])), int(self.bits[d])
            slack += size * ((1 << min(shift, bits)) - 1)
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for b in range(shift, bits):
                        columns.setdefault(b - shift + j, []).append((d, b))
        turned = np.where(weights < 0, ~np.uint64(0), np.uint64(0))
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        while columns or carried:
            stack, carried = carried, []
            if here := columns.pop(len(out), None):
                d, b = np.array(here).T
                pieces = self.slices[d, b]
                pieces ^= turned[d][:, None]
                stack.append(pieces)
            column = np.concatenate(stack) if stack else self.every[:0].reshape(0, self.words)
            # Three bitmaps of one weight become one of it and one of the next.
            while len(column) > 2:
                m = len(column) // 3
                a, b, c, rest = column[:m], column[m : 2 * m], column[2 * m : 3 * m], column[3 * m :]
                half = a ^ b
                both = a & b
                both |= half & c
                half ^= c
                carried.append(both)
                column = np.concatenate([half, rest]) if len(rest) else half
            if len(column) == 2:
                carried.append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
        return out, shift, slack

    def boundary(self, slices: list[np.ndarray], reach: int, k: int) -> np.ndarray:
        """Rows whose sliced number is within ``reach`` of the k-th highest, or above."""
        sure, tied, kth = np.zeros(self.words, np.uint64), self.every, 0
        for b in range(len(slices) - 1, -1, -1):
            ones = tied & slices[b]
            both = sure | ones
            if int(np.bitwise_count(both).sum()) >= k:
                tied, kth = ones, kth | 1 << b
            else:
                sure, tied = both, tied & ~slices[b]
        least = max(0, kth - reach)
        above, tied = np.zeros(self.words, np.uint64), self.every
        for b in range(len(slices) - 1, -1, -1):
            if least >> b & 1:
                tied = tied & slices[b]
            else:
                above |= tied & slices[b]
                tied = tied & ~slices[b]
        return np.flatnonzero(np.unpackbits((above | tied).view(np.uint8), bitorder="little"))

    def best(self, query: np.ndarray, k: int, added: int = ADDED) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) among which all of the k highest scores are, with all ties of the last."""
        if len(self.rows) <= k:
            rows = np.arange(len(self.rows))
        else:
            slices, shift, slack = self.partial(query, added)
            rows = self.boundary(slices, -(-slack >> shift), k)
        scores = self.rows[rows] @ query
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        return rows, scores


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _searcher(k: int, added: int):
    def search(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["qid", "score", "id", "own"]
        if entries.empty or queries.empty:
            return pd.DataFrame([], columns=columns)
        width = max(entries["vec"].str.len().max(), queries["vec"].str.len().max())
        rows, asked = _padded(entries["vec"], width), _padded(queries["vec"], width)
        block, ids = SlicedBlock(rows), entries["ids"].to_numpy()
        first = np.array([x[0] for x in ids])
        out = []
        for qid, query in zip(queries["qid"].tolist(), asked, strict=True):
            found, scores = block.best(query, k, added)
            order = np.lexsort((first[found], -scores))[:k]
            best = sorted(
                (-int(scores[j]), int(i), bool((rows[found[j]] == query).all())) for j in order.tolist() for i in ids[found[j]]
            )
            out += [(qid, -score, i, own) for score, i, own in best[:k]]
        return pd.DataFrame(out, columns=columns)

    return search


def top_k(rows: DataFrame, id_col: str, vector_col: str, asks: Column, k: int, scale: int, added: int = ADDED) -> DataFrame:
    """``query_id, rank, id, score``: for each row where ``asks`` holds the ``k`` rows of the highest inner
    product with it, ties to the smaller id."""
    kept = (
        rows.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("vec"), asks.alias("asks"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
        .groupBy("id", "vec")
        .agg(F.bool_or(F.coalesce("asks", F.lit(False))).alias("asks"))
    )
    kept = settle(kept, "vectors")
    # An answer needs the smallest ids of a vector only: k and the query's own.
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = kept.select("id", "vec").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = settle(entries.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    queries = settle(
        kept.where("asks").select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries"
    )
    blocks, parts = max(1, -(-entries.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))
    block, part = F.pmod(F.xxhash64("vec"), F.lit(blocks)), F.pmod(F.xxhash64("qid"), F.lit(parts))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    found = (
        entries.select("vec", "ids", block.alias("block"), every(parts).alias("part"))
        .groupBy("block", "part")
        .cogroup(queries.select("vec", "qid", every(blocks).alias("block"), part.alias("part")).groupBy("block", "part"))
        .applyInPandas(_searcher(k + 1, added), "qid bigint, score bigint, id bigint, own boolean")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "own")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    answers = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score", "own"))).alias("answers"))
    asked = kept.where("asks").select(F.col("id").alias("query_id"), "vec").join(queries, "vec").join(answers, "qid")
    others = F.slice(F.filter("answers", lambda a: ~(a["own"] & (a["id"] == F.col("query_id")))), 1, k)
    return asked.select("query_id", F.posexplode(others)).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("id"), F.col("col.score").alias("score")
    )
