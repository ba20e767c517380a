"""Periodic runs of words: stretches that repeat themselves four times and more.

A suffix automaton takes the words of a stretch one by one. Its suffix links form a tree whose path
from the root to the newest prefix holds all strings that end there; a link-cut tree keeps for every
node the last word at which its strings ended, as one colour per path segment. Appending word ``i``
recolours the path to the new prefix. A segment of old colour ``e`` whose longest string has ``n`` words
says that these ``n`` words end at ``e`` and again at ``i``; where ``i - e <= n`` the two overlap or
touch, so a square of period ``i - e`` ends at ``i``. Every square whose root is primitive shows up this
way, as its root cannot end nearer to ``i``. A new square is extended to both sides to its run.

A run of period ``q`` has ``4q`` words at least, so each three words in it occur three times and
each five words twice. Stretches where this cannot hold, by counts of hashed windows over the
whole text, are left out before; a hash collision only leaves more words in.

Nulls and empty texts have no words and no runs. Texts of any length are read whole, with memory in
proportion to their words. Rows are independent: ties, repeated rows and further columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Bytes of text that are taken together when windows are counted.
BLOCK_BYTES = 4 << 20

SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"

#: What a row without text has.
EMPTY = (0, None, None, None, [], b"")


class PathColours:
    """A link-cut forest of growing paths; each preferred path has one colour."""

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = [-1], [-1], [-1], [-1]

    def leaf(self, parent: int) -> int:
        """A new node below ``parent``, a path of its own until it is recoloured."""
        node = len(self.up)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(parent)
        self.colour.append(-1)
        return node

    def above(self, node: int) -> int:
        """A new node between ``node`` and its parent, on the path and with the colour of ``node``."""
        self.splay(node)
        new = len(self.up)
        head = self.left[node]
        self.left.append(head)
        self.right.append(-1)
        self.up.append(node)
        self.colour.append(-1)
        if head >= 0:
            self.up[head] = new
        self.left[node] = new
        return new

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its path's search tree, which holds the colour."""
        left, right, up = self.left, self.right, self.up
        top, p = x, up[x]
        while p >= 0 and (left[p] == top or right[p] == top):
            top, p = p, up[p]
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while up[x] != p:
            a = up[x]
            b = up[a]
            if b != p:
                straight = (left[a] == x) == (left[b] == a)
                self._turn(a if straight else x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        a = up[x]
        b = up[a]
        if left[a] == x:
            inner = left[a] = right[x]
            right[x] = a
        else:
            inner = right[a] = left[x]
            left[x] = a
        if inner >= 0:
            up[inner] = a
        up[a], up[x] = x, b
        if b >= 0:
            if left[b] == a:
                left[b] = x
            elif right[b] == a:
                right[b] = x

    def recolour(self, leaf: int, colour: int) -> Iterator[tuple[int, int]]:
        """Give the path from the root to a new leaf one colour; yields (lowest node, old colour) of
        each segment passed."""
        below, node = leaf, self.up[leaf]
        while node >= 0:
            self.splay(node)
            old, rest = self.colour[node], self.right[node]
            if rest >= 0:
                self.colour[rest] = old
            self.right[node] = below
            yield node, old
            below, node = node, self.up[node]
        self.colour[below] = colour


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of squares with primitive roots: at least those with which a run begins."""
    paths = PathColours()
    longest, link = [0], [-1]
    # One outgoing edge is kept in place, as most states have one; further ones in ``more``.
    word_of, to, more = [-1], [-1], {}

    def follow(state: int, word: int) -> int:
        if word_of[state] == word:
            return to[state]
        rest = more.get(state)
        return rest.get(word, -1) if rest else -1

    def point(state: int, word: int, target: int) -> None:
        if word_of[state] == word or word_of[state] < 0:
            word_of[state], to[state] = word, target
        else:
            more.setdefault(state, {})[word] = target

    last = 0
    for i, word in enumerate(words):
        length, at = longest[last] + 1, last
        new = len(longest)
        longest.append(length)
        link.append(0)
        word_of.append(-1)
        to.append(-1)
        while at >= 0 and (old := follow(at, word)) < 0:
            point(at, word, new)
            at = link[at]
        if at < 0:
            parent = 0
        elif longest[old] == longest[at] + 1:
            parent = old
        else:
            parent = new + 1
        paths.leaf(parent)
        link[new] = parent
        if parent == new + 1:
            paths.above(old)
            longest.append(longest[at] + 1)
            link.append(link[old])
            word_of.append(word_of[old])
            to.append(to[old])
            if old in more:
                more[parent] = dict(more[old])
            link[old] = parent
            while at >= 0 and follow(at, word) == old:
                point(at, word, parent)
                at = link[at]
        for node, ended in paths.recolour(new, i):
            if 0 < i - ended <= longest[node]:
                yield i, i - ended
        last = new


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs that are long enough, by start, then period."""
    found, reach, n = [], {}, len(words)
    for i, period in squares(words):
        if i < reach.get(period, 0):
            continue
        stop, start = i + 1, i - period
        while stop < n and words[stop] == words[stop - period]:
            stop += 1
        while start >= 0 and words[start] == words[start + period]:
            start -= 1
        reach[period] = stop
        length = stop - start - 1
        if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
            found.append((start + 1, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _often(ids: np.ndarray, owner: np.ndarray, size: int, least: int) -> np.ndarray:
    """Whether the window of ``size`` words at a place occurs ``least`` times in its text, or seems to."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(len(ids), bool)
    code = owner[:n].astype(np.uint64)
    for k in range(size):
        code = (code ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    bits = max(10, int(4 * n).bit_length())
    slot = (code >> np.uint64(64 - bits)).astype(np.int64)
    enough = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
    enough &= owner[:n] == owner[size - 1 :]
    return np.concatenate([enough, np.zeros(size - 1, bool)])


def stretches(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of all stretches that may hold runs, in the words of several texts."""
    three = _often(ids, owner, 3, 3)
    open_ = _often(ids, owner, 5, 2)
    for k in range(3):
        open_[: len(open_) - k] &= three[k:]
    edges = np.flatnonzero(np.diff(open_.astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2] + 4
    long = stops - starts >= LEAST_WORDS
    return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))


def _result(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    if not found:
        return 0, None, None, None, [], b" ".join(words)
    best = min(found, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]))
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    rows = [{"start": s, "length": n, "period": q} for s, n, q in found]
    return len(found), *best, rows, b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def _block(texts: list[list[bytes]], place: list[np.ndarray | None]) -> Iterator[tuple]:
    number = defaultdict(count().__next__)
    lists = []
    for k, words in enumerate(texts):
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if place[k] is not None:
            ids = ids[place[k]]
            texts[k] = [words[j] for j in place[k].tolist()]
        lists.append(ids)
    sizes = [len(x) for x in lists]
    ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    found: dict[int, list] = defaultdict(list)
    for start, stop in stretches(ids, owner):
        k = int(owner[start])
        shift = start - int(begin[k])
        found[k] += [(s + shift, n, q) for s, n, q in runs_of(ids[start:stop].tolist())]
    for k, words in enumerate(texts):
        yield _result(words, found.get(k, []))


def _finder(columns: list[str], plant: Callable[[int, int], tuple[int, int] | None] | None):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["_text"].str.len().fillna(0).to_numpy(np.int64)
            part = np.cumsum(size) // BLOCK_BYTES
            for _, rows in batch.groupby(part, sort=False):
                texts = [(t or b"").split() for t in rows["_text"].tolist()]
                place = [None] * len(texts)
                if plant is not None:
                    for k, seed in enumerate(rows["_seed"].tolist()):
                        if texts[k] and not pd.isna(seed) and (loop := plant(int(seed), len(texts[k]))):
                            first, turn = loop
                            at = np.arange(len(texts[k]))
                            place[k] = np.where(at < first, at, first + (at - first) % turn)
                found = list(_block(texts, place))
                made = pd.DataFrame(found, columns=["n_runs", "start", "length", "period", "runs", "collapsed"])
                made = made.astype({c: "Int64" for c in ("n_runs", "start", "length", "period")})
                yield pd.concat([rows[columns].reset_index(drop=True), made], axis=1)

    return find


def find_runs(
    docs: DataFrame,
    carry: list[str],
    text_col: str = "text",
    seed: Column | None = None,
    plant: Callable[[int, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """``carry`` columns, number of runs, the best one, all ``runs`` and the text ``collapsed`` to the first
    period of each run, its words joined by one space.

    The best run has the most periods; of equal ones the first, then the one of the smallest period.
    ``plant(seed, words)`` may give (first, turn): words from ``first`` on are then read as a loop of
    ``turn`` words. A null seed plants nothing. Carried columns keep their names; they must not be named
    like a result.
    """
    shown = [F.col(f"`{c}`") for c in carry]
    given = docs.select(
        *shown, F.col(text_col).cast("binary").alias("_text"), (F.lit(None).cast("bigint") if seed is None else seed).alias("_seed")
    )
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), SCHEMA])
    return given.mapInPandas(_finder(list(carry), plant), schema)


def listed(runs: Column) -> Column:
    """``start,length,period`` of every run, each with a line end."""
    lines = F.transform(
        runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    )
    return F.array_join(lines, "")
