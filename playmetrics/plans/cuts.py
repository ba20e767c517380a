"""Chains of cuts on a running clock.

A clock advances by the gaps that are near enough. A cut falls on the first near row at which the
clock, read before that row, is ``interval`` or more past the last cut; the clock goes on from the cut
row. Only the chain of cuts is sequential, and each of its steps is one search in a sorted column.
"""

from __future__ import annotations

import numpy as np

from .stretches import Relay, Rows, State


def chain_of_cuts(ts: np.ndarray, last: int, carried: int, gap: int, interval: int) -> tuple[np.ndarray, int]:
    """The rows that open a block, and the clock since the last cut after all rows.

    ``ts`` is in order; ``last`` is the time of the row before, ``carried`` the clock at it.
    """
    steps = np.diff(ts, prepend=last)
    near = steps <= gap
    after = carried + np.cumsum(np.where(near, steps, 0))
    rows = np.flatnonzero(near)
    before = after[rows] - steps[rows]
    cuts, zero = [], 0
    while (at := int(np.searchsorted(before, zero + interval))) < len(rows):
        cuts.append(rows[at])
        zero = int(after[rows[at]])
    return np.array(cuts, np.int64), (int(after[-1]) if len(ts) else carried) - zero


def _twice(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Times and ``head`` flags: a second counts once for its first row and once for all later ones."""
    twice = np.minimum(rows["rows"], 2)
    ts = np.repeat(rows["ts"], twice)
    head = np.ones(len(ts), bool)
    head[(np.cumsum(twice) - 1)[twice == 2]] = False
    return ts, head


def clock_relay(gap: int, interval: int) -> Relay:
    """Blocks of the running clock over seconds ``ts, rows``: makes ``ts, head, block, cut``.

    The state is the last second, the clock since the last cut and the number of cuts.  The clock that a
    stretch inherits is below ``interval + gap``, so its first cut is one of the rows within the first
    ``interval`` seconds of its own clock: the table has one column for each of these.
    """

    def walk(rows: Rows, state: State) -> tuple[Rows, State]:
        ts, head = _twice(rows)
        last, clock, block = state or (int(ts[0]), 0, 0)
        places, clock = chain_of_cuts(ts, last, clock, gap, interval)
        cut = np.zeros(len(ts), bool)
        cut[places] = True
        made = {"ts": ts, "head": head, "block": (block + np.cumsum(cut)).astype(np.int32), "cut": cut}
        return made, (int(ts[-1]), int(clock), block + len(places))

    def table(rows: Rows) -> np.ndarray:
        ts, _ = _twice(rows)
        steps = np.diff(ts)
        near = steps <= gap
        after = np.cumsum(np.where(near, steps, 0))
        total = int(after[-1]) if len(after) else 0
        after = after[near]
        before = after - steps[near]
        first = np.unique(np.searchsorted(before, np.arange(interval + 1)))
        first = first[first < len(before)]
        # All chains take their next cut at once, until none has one left.
        at, cuts = first.copy(), np.ones(len(first), np.int64)
        alive = np.arange(len(first))
        while len(alive):
            then = np.searchsorted(before, after[at[alive]] + interval)
            alive, then = alive[then < len(before)], then[then < len(before)]
            at[alive] = then
            cuts[alive] += 1
        ends = np.array([[int(ts[0])], [int(ts[-1])], [total]])
        return np.hstack([ends, np.array([before[first], cuts, total - after[at]], np.int64).reshape(3, -1)])

    def step(table: np.ndarray, state: State) -> State:
        (begin, last, total), (before, cuts, left) = table[:, 0].tolist(), table[:, 1:]
        clock, block = 0, 0
        if state:
            prior, clock, block = state
            if begin - prior <= gap:
                clock, block = (0, block + 1) if clock >= interval else (clock + begin - prior, block)
        at = int(np.searchsorted(before, max(0, interval - clock)))
        if at == len(before):
            return last, clock + total, block
        return last, int(left[at]), block + int(cuts[at])

    return Relay(walk, table, step)


def stay_relay(limit: int, window: int) -> Relay:
    """Stays that begin at a row that ``enters`` and end at an exit, after ``window`` rows or behind a gap.

    Makes ``enter_ts, stay``.  Where a stay ends depends on its enter row alone: it is the nearest of the next exit,
    the next row behind a gap, and the row ``window`` later.  So each enter row has one successor, the first
    enter row behind its end, and the stays are the rows on the chain of successors.  The state is the
    last second, and of an open stay its first second and the rows since (else -1).
    An open stay ends within the first ``window`` rows of a stretch if it ends there at all: the
    table has a column for each, and one for no open stay.
    """

    def ends(rows: Rows, prior: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Time of the row before each row, gap flags, enter rows, and where their stays end."""
        ts = rows["ts"]
        prev = np.concatenate([[prior], ts[:-1]])
        behind = ts - prev > limit
        stops = np.append(np.flatnonzero(rows["exits"] | behind), len(ts) + window)
        enter = np.flatnonzero(rows["enters"])
        return prev, behind, enter, np.minimum(stops[np.searchsorted(stops, enter, "right")], enter + window)

    def first_end(exits: np.ndarray, behind: np.ndarray, since: int) -> int:
        stops = np.flatnonzero(exits | behind)
        return min([window - since - 1, *stops[:1].tolist()])

    def walk(rows: Rows, state: State) -> tuple[Rows, State]:
        ts = rows["ts"]
        prior, opened, since = state or (int(ts[0]), 0, -1)
        prev, behind, enter, end = ends(rows, prior)
        begin, close, at = [], [], 0
        if since >= 0:
            stop = first_end(rows["exits"][:window], behind[:window], since)
            if stop >= len(ts):
                return {"enter_ts": ts[:0], "stay": ts[:0]}, (int(ts[-1]), opened, since + len(ts))
            begin.append(opened)
            close.append(stop)
            at = int(np.searchsorted(enter, stop, "right"))
        after = np.searchsorted(enter, end, "right").tolist()
        on = []
        while at < len(enter):
            on.append(at)
            at = after[at]
        on = np.array(on, np.int64)
        begin = np.concatenate([np.array(begin, np.int64), ts[enter[on]]])
        close = np.concatenate([np.array(close, np.int64), end[on]])
        open_ = close >= len(ts)
        left = (int(begin[-1]), len(ts) - 1 - int(enter[on[-1]])) if len(on) and open_[-1] else (0, -1)
        begin, close = begin[~open_], close[~open_]
        exits = rows["exits"][close]
        whole = ~(exits & behind[close])
        stay = np.where(exits, ts[close], prev[close]) - begin
        return {"enter_ts": begin[whole], "stay": stay[whole]}, (int(ts[-1]), *left)

    def table(rows: Rows) -> np.ndarray:
        ts, n = rows["ts"], len(rows["ts"])
        _, behind, enter, end = ends(rows, int(ts[0]))
        after = np.append(np.searchsorted(enter, end, "right"), len(enter))
        # The last enter row on the chain: successors of successors, twice as far each time.
        final = np.append(np.where(after[:-1] < len(enter), after[:-1], np.arange(len(enter))), len(enter))
        for _ in range(max(1, len(enter)).bit_length()):
            final = final[final]
        begins = final[np.searchsorted(enter, np.arange(-1, window), "right")]
        enter, end = np.append(enter, n - 1), np.append(end, 0)
        open_ = end[begins] >= n
        columns = [np.where(open_, ts[enter[begins]], 0), np.where(open_, n - 1 - enter[begins], -1)]
        # Stops within the window, apart from a gap in front of the first row.
        stops = np.flatnonzero(rows["exits"][:window] | behind[:window])
        head = np.array([[ts[0], n], [ts[-1], stops[0] if len(stops) else window]])
        return np.hstack([head, np.array(columns, np.int64)])

    def step(table: np.ndarray, state: State) -> State:
        begin, n, last, stop = table[:, :2].ravel().tolist()
        prior, opened, since = state or (begin, 0, -1)
        at = -1
        if since >= 0:
            at = min(0 if begin - prior > limit else stop, window - since - 1)
            if at >= n:
                return last, opened, since + n
        return last, int(table[0, at + 3]), int(table[1, at + 3])

    return Relay(walk, table, step)
