"""Plain-loop statements of the per-player rules, one history at a time."""

from __future__ import annotations

from collections import Counter, defaultdict

from .conftest import by_player


def sessions(rows, limit):
    out = []
    for player, history in by_player(rows).items():
        current = None
        for row in history:
            if current is None or row["ts"] - current[3] > limit:
                current = [player, 0 if current is None else current[1] + 1, row["ts"], row["ts"], 0]
                out.append(current)
            current[3] = row["ts"]
            current[4] += 1
    return sorted(tuple(s) for s in out)


def block_rows(rows, gap, interval):
    """(row, block, is_cut) per player, and the number of cuts."""
    out = {}
    for player, history in by_player(rows).items():
        counted, block, previous, placed = 0, 0, None, []
        for row in history:
            cut = False
            if previous is not None:
                step = row["ts"] - previous
                if step <= gap:
                    if counted >= interval:
                        block, counted, cut = block + 1, 0, True
                    else:
                        counted += step
            previous = row["ts"]
            placed.append((row, block, cut))
        out[player] = (placed, block)
    return out


def full_blocks(rows, gap, interval):
    for player, (placed, cuts) in block_rows(rows, gap, interval).items():
        groups = defaultdict(list)
        for item in placed:
            groups[item[1]].append(item)
        for block in range(cuts):
            yield player, block, groups[block]


def episode(history, enter, leave, window, limit):
    start = next((i for i, r in enumerate(history) if r["action"] == enter), None)
    if start is None:
        return ("none", None, None, None)
    t0 = history[start]["ts"]
    for i in range(start + 1, len(history)):
        row, k, el = history[i], i - start, history[i]["ts"] - t0
        if row["action"] == leave:
            kind = "exit"
        elif limit is not None and el > limit:
            kind = "timeout"
        elif window is not None and k >= window and (limit is None or el < limit):
            kind = "window"
        else:
            continue
        return (kind, t0, row["ts"], k - 1)
    return ("unfinished", t0, None, len(history) - 1 - start)


def stays(history, enter, leave, limit, window):
    ts, actions = [r["ts"] for r in history], [r["action"] for r in history]
    found, at = [], 0
    while enter in actions[at:]:
        start = actions.index(enter, at)
        ends = (j for j in range(start + 1, len(ts)) if actions[j] == leave or ts[j] - ts[j - 1] > limit or j - start == window)
        end = next(ends, None)
        if end is None:
            break
        if actions[end] != leave:
            found.append(ts[end - 1] - ts[start])
        elif ts[end] - ts[end - 1] <= limit:
            found.append(ts[end] - ts[start])
        at = end + 1
    return found


def payers(history, keyword, money, limit):
    origin = steps = None
    for row in history:
        if origin is not None and steps <= limit:
            steps += 1
            if row["key_index"] - origin >= money:
                return steps
        if keyword in row["action"]:
            origin, steps = row["key_index"], 0
    return None


def before_conversion(history, pay):
    counts, last = Counter(), history[0]["key_index"]
    for row in history:
        if row["action"] in pay:
            if row["key_index"] > last:
                break
            continue
        counts[row["action"]] += 1
        last = row["key_index"]
    return counts


def runs(history):
    out = []
    for i, row in enumerate(history):
        if out and out[-1][0] == row["action"]:
            out[-1][1].append(row["ts"])
        else:
            out.append([row["action"], [row["ts"]], history[i - 1]["action"] if i else None])
    return out
