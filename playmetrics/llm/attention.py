"""A small causal self-attention model over symbols, in numpy.

A position looks back over its own block of symbols and the block before it: windows of two blocks
overlap by one, and each symbol is scored once, in the window that gives it the longer past. The next
symbol is predicted from the current one and the attended past, first its class, then the symbol
within the class, so that a probability costs two short softmaxes instead of one over all symbols.
Symbols come by falling count, and classes of frequent ones are small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 16
#: Symbols of each class, and where the classes begin and end.
MEMBERS = np.repeat([16, 32, 64, 128], [16, 16, 16, 18])
EDGES = np.concatenate(([0], np.cumsum(MEMBERS)))
CLASSES, SYMBOLS = len(MEMBERS), int(EDGES[-1])
CLASS_OF = np.repeat(np.arange(CLASSES), MEMBERS)
START = SYMBOLS
WIDTH = 16

#: The last row of ``class_out`` and the last column of ``member_out`` are biases.
SHAPES = {
    "embed": (SYMBOLS + 1, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "offset": (2 * BLOCK,),
    "own": (WIDTH, WIDTH),
    "past": (WIDTH, WIDTH),
    "shift": (WIDTH,),
    "class_out": (WIDTH + 1, CLASSES),
    "member_out": (SYMBOLS, WIDTH + 1),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

_back = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
#: For each query of a block and key of the window: how far back the key lies (0: itself).
DISTANCE = np.clip(_back, 0, 2 * BLOCK - 1)
FUTURE = _back < 0


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fresh(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Starting weights: small random ones, and biases that give the symbols' overall shares."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    weights = unpack(flat)
    for name in ("query", "key", "value", "own", "past"):
        weights[name][:] = rng.normal(0, WIDTH**-0.5, weights[name].shape)
    weights["embed"][:] = rng.normal(0, 1.0, weights["embed"].shape)
    weights["class_out"][:WIDTH] = rng.normal(0, 0.1, (WIDTH, CLASSES))
    weights["member_out"][:, :WIDTH] = rng.normal(0, 0.1, (SYMBOLS, WIDTH))
    weights["offset"][:] = -0.2 * np.arange(2 * BLOCK)
    share = counts + 0.1
    of_class = np.add.reduceat(share, EDGES[:-1])
    weights["class_out"][WIDTH] = np.log(of_class / of_class.sum())
    weights["member_out"][:, WIDTH] = np.log(share / of_class[CLASS_OF])
    return flat


@dataclass
class Windows:
    """Documents laid out in blocks: what is seen, what is to be predicted, and where it belongs."""

    seen: np.ndarray  # (blocks, 2 * BLOCK) symbols
    known: np.ndarray  # (blocks, 2 * BLOCK) whether a key is there
    wanted: np.ndarray  # (blocks, BLOCK) symbols
    real: np.ndarray  # (blocks, BLOCK)
    owner: np.ndarray  # (blocks,) document


def windows(flat: np.ndarray, sizes: np.ndarray) -> Windows:
    """Lay out documents, given one behind the other with their sizes, each with its end symbol."""
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    slot = np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    wanted = np.zeros(total * BLOCK, np.int32)
    real = np.zeros(total * BLOCK, bool)
    wanted[slot], real[slot] = flat, True
    now = np.empty(total * BLOCK, np.int32)
    now[1:] = wanted[:-1]
    now[first * BLOCK] = START
    now = now.reshape(total, BLOCK)
    real = real.reshape(total, BLOCK)
    before = np.concatenate((np.zeros((1, BLOCK), np.int32), now[:-1])) if total else now
    has_before = np.ones(total, bool)
    has_before[first] = False
    known = np.concatenate((np.repeat(has_before[:, None], BLOCK, axis=1), real), axis=1)
    return Windows(np.concatenate((before, now), axis=1), known, wanted.reshape(total, BLOCK), real, owner)


#: Sums of exponentials are kept off zero by this much.
TINY = np.float32(1e-30)
ONE = np.float32(1)
SCALE = np.float32(WIDTH**-0.5)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials in place, all over one factor: rows lie close enough together for one number to be taken off."""
    x -= x.max() - np.float32(40)
    return np.exp(x, out=x)


def _attend(q, k, offset, known):
    """Attention weights, not yet divided by their sums."""
    scores = q @ k.transpose(0, 2, 1)
    scores += np.where(FUTURE, np.float32(-1e9), offset[DISTANCE])
    part = np.flatnonzero(~known.all(axis=1))
    scores[part] += np.where(known[part], np.float32(0), np.float32(-1e9))[:, None, :]
    return _exp(scores)


def _tables(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections of every symbol: query, key, value. A column of ones beside the values adds up the weights."""
    value = np.ones((SYMBOLS + 1, WIDTH + 1), np.float32)
    value[:, :WIDTH] = w["embed"] @ w["value"]
    return w["embed"] @ (w["query"] * SCALE), w["embed"] @ w["key"], value


def _by_wanted(part: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The real positions in the order of the symbols wanted there, and these symbols."""
    rows = np.flatnonzero(part.real.ravel())
    wanted = part.wanted.ravel()[rows]
    order = np.argsort(wanted.astype(np.int16), kind="stable")
    return rows[order], wanted[order]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


class Scorer:
    """Scores windows with fixed weights; projections of single symbols are tables."""

    def __init__(self, flat: np.ndarray) -> None:
        w = unpack(flat.astype(np.float32))
        self.w = w
        self.query, self.key, self.value = _tables(w)
        self.own = w["embed"] @ w["own"] + w["shift"]

    def log_probabilities(self, part: Windows) -> np.ndarray:
        """Natural log probability of each wanted symbol, 0 where there is none."""
        w, now = self.w, part.seen[:, BLOCK:]
        out = np.zeros(part.real.size, np.float32)
        rows, told = _by_wanted(part)
        if not len(rows):
            return out.reshape(part.real.shape)
        weights = _attend(self.query.take(now, axis=0), self.key.take(part.seen, axis=0), w["offset"], part.known)
        past = _flat(weights @ self.value.take(part.seen, axis=0))[rows]
        past = past[:, :WIDTH] / (past[:, WIDTH:] + TINY)
        state = np.ones((len(rows), WIDTH + 1), np.float32)
        np.tanh(self.own.take(now.ravel()[rows], axis=0) + past @ w["past"], out=state[:, :WIDTH])
        shares = _exp(state @ w["class_out"])
        found = np.log(shares[np.arange(len(told)), CLASS_OF[told]] + TINY) - np.log(shares @ np.ones(CLASSES, np.float32) + TINY)
        stops = np.searchsorted(told, EDGES)
        for c in np.flatnonzero(np.diff(stops)).tolist():
            here = slice(stops[c], stops[c + 1])
            shares = _exp(state[here] @ w["member_out"][EDGES[c] : EDGES[c + 1]].T)
            found[here] += np.log(shares[np.arange(len(shares)), told[here] - EDGES[c]] + TINY)
            found[here] -= np.log(shares @ np.ones(shares.shape[1], np.float32) + TINY)
        out[rows] = found
        return out.reshape(part.real.shape)


class Trainer:
    """Adam steps on batches of windows."""

    def __init__(self, flat: np.ndarray, rate: float = 0.02) -> None:
        self.flat = flat.astype(np.float32).copy()
        self.mean, self.square, self.steps, self.rate = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, rate

    def step(self, part: Windows, lost: bool = True) -> float | None:
        """One step; the loss in natural log per symbol, if asked for."""
        w = unpack(self.flat)
        grad = np.zeros_like(self.flat)
        g = unpack(grad)
        seen, now = part.seen, np.ascontiguousarray(part.seen[:, BLOCK:])
        rows, told = _by_wanted(part)
        if not len(rows):
            return 0.0 if lost else None
        n = np.float32(len(rows))
        query, key, value = _tables(w)
        q, k, v = query.take(now, axis=0), key.take(seen, axis=0), value.take(seen, axis=0)
        a = _attend(q, k, w["offset"], part.known)
        past = a @ v
        sums = past[:, :, WIDTH:] + TINY
        past = past[:, :, :WIDTH] / sums
        # From here in the order of the wanted symbols: classes and symbols are stretches of rows.
        own, back = w["embed"].take(now.ravel()[rows], axis=0), _flat(past)[rows]
        state = np.ones((len(rows), WIDTH + 1), np.float32)
        np.tanh(own @ w["own"] + back @ w["past"] + w["shift"], out=state[:, :WIDTH])
        first = _runs(told)
        present = told[first]
        kinds = CLASS_OF[present]
        first_kinds = _runs(kinds)
        # What the wanted symbols pull, one row for each; then what all symbols push, by their shares.
        pull = np.add.reduceat(state, first, axis=0) / n
        g["member_out"][present] = -pull
        g["class_out"][:, kinds[first_kinds]] = -np.add.reduceat(pull, first_kinds, axis=0).T
        toward = (w["class_out"].T[kinds] + w["member_out"][present])[:, :WIDTH] / n
        times = np.diff(np.append(first, len(told)))
        shares = _exp(state @ w["class_out"])
        total = shares @ np.ones(CLASSES, np.float32) + TINY
        loss = np.log(total).sum() - np.log(shares[np.arange(len(told)), CLASS_OF[told]] + TINY).sum() if lost else 0.0
        worth = (ONE / (total * n))[:, None]
        g["class_out"] += (state * worth).T @ shares
        d = shares @ w["class_out"][:WIDTH].T
        d *= worth
        d -= np.repeat(toward, times, axis=0)
        stops = np.searchsorted(told, EDGES)
        for c in kinds[first_kinds].tolist():
            here, members = slice(stops[c], stops[c + 1]), slice(EDGES[c], EDGES[c + 1])
            mine, out = state[here], w["member_out"][members]
            shares = _exp(mine @ out.T)
            total = shares @ np.ones(len(out), np.float32) + TINY
            if lost:
                loss += np.log(total).sum() - np.log(shares[np.arange(len(mine)), told[here] - EDGES[c]] + TINY).sum()
            worth = (ONE / (total * n))[:, None]
            g["member_out"][members] += shares.T @ (mine * worth)
            d[here] += (shares @ out[:, :WIDTH]) * worth
        d *= ONE - state[:, :WIDTH] ** 2
        g["own"][:], g["past"][:], g["shift"][:] = own.T @ d, back.T @ d, np.ones(len(d), np.float32) @ d
        d_now = np.zeros((now.size, WIDTH), np.float32)
        d_now[rows] = d @ w["own"].T
        d_past = np.zeros((*now.shape, WIDTH + 1), np.float32)
        _flat(d_past)[rows, :WIDTH] = d @ w["past"].T
        d_past[:, :, :WIDTH] /= sums
        # The last column meets the ones beside the values: it takes off each row's mean.
        d_past[:, :, WIDTH] = -np.einsum("bij,bij->bi", d_past[:, :, :WIDTH], past)
        d_s = d_past @ v.transpose(0, 2, 1)
        d_s *= a
        g["offset"][:] = np.bincount(DISTANCE.ravel(), d_s.sum(axis=0).ravel(), 2 * BLOCK)
        d_kv = np.empty((*seen.shape, 2 * WIDTH), np.float32)
        np.matmul(d_s.transpose(0, 2, 1), q, out=d_kv[:, :, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), d_past[:, :, :WIDTH], out=d_kv[:, :, WIDTH:])
        d_q = _flat(d_s @ k)
        d_q *= SCALE
        e = w["embed"].take(seen, axis=0)
        g["query"][:] = e[:, BLOCK:].reshape(-1, WIDTH).T @ d_q
        both = _flat(e).T @ _flat(d_kv)
        g["key"][:], g["value"][:] = both[:, :WIDTH], both[:, WIDTH:]
        d_e = (_flat(d_kv) @ np.concatenate((w["key"], w["value"]), axis=1).T).reshape(e.shape)
        d_now += d_q @ w["query"].T
        d_e[:, BLOCK:] += d_now.reshape(*now.shape, WIDTH)
        order = np.argsort(seen.ravel().astype(np.int16), kind="stable")
        where = seen.ravel()[order]
        first = _runs(where)
        g["embed"][where[first]] = np.add.reduceat(_flat(d_e)[order], first, axis=0)
        self.steps += 1
        rise = self.rate * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        change = grad - self.mean
        change *= 0.1
        self.mean += change
        grad *= grad
        grad -= self.square
        grad *= 0.01
        self.square += grad
        np.sqrt(self.square, out=grad)
        grad += 1e-8
        np.multiply(self.mean, rise, out=change)
        change /= grad
        self.flat -= change
        return float(loss) / len(rows) if lost else None
