"""Language-model scores: a causal self-attention model, beside a unigram base.

Counts of words are taken over all training documents. They give the base score and the shares of the
model's symbols, which are of one of two kinds. Pieces: every word is encoded by a public tokenizer
(``Pieces.encode_all``; merging never crosses words, so a worker encodes each distinct word once); the most
frequent pieces are symbols, the others share one and are told apart by their own shares. Words: the most
frequent words are symbols of their own; the others share one with the words of the same beginning (the
longest of the chosen pieces of the tokenizer), and each has its own share there: its count, and as much
beside the counts as the symbol has distinct words, dealt out by the letters of a word (which letter
follows which, over the distinct words). No word is encoded then, and a text has fewer symbols. The
attention weights are trained in numpy: first on a bounded sample in one task, then in rounds over
disjoint shares that together are all training documents, where each task goes on from the common weights and the results are
averaged by symbols seen. Scoring lays every text out in overlapping windows (see ``attention``).

The counts must be met for every word of every text. The words with a hundred-thousandth of all tokens or
more are at most 100,000 and are broadcast; the others go, packed, to buckets by a hash of the word,
where they meet their counts, and come back as sums per document. No vocabulary is ever held whole.

Defined cases: a null text counts as empty and is one end token; a word unknown to training counts
0; without training documents the counts are 0 and N + 0.1 (V + 1) is 0.1; repeated rows get equal
scores; words are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from . import attention
from .common import Sent, columns_free, text_of
from .pieces import MARK, Pieces

SEED = 42  # of Spark's xxhash64
END_SYMBOL, OTHER_SYMBOL = attention.SYMBOLS - 2, attention.SYMBOLS - 1
#: Frequent words that are symbols, and the bytes up to which a word can be one; the other symbols are beginnings of words.
OWN_WORDS, OWN_LENGTH = attention.SYMBOLS * 3 // 4, 64
#: Words that reach this share of all tokens are broadcast; there are no more of them than one over it.
HEAVY_SHARE = 1e-5
BUCKET_WORDS = 200_000
LEAST_BUCKETS = 48
#: Documents that are scored together, and blocks of symbols in one pass of the model.
BATCH, PASS = 1_024, 1_024
COUNTED = 300_000
#: Distinct words that a worker keeps at hand.
MET_WORDS = 500_000


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n, hash`` over the texts; the empty word stands for the end of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        frame = lambda: pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) > COUNTED:
                    yield frame()
                    counts.clear()
        if counts:
            yield frame()

    counted = docs.select("text").mapInPandas(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("hash", F.xxhash64("word"))


def _beginnings(model: Pieces) -> dict[bytes, int]:
    """Pieces that begin a word, without the mark; the empty one begins all words."""
    return {n[len(MARK) :].encode(): i for i, n in enumerate(model.names) if n.startswith(MARK) and n[len(MARK) :].find(MARK) < 0}


class Longest:
    """The number of the longest beginning of a word, or -1."""

    def __init__(self, among: dict[bytes, int]) -> None:
        self.among, self.reach = among, {}
        for name in among:
            if len(name) > 1:
                self.reach[name[:2]] = max(len(name), self.reach.get(name[:2], 0))

    def __call__(self, word: bytes) -> int:
        get = self.among.get
        for size in range(min(len(word), self.reach.get(word[:2], 1)), 0, -1):
            if (found := get(word[:size])) is not None:
                return found
        return -1


def piece_ids(words: list[bytes], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of some words, one behind the other, and how many each word has: what they have in any text."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ids, starts, _ = model.encode_all([b" ".join(words).decode()])[0]
    # A word's first piece begins with the blank before it.
    first = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))[:-1] - 1
    return ids, np.bincount(np.searchsorted(first, starts, side="right"), minlength=len(words))


def count_pieces(words: DataFrame, shared) -> np.ndarray:
    """How often each piece occurs in all counted texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        total = np.zeros(len(model.names))
        for batch in batches:
            at = [i for i, w in enumerate(batch["word"]) if len(w)]
            ids, sizes = piece_ids([bytes(w) for w in batch["word"].iloc[at]], model)
            total += np.bincount(ids, np.repeat(batch["n"].to_numpy()[at], sizes), len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used].astype(np.int64)})

    counted = words.select("word", "n").mapInPandas(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(len(shared.value.names))
    for row in counted.collect():  # one row for each piece at most
        out[row["id"]] = row["n"]
    return out


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the words with the one before (a blank before and behind every word), and the place of each word's first."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return data[:-1] * 256 + data[1:], np.cumsum(sizes) - sizes


def count_beginnings(words: DataFrame, shared, own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece the tokens and the distinct words that it is the longest beginning of, without
    the ``own`` ones (last: words that no piece begins), and how often a byte follows another in distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest, count, known = Longest(_beginnings(shared.value)), len(shared.value.names), set(own)
        tokens, types, pairs = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            at = [i for i, w in enumerate(batch["word"]) if len(w) and w not in known]
            found = batch["word"].iloc[at].tolist()
            ids = np.fromiter(map(longest, found), np.int64, len(found)) % (count + 1)
            np.add.at(tokens, ids, batch["n"].to_numpy()[at])
            types += np.bincount(ids, minlength=count + 1)
            if found:
                pairs += np.bincount(_letters(found)[0], minlength=1 << 16)
        used, follow = np.flatnonzero(types), np.flatnonzero(pairs)
        yield pd.DataFrame({"id": used, "n": tokens[used], "types": types[used]})
        yield pd.DataFrame({"id": -1 - follow, "n": pairs[follow], "types": 0})

    counted = words.select("word", "n").mapInPandas(run, "id bigint, n bigint, types bigint")
    found = counted.groupBy("id").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toPandas()  # one row for each piece and pair of bytes at most
    pieces, follow = found[found["id"] >= 0], found[found["id"] < 0]
    tokens, types, pairs = np.zeros(len(shared.value.names) + 1), np.zeros(len(shared.value.names) + 1), np.zeros(1 << 16)
    tokens[pieces["id"]], types[pieces["id"]], pairs[-1 - follow["id"]] = pieces["n"], pieces["types"], follow["n"]
    return tokens, types, pairs


@dataclass
class Laid:
    """A batch of texts as symbols."""

    symbols: np.ndarray  # of all texts, one behind the other, each with its end
    totals: np.ndarray  # symbols of each text
    sizes: np.ndarray  # words of each text
    index: np.ndarray  # number of each word among those met
    met: Met | MetPieces


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)).view(np.int64)


def _with_ends(inner: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The symbols of texts, one behind the other, with an end behind each; ``totals`` count the ends."""
    symbols = np.full(len(inner) + len(totals), END_SYMBOL, np.int32)
    inside = np.ones(len(symbols), bool)
    inside[np.cumsum(totals) - 1] = False
    symbols[inside] = inner
    return symbols


class Met:
    """Words that a worker has met, by number, and what is known of them: symbol, hash, what a word adds to the score whatever
    its count (``given``) and, as the log of a count, what the letters are worth (no number: the count adds nothing)."""

    def __init__(self, symbols: Symbols, model: Pieces) -> None:
        self.key, self.symbols, self.numbers = symbols.key, symbols, defaultdict(itertools.count().__next__)
        begin = {i: name for name, i in _beginnings(model).items()}
        among = {begin[i]: k for k, i in zip(symbols.places.tolist(), symbols.pieces.tolist(), strict=True) if i in begin}
        self.longest = Longest(among)
        self.sizes = np.zeros(attention.SYMBOLS, np.int64)
        self.sizes[list(among.values())] = [len(name) for name in among]
        self.symbol, self.hash, self.worth, self.given = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def __len__(self) -> int:
        return len(self.numbers)

    def learn(self) -> None:
        """Find the symbols of the words that came since the last time."""
        words = list(itertools.islice(self.numbers, len(self.symbol), None))
        own, longest = self.symbols.own.get, self.longest
        symbol = np.fromiter((longest(w) if (k := own(w)) is None else k for w in words), np.int32, len(words))
        symbol[symbol < 0] = OTHER_SYMBOL
        self.symbol = np.append(self.symbol, symbol)

    def weigh(self) -> None:
        """What scoring needs."""
        words = list(itertools.islice(self.numbers, len(self.hash), None))
        if words:
            symbol = self.symbol[len(self.hash) :]
            self.hash = np.append(self.hash, _hashes(words))
            pairs, first = _letters(words)
            sums = np.concatenate(([0.0], np.cumsum(self.symbols.follow[pairs], dtype=np.float64)))
            stop = np.append(first[1:], len(pairs))
            worth = sums[stop] - sums[first + self.sizes[symbol]] + np.log10(self.symbols.types[symbol])
            alone = self.symbols.alone[symbol]
            self.worth = np.append(self.worth, np.where(alone, np.nan, worth))
            self.given = np.append(self.given, np.where(alone, 0.0, -self.symbols.whole[symbol]))


class MetPieces:
    """The same for words that are encoded: their symbols lie one behind the other, and no count adds to the score."""

    def __init__(self, symbols: PieceSymbols, model: Pieces) -> None:
        self.key, self.symbols, self.model, self.numbers = symbols.key, symbols, model, defaultdict(itertools.count().__next__)
        self.flat, self.starts, self.lengths, self.given = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.hash, self.worth = np.zeros(0, np.int64), np.zeros(0)

    def __len__(self) -> int:
        return len(self.numbers)

    def learn(self) -> None:
        """Encode the words that came since the last time."""
        words = list(itertools.islice(self.numbers, len(self.lengths), None))
        if words:
            ids, lengths = piece_ids(words, self.model)
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, self.symbols.symbol[ids])
            owner = np.repeat(np.arange(len(words)), lengths)
            self.given = np.append(self.given, np.bincount(owner, self.symbols.inside[ids], len(words)))

    def weigh(self) -> None:
        """What scoring needs."""
        words = list(itertools.islice(self.numbers, len(self.hash), None))
        self.hash = np.append(self.hash, _hashes(words))
        self.worth = np.append(self.worth, np.full(len(words), np.nan))


def _met_by(symbols: Symbols | PieceSymbols, kind: type, model: Pieces):
    """The words that this worker has met; they are few enough to be kept."""
    met = model.__dict__.get("_met")
    if met is None or met.key != symbols.key or len(met) >= MET_WORDS:
        met = model.__dict__["_met"] = kind(symbols, model)
    return met


def _numbered(texts: list[list[bytes]], met) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the number of each word; the new ones are learnt."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    index = np.fromiter(map(met.numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    met.learn()
    return sizes, index


class PieceSymbols:
    """Pieces to symbols: the most frequent have their own, the others share one, where each has its share."""

    def __init__(self, counts: np.ndarray, texts: int) -> None:
        self.key = os.urandom(8)
        own = np.argsort(-counts, kind="stable")[:END_SYMBOL]
        self.symbol = np.full(len(counts), OTHER_SYMBOL, np.int32)
        self.symbol[own] = np.arange(len(own))
        rest = self.symbol == OTHER_SYMBOL
        #: Log10 of the share of each piece inside the symbol that the rare pieces share.
        self.inside = np.zeros(len(counts))
        if rest.any():
            self.inside[rest] = np.log10((counts[rest] + 0.1) / (counts[rest].sum() + 0.1 * rest.sum()))
        self.counts = np.zeros(attention.SYMBOLS)
        np.add.at(self.counts, self.symbol, counts)
        self.counts[END_SYMBOL] = texts

    def of(self, texts: list[list[bytes]], model: Pieces) -> Laid:
        """The texts' symbols. Each distinct word is encoded once; a worker keeps those it has met."""
        met = _met_by(self, MetPieces, model)
        sizes, index = _numbered(texts, met)
        lengths = met.lengths[index]
        stops = np.cumsum(lengths)
        at = np.repeat(met.starts[index] - (stops - lengths), lengths) + np.arange(len(lengths) and int(stops[-1]))
        totals = np.bincount(np.repeat(np.arange(len(texts)), sizes), lengths, len(texts)).astype(np.int64) + 1
        return Laid(_with_ends(met.flat[at], totals), totals, sizes, index, met)


class Symbols:
    """Words to symbols: the most frequent have their own, the others share that of their longest chosen beginning.

    ``counts`` and ``types`` are tokens and distinct words of each piece that begins words (and of no
    piece), ``pairs`` of each pair of bytes, ``own`` the frequent words with their counts.
    """

    def __init__(
        self,
        counts: np.ndarray,
        texts: int,
        types: np.ndarray | None = None,
        pairs: np.ndarray | None = None,
        own: dict[bytes, int] | None = None,
        model: Pieces | None = None,
    ) -> None:
        self.key, own = os.urandom(8), own or {}
        types = counts if types is None else types
        chosen = np.argsort(-counts[: len(model.names) if model else None], kind="stable")[: END_SYMBOL - len(own)]
        tokens, distinct = counts.astype(float).copy(), types.astype(float).copy()
        other = 0.0, 0.0
        if model:
            chosen = chosen[counts[chosen] > 0]
            taken = {model.names[i][len(MARK) :].encode(): i for i in chosen.tolist()}
            longest = Longest(taken)
            # Words of a beginning that was not chosen go to the longest one inside it.
            for name, i in _beginnings(model).items():
                if counts[i] and name not in taken:
                    up = longest(name)
                    if up >= 0:
                        tokens[up] += tokens[i]
                        distinct[up] += distinct[i]
                    else:
                        other = other[0] + tokens[i], other[1] + distinct[i]
            other = other[0] + tokens[len(model.names)], other[1] + distinct[len(model.names)]
        both = np.concatenate((np.array(list(own.values()), float), tokens[chosen]))
        place = np.empty(len(both), np.int64)
        place[np.argsort(-both, kind="stable")] = np.arange(len(both))
        self.own = dict(zip(own, place[: len(own)].tolist(), strict=True))
        self.pieces, self.places = chosen, place[len(own) :]
        self.counts, self.types = np.zeros(attention.SYMBOLS), np.ones(attention.SYMBOLS)
        self.counts[place], self.counts[END_SYMBOL], self.counts[OTHER_SYMBOL] = both, texts, other[0]
        self.types[self.places] += distinct[chosen]
        self.types[OTHER_SYMBOL] += other[1]
        #: What is taken off the log of a word's count inside its symbol.
        self.whole = np.log10(self.counts + self.types)
        pairs = (np.zeros(1 << 16) if pairs is None else pairs).reshape(256, 256)
        self.follow = np.log10((pairs + 1 / 256) / (pairs.sum(axis=1, keepdims=True) + 1)).ravel().astype(np.float32)
        self.alone = np.zeros(attention.SYMBOLS, bool)
        self.alone[place[: len(own)]] = True

    def of(self, texts: list[list[bytes]], model: Pieces) -> Laid:
        """The texts' symbols. What is known of a word is found out once; a worker keeps those it has met."""
        met = _met_by(self, Met, model)
        sizes, index = _numbered(texts, met)
        return Laid(_with_ends(met.symbol[index], sizes + 1), sizes + 1, sizes, index, met)


def unpacked(laid: list[bytes]) -> attention.Windows:
    """Windows of texts whose symbols were packed as 16-bit numbers."""
    sizes = np.fromiter(map(len, laid), np.int64, len(laid)) // 2
    return attention.windows(np.frombuffer(b"".join(laid), np.uint16).astype(np.int32), sizes)


def _train_task(shared, weights, symbols: Symbols | PieceSymbols, rate: float, batch: int, least_steps: int, most_steps: int | None):
    """A function for ``mapInPandas``: go on from the weights over a partition's texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer, rng, seen, kept = attention.Trainer(weights.value, rate), np.random.default_rng(9), 0, []

        def steps(layout: attention.Windows) -> None:
            nonlocal seen
            order = rng.permutation(len(layout.seen))
            for at in range(0, len(order), batch):
                if most_steps is not None and trainer.steps >= most_steps:
                    return
                rows = np.sort(order[at : at + batch])
                part = attention.Windows(*[getattr(layout, f)[rows] for f in ("seen", "known", "wanted", "real", "owner")])
                trainer.step(part, lost=False)
                seen += int(part.real.sum())

        for frame in batches:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                if "laid" in part:
                    layout = unpacked(part["laid"].tolist())
                else:
                    laid = symbols.of([words_of(t) for t in part["text"]], shared.value)
                    layout = attention.windows(laid.symbols, laid.totals)
                steps(layout)
                if least_steps:
                    kept.append(layout)
        while kept and trainer.steps < least_steps:
            before = trainer.steps
            for layout in kept:
                steps(layout)
            if trainer.steps == before:
                break
        if seen:
            yield pd.DataFrame({"seen": [seen], "weights": [trainer.flat.tobytes()]})

    return run


def _averaged(rows: DataFrame, groups: int = 16) -> np.ndarray | None:
    """The mean of the tasks' weights by symbols seen; at most ``groups`` rows reach the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(attention.SIZE), 0
        for batch in batches:
            for n, data in zip(batch["seen"], batch["weights"], strict=True):
                total += n * np.frombuffer(data, np.float32).astype(np.float64)
                seen += n
        if seen:
            yield pd.DataFrame({"seen": [seen], "weights": [(total / seen).astype(np.float32).tobytes()]})

    parts = rows.repartition(groups).mapInPandas(add, "seen bigint, weights binary").collect()
    if not parts:
        return None
    seen = sum(p["seen"] for p in parts)
    return sum(p["seen"] / seen * np.frombuffer(p["weights"], np.float32).astype(np.float64) for p in parts).astype(np.float32)


def train(
    docs: DataFrame,
    shared,
    symbols: Symbols | PieceSymbols,
    first_docs: int = 1_500,
    first_steps: int = 500,
    rates: tuple[float, ...] = (0.01, 0.005),
    batch: int = 256,
) -> np.ndarray:
    """Weights from texts (``text``, or ``laid`` as by ``lay_parts``; ``draw``: a hash of the row); each text is in the round of one rate."""
    spark = docs.sparkSession
    given = "laid" if "laid" in docs.columns else "text"
    weights = attention.fresh(symbols.counts)
    count = docs.count()
    near = min(1.0, 2 * first_docs / max(count, 1))
    drawn = lambda low, high: (F.col("draw") >= int(low * 1e6)) & (F.col("draw") < int(high * 1e6))
    schema = "seen bigint, weights binary"
    task = _train_task(shared, Sent(spark, weights), symbols, 0.02, batch, first_steps, first_steps)
    first = docs.where(drawn(0, near)).limit(first_docs).coalesce(1).select(given)
    weights = next((np.frombuffer(r["weights"], np.float32) for r in first.mapInPandas(task, schema).collect()), weights)
    for k, rate in enumerate(rates):
        part = docs.where(drawn(1 - (k + 1) / len(rates), 1 - k / len(rates))).select(given)
        task = _train_task(shared, Sent(spark, weights), symbols, rate, batch, 0, None)
        mean = _averaged(part.mapInPandas(task, schema))
        weights = weights if mean is None else mean
    return weights


PARTS = "chunk bigint, doc int, held {}, draw bigint, n_tokens bigint, n_known bigint, base double, score double, laid binary"
PACKS = "bucket bigint, docs binary, hashes binary, times binary, worths binary"


def lay_parts(docs: DataFrame, shared, symbols: Symbols | PieceSymbols, heavy: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """One row per document (its symbols, and what the broadcast words give), and packed rows of the other words."""
    known = Sent(docs.sparkSession, heavy)
    kind = docs.schema["held"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hashes, counts = known.value
        chunk = TaskContext.get().partitionId() << 32
        met, hit, logs, inner = None, np.zeros(0, bool), np.zeros(0), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                laid = symbols.of(texts, model)
                sizes, index = laid.sizes, laid.index
                if met is not laid.met:
                    met, hit, logs, inner = laid.met, np.zeros(0, bool), np.zeros(0), np.zeros(0)
                if len(hit) < len(met):
                    met.weigh()
                    fresh = slice(len(hit), None)
                    own, worth = met.hash[fresh], met.worth[fresh]
                    place = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                    there = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
                    n = np.where(there, counts[place] if len(hashes) else 0, 0)
                    hit, logs = np.append(hit, there), np.append(logs, np.where(there, np.log10(n + 0.1), 0.0))
                    inside = np.where(there & ~np.isnan(worth), np.log10(np.maximum(n, 1) + 10.0**worth), 0.0)
                    inner = np.append(inner, met.given[fresh] + inside)
                owner = np.repeat(np.arange(len(texts)), sizes)
                score = np.bincount(owner, inner[index], len(texts))
                packed, stops = laid.symbols.astype(np.uint16).tobytes(), (2 * np.cumsum(laid.totals)).tolist()
                texts = [packed[i:j] for i, j in zip([0, *stops], stops)]
                base = np.bincount(owner, logs[index], len(texts))
                n_known = np.bincount(owner, hit[index], len(texts)).astype(np.int64)
                none = [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(texts), chunk)), pa.array(np.arange(len(texts), dtype=np.int32)), part.column("held"), part.column("draw"),
                     pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(texts, pa.binary()), pa.array(none, pa.int64()),
                     *[pa.array(none, pa.binary()) for _ in range(4)]], NAMES)
                rare = ~hit[index]
                pairs, times = np.unique(owner[rare] * len(met) + index[rare], return_counts=True)
                doc, number = (pairs // max(len(met), 1)).astype(np.uint16), pairs % max(len(met), 1)
                word, worth = met.hash[number], met.worth[number]
                bucket = word % buckets
                order = np.argsort(bucket, kind="stable")
                present, first = np.unique(bucket[order], return_index=True)
                cuts = np.append(first, len(order))
                groups = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                empty = [None] * len(groups)
                pack = lambda x, kind: pa.array([x[g].astype(kind).tobytes() for g in groups], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(groups), chunk)), pa.array(empty, pa.int32()), pa.array(empty, part.column("held").type),
                     *[pa.array(empty, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())], pa.array(present),
                     pack(doc, np.uint16), pack(word, np.int64), pack(times, np.uint32), pack(worth, np.float32)], NAMES)
                chunk += 1

    return docs.select("held", "draw", "text").mapInArrow(run, f"{PARTS.format(kind)}, {PACKS}")


NAMES = ["chunk", "doc", "held", "draw", "n_tokens", "n_known", "base", "score", "laid", "bucket", "docs", "hashes", "times", "worths"]


def attend(parts: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents' rows of ``lay_parts``, the score with what the model gives to the symbols."""
    fitted = Sent(parts.sparkSession, weights)
    kept = [c for c in NAMES[: NAMES.index("laid")] if c != "draw"]
    rows = parts.where("doc is not null").select(*kept, "laid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = attention.Scorer(fitted.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                layout = unpacked(part.column("laid").to_pylist())
                found = np.concatenate([
                    scorer.log_probabilities(attention.Windows(*[getattr(layout, f)[i : i + PASS] for f in ("seen", "known", "wanted", "real", "owner")])).sum(axis=1, dtype=np.float64)
                    for i in range(0, len(layout.seen), PASS)
                ])
                score = part.column("score").to_numpy() + np.bincount(layout.owner, found, part.num_rows) / np.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept[:-1]], pa.array(score)], kept)

    return rows.mapInArrow(run, rows.drop("laid").schema)


def look_up(entries: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """``chunk, doc, known, log, inside``: what the packed words of a bucket add to each document."""
    counts = words.select(
        F.pmod("hash", F.lit(buckets)).alias("bucket"), F.lit(0).alias("kind"), F.col("hash"), F.col("n"),
        F.lit(0).cast("bigint").alias("chunk"), *[F.lit(None).cast("binary").alias(c) for c in ("docs", "hashes", "times", "worths")],
    )
    packed = entries.select(
        "bucket", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("hash"), F.lit(0).cast("bigint").alias("n"),
        "chunk", "docs", "hashes", "times", "worths",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, table = None, [], None
        for batch in batches:
            for bucket, rows in batch.groupby("bucket", sort=False):
                if bucket != at:
                    at, parts, table = bucket, [], None
                given = rows[rows["kind"] == 0]
                if len(given):
                    parts.append((given["hash"].to_numpy(np.int64), given["n"].to_numpy(np.int64)))
                asked = rows[rows["kind"] == 1]
                if len(asked) and table is None:
                    hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                    n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
                    order = np.argsort(hashes)
                    table, parts = (np.append(hashes[order], 0), np.append(n[order], 0), len(order)), []
                out = []
                for chunk, docs, words, times, worths in asked[["chunk", "docs", "hashes", "times", "worths"]].itertuples(index=False):
                    doc, word = np.frombuffer(docs, np.uint16), np.frombuffer(words, np.int64)
                    times = np.frombuffer(times, np.uint32)
                    place = np.searchsorted(table[0][: table[2]], word)
                    n = np.where((place < table[2]) & (table[0][place] == word), table[1][place], 0)
                    worth = np.frombuffer(worths, np.float32).astype(np.float64)
                    logs = np.where(n > 0, np.log10(np.maximum(n, 1) + 10.0**worth), worth)
                    logs[np.isnan(worth)] = 0.0
                    present, inside = np.unique(doc, return_inverse=True)
                    out.append(
                        pd.DataFrame({
                            "chunk": chunk, "doc": present.astype(np.int32),
                            "known": np.bincount(inside, times * (n > 0), len(present)).astype(np.int64),
                            "log": np.bincount(inside, times * np.log10(n + 0.1), len(present)),
                            "inside": np.bincount(inside, times * logs, len(present)),
                        })
                    )
                if out:
                    yield pd.concat(out)

    both = counts.unionByName(packed).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInPandas(run, "chunk bigint, doc int, known bigint, log double, inside double")


def score_documents(
    docs: DataFrame,
    usable: Column,
    model: Pieces,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    by_pieces: bool = False,
    **options,
) -> DataFrame:
    """The ``carry`` columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    Learns from the rows that are ``usable``. ``by_pieces``: the model's symbols are pieces of encoded words, else words.
    """
    spark = docs.sparkSession
    carry = [id_col] if carry is None else carry
    shared = Sent(spark, model)
    text = text_of(text_col)
    training = docs.where(usable).select(text.alias("text"))
    words = settle(count_words(training), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = words.where((F.col("n") >= max(1, total * HEAVY_SHARE)) & (F.length("word") > 0)).select("hash", "n").orderBy("hash").toArrow()
    table = heavy["hash"].to_numpy(), heavy["n"].to_numpy()
    if by_pieces:
        symbols = PieceSymbols(count_pieces(words, shared), ends)
    else:
        own = words.where(F.length("word").between(1, OWN_LENGTH)).orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect()
        own = {bytes(r["word"]): r["n"] for r in own}
        tokens, types, pairs = count_beginnings(words, shared, list(own))
        symbols = Symbols(tokens, ends, types, pairs, own, model)
    buckets = max(LEAST_BUCKETS, distinct // BUCKET_WORDS)
    draw = F.when(usable, F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1_000_000)))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("held"), draw.alias("draw"), text.alias("text"))
    parts = settle(lay_parts(held, shared, symbols, table, buckets), "parts")
    weights = train(parts.where("draw is not null").select("laid", "draw"), shared, symbols, **options)
    done = settle(attend(parts, weights), "scored")
    rest = (
        look_up(parts.where("doc is null"), words.where(F.length("word") > 0), buckets)
        .groupBy(F.col("chunk").alias("c"), F.col("doc").alias("d"))
        .agg(F.sum("known").alias("more"), F.sum("log").alias("log"), F.sum("inside").alias("inside"))
    )
    scored = done.join(rest, (F.col("chunk") == F.col("c")) & (F.col("doc") == F.col("d")), "left")
    spread = float(np.log10(total + 0.1 * (distinct + 1)))
    end_log, end_known = float(np.log10(ends + 0.1)), int(ends > 0)
    names = columns_free(docs.select(*[F.col(f"`{c}`") for c in carry]), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    values = (
        F.col("n_tokens"),
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(end_known)).cast("bigint"),
        F.lit(total).cast("bigint"),
        F.col("base") + F.coalesce("log", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(spread),
        F.col("score") + F.coalesce("inside", F.lit(0.0)),
    )
    return scored.select("held.*", *[v.alias(n) for v, n in zip(values, names, strict=True)])
