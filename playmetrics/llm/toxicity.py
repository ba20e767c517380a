"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its terms (lower-cased runs of letters and digits, and the first letters of
longer ones), each hashed to 48 bits.
The score is the logistic function of a bias, a weight per term, and the inner products of the
factor vectors of every two terms: pairs such as an insult beside the mention of a group get a weight
of their own, which a sum of weights cannot give. The pair sum takes one pass over the terms.

The model is fitted in numpy on a bounded sample of labelled rows (``sample_rows``, the rows with the
smallest id hash). Terms have weights if at least ``least_docs`` sampled rows hold them and their
log-likelihood ratio against the labels reaches ``least_strength``, ``most_terms`` of them at most. A term that
says nothing alone may tell beside another: the ``pair_terms`` most frequent terms are also tried in all pairs, and both
terms of a pair get weights if the four cells of the pair tell ``pair_strength`` more than the two terms
apart. So the model that is broadcast has a fixed bound, and the mass of uninformative terms of a long
text does not move its score. Training takes proximal AdaGrad steps.

Defined cases: a null or empty text is scored by the bias; unknown terms are passed by; a document
labelled more than once is toxic if any of its labels says so, null labels are passed by; without labelled
rows of both classes every score is the share of toxic labels (0.5 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .common import Sent, columns_free, text_of

TERM = re.compile(r"[^\W_]+")
HASH_BITS = 48
#: Letters of a word's beginning that are a term of their own: inflected forms share it.
STEMS = (4, 5)
#: Distinct terms whose rows a task keeps at hand.
KEPT_TERMS = 300_000
#: Documents that are scored together.
BATCH = 1_024


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), 0) >> (64 - HASH_BITS)


@dataclass
class Machine:
    """Sorted term hashes, and for each a weight and a factor vector."""

    hashes: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def margins(self, flat: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
        """Margins of ``docs`` documents from the rows of their terms; ``owner`` names the document."""
        found = self.bias + np.bincount(owner, self.weights[flat], docs)
        for factor in self.factors.T:
            v = factor[flat]
            found += 0.5 * (np.bincount(owner, v, docs) ** 2 - np.bincount(owner, v * v, docs))
        return found


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(
    terms: list[np.ndarray],
    labels: np.ndarray,
    factors: int = 8,
    epochs: int = 12,
    rate: float = 0.5,
    factor_rate: float = 0.05,
    lasso: float = 0.02,
    ridge: float = 0.1,
    batch: int = 256,
    seed: int = 11,
) -> Machine:
    """Fit on documents given as arrays of the distinct term hashes that get weights."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        edge = min(max(share, 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return Machine(np.zeros(0, np.int64), float(np.log(edge / (1 - edge))), np.zeros(0), np.zeros((0, factors)))
    known = np.unique(np.concatenate(terms))
    rng = np.random.default_rng(seed)
    model = Machine(known, float(np.log(share / (1 - share))), np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors)))
    sums = np.ones((len(known), factors + 1))
    bias_sum = 1.0
    rates = np.array([rate] + [factor_rate] * factors)
    rows = [model.rows(t) for t in terms]
    rows = [r[r >= 0] for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = [len(rows[i]) for i in chosen]
            flat = np.concatenate([rows[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            error = logistic(model.margins(flat, owner, len(chosen))) - labels[chosen]
            touched, inside = np.unique(flat, return_inverse=True)
            pull = error[owner]
            grads = np.empty((len(touched), factors + 1))
            grads[:, 0] = np.bincount(inside, pull, len(touched))
            for f in range(factors):
                v = model.factors[flat, f]
                total = np.bincount(owner, v, len(chosen))
                grads[:, f + 1] = np.bincount(inside, pull * (total[owner] - v), len(touched))
            grads[:, 1:] += ridge * model.factors[touched]
            sums[touched] += grads**2
            step = rates / np.sqrt(sums[touched])
            moved = model.weights[touched] - step[:, 0] * grads[:, 0]
            model.weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step[:, 0] * lasso, 0)
            moved = model.factors[touched] - step[:, 1:] * grads[:, 1:]
            model.factors[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step[:, 1:] * lasso, 0)
            lean = float(error.sum())
            bias_sum += lean**2
            model.bias -= rate * lean / bias_sum**0.5
    used = (model.weights != 0) | (model.factors != 0).any(axis=1)
    return Machine(known[used], model.bias, model.weights[used], model.factors[used])


def _terms(text: str) -> set[str]:
    """The distinct words, and their beginnings marked with a leading space."""
    words = set(TERM.findall(text.lower()))
    return words.union(*({f" {w[:n]}" for w in words if len(w) > n} for n in STEMS))


def association(toxic: Column, docs: Column, all_toxic: int, all_docs: int) -> Column:
    """The log-likelihood ratio of a term (in ``docs`` documents, ``toxic`` of them toxic) against the labels."""
    share = all_toxic / all_docs
    without = F.lit(all_docs) - docs
    cells = [
        (toxic, docs * share),
        (docs - toxic, docs * (1 - share)),
        (F.lit(all_toxic) - toxic, without * share),
        (F.lit(all_docs - all_toxic) - (docs - toxic), without * (1 - share)),
    ]
    return 2 * sum((F.when(seen > 0, seen * F.log(seen / due)).otherwise(F.lit(0.0)) for seen, due in cells), F.lit(0.0))


def _llr(toxic: np.ndarray, docs: np.ndarray, share: float) -> np.ndarray:
    """Twice the log-likelihood that cells of ``docs`` rows gain by a share of their own."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = toxic * np.log(toxic / (docs * share)), (docs - toxic) * np.log((docs - toxic) / (docs * (1 - share)))
    return 2 * sum(np.where(np.isfinite(p), p, 0.0) for p in parts)


def telling_pairs(terms: list[np.ndarray], labels: np.ndarray, tried: np.ndarray, least: float) -> np.ndarray:
    """Those of the ``tried`` term hashes (sorted) that tell in a pair by ``least`` more than alone."""
    width, share = len(tried), float(labels.mean())
    both, toxic = np.zeros((width, width), np.float32), np.zeros((width, width), np.float32)
    for at in range(0, len(terms), 1_024):
        part = terms[at : at + 1_024]
        held = np.zeros((len(part), width), np.float32)
        for row, found in zip(held, part, strict=True):
            row[np.searchsorted(tried, np.intersect1d(found, tried))] = 1
        both += held.T @ held
        bad = held[labels[at : at + 1_024] == 1]
        toxic += bad.T @ bad
    n, t = np.diag(both).astype(float), np.diag(toxic).astype(float)
    alone, found = _llr(t, n, share) + _llr(labels.sum() - t, len(labels) - n, share), np.zeros(width, bool)
    for i in range(width):
        ab, tab = both[i].astype(float), toxic[i].astype(float)
        cells = [(tab, ab), (t[i] - tab, n[i] - ab), (t - tab, n - ab), (labels.sum() - t - t[i] + tab, len(labels) - n - n[i] + ab)]
        more = sum(_llr(*cell, share) for cell in cells) - alone - alone[i]
        more[i] = 0
        if more.max(initial=0) >= least:
            found[i] = True
            found |= more >= least
    return tried[found]


def sample_terms(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    sample_rows: int,
    least_docs: int,
    least_strength: float,
    most_terms: int,
    pair_terms: int,
    pair_strength: float,
    label: str,
    id_col: str,
    text_col: str,
) -> tuple[list[np.ndarray], np.ndarray]:
    """Telling term hashes and labels of at most ``sample_rows`` labelled documents, those of the least id hash."""
    chosen = (
        labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("labelled"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("labelled")
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array(sorted(term_hash(t) for t in _terms(text)), np.int64) for text in batch["text"]]
            yield pd.DataFrame({"h": xxhash_order(batch["id"]), "y": batch["y"], "terms": found})

    sample = settle(texts.mapInPandas(hashed, "h bigint, y int, terms array<bigint>"), "sample")
    all_docs, all_toxic = sample.agg(F.count("*"), F.sum("y")).first()
    if not all_docs or not 0 < all_toxic < all_docs:
        y = np.full(all_docs, float(bool(all_toxic)))
        return [np.zeros(0, np.int64)] * all_docs, y
    counted = settle(
        sample.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("docs"), F.sum("y").alias("toxic"))
        .where(F.col("docs") >= least_docs)
        .withColumn("strength", association(F.col("toxic"), F.col("docs"), all_toxic, all_docs)),
        "terms",
    )
    telling = counted.where(F.col("strength") >= least_strength).orderBy(F.desc("strength"), "term").limit(most_terms)
    frequent = counted.orderBy(F.desc("docs"), "term").limit(pair_terms)
    alone, tried = (np.sort(df.select("term").toArrow()["term"].to_numpy()) for df in (telling, frequent))
    known = np.union1d(alone, tried)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(terms=[np.intersect1d(t, known) for t in batch["terms"]])

    got = sample.mapInPandas(reduced, "h bigint, y int, terms array<bigint>").toArrow()
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    lists = got["terms"].combine_chunks()
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    found, y = [flat[offsets[i] : offsets[i + 1]] for i in order], got["y"].to_numpy().astype(float)[order]
    kept = np.union1d(alone, telling_pairs(found, y, tried, pair_strength))
    return [np.intersect1d(t, kept) for t in found], y


def xxhash_order(ids: pd.Series) -> np.ndarray:
    """A fixed order of the sample, whatever the order in which its rows arrive."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 1) >> 1 for i in ids], np.int64)


def score_documents(
    docs: DataFrame, model: Machine, carry: list[str], text_col: str = "text"
) -> DataFrame:
    """The ``carry`` columns and ``score``, the probability of label 1."""
    shared = Sent(docs.sparkSession, model)
    (name,) = columns_free(docs.select(*[F.col(f"`{c}`") for c in carry]), "score")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("held"), text_of(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        own, kept = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [_terms(text) for text in part.column("text").to_pylist()]
                fresh = list({t for found in sets for t in found if t not in kept})
                rows = own.rows(np.array([term_hash(t) for t in fresh], np.int64)).tolist()
                if len(kept) + len(fresh) > KEPT_TERMS:
                    kept = {t: r for t, r in kept.items() if r >= 0}
                    fresh_rows = dict(zip(fresh, rows, strict=True))
                    look = [[r for t in found if (r := kept.get(t, fresh_rows.get(t, -1))) >= 0] for found in sets]
                else:
                    kept.update(zip(fresh, rows, strict=True))
                    look = [[r for t in found if (r := kept[t]) >= 0] for found in sets]
                flat = np.array([r for found in look for r in sorted(found)], np.int64)
                owner = np.repeat(np.arange(len(look)), [len(found) for found in look])
                scores = logistic(own.margins(flat, owner, len(look)))
                yield pa.RecordBatch.from_arrays([part.column("held"), pa.array(scores, pa.float64())], ["held", "score"])

    kind = held.schema["held"].dataType.simpleString()
    return held.mapInArrow(run, f"held {kind}, score double").select("held.*", F.col("score").alias(name))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    carry: list[str],
    sample_rows: int = 20_000,
    least_docs: int = 3,
    least_strength: float = 24.0,
    most_terms: int = 131_072,
    pair_terms: int = 2_048,
    pair_strength: float = 40.0,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Fit on the label rows that are ``usable``, then score every document."""
    terms, y = sample_terms(
        docs, labels, usable, sample_rows, least_docs, least_strength, most_terms, pair_terms, pair_strength, label, id_col, text_col
    )
    return score_documents(docs, train(terms, y, **options), carry, text_col)
