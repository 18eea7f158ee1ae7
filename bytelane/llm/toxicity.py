"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and their leading 4 and 6 bytes (A-Z
lower-cased), hashed into 2^18 buckets; a term counts once per document. All
buckets that occur in the labelled sample are the machine's inputs, however
rare. It learns a weight for each and a vector of `FACTORS` numbers, whose
products are the weights of all pairs, on the logistic loss.

The fit reads at most `TRAIN_ROWS` labelled documents (whole texts), the
smallest by a hash of the id, and of these, in that order, as many as have
`TRAIN_TERMS` distinct terms in all. The weights' penalty is that of
`PENALTIES` with the least loss on the fifth of the sample that is kept apart.
Scoring reads every whole text of every row.

Defined results: null and empty texts score as documents without terms;
without labelled rows, or with one class only, every score is the smoothed
share of label 1; of labelled rows that share an id the least text counts;
repeated rows score alike; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.labelled import labelled_texts, sigmoid, with_block_scores, within
from bytelane.llm.store import settle
from bytelane.llm.words import ALNUM, LOWER, mix, prefix_hash, span_hashes, split_words, text_blocks, text_buffer

TRAIN_ROWS = 20_000
TRAIN_TERMS = 32_000_000  # on the driver: 4 bytes each
BITS = 18
PREFIXES = (4, 6)
FACTORS = 4
EPOCHS = 12
PENALTIES = (20.0, 5.0, 80.0)  # L1, on the weights
SETTLED = 1e-3  # a smaller error moves nothing but the bias
PATIENCE = 3  # epochs without a smaller loss on the rows kept apart


@dataclass
class Machine:
    bias: float
    slots: np.ndarray  # bucket -> input, -1 for none
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Logits of `n` documents from their distinct `(text, feature)` pairs, sorted by text."""
        out = np.full(n, self.bias)
        if len(text):
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            v = self.factors[feature]
            s = np.add.reduceat(v, first, axis=0)
            pairs = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), first))
            out[text[first]] += np.add.reduceat(self.weights[feature], first) + pairs
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, bucket = terms(texts)
        slot = self.slots[bucket]
        own = slot >= 0
        found = np.unique(owner[own] * len(self.weights) + slot[own])
        return sigmoid(self.logits(found // len(self.weights), found % len(self.weights), len(texts)))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`(text, bucket)` of every term occurrence."""
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    starts, ends, first = split_words(raw, offsets, ALNUM)
    sums = prefix_hash(raw)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    buckets = [span_hashes(sums, starts, ends) >> shift]
    for n in PREFIXES:
        long = ends - starts >= n
        h = span_hashes(sums, starts[long], starts[long] + n)
        part = np.full(len(starts), -1, np.int64)
        part[long] = (mix(h + np.uint64(n)) >> shift).astype(np.int64)
        buckets.append(part)
    owner, bucket = np.tile(owner, len(buckets)), np.concatenate([b.astype(np.int64) for b in buckets])
    keep = bucket >= 0
    return owner[keep], bucket[keep]


def _term_sets(rows: DataFrame) -> DataFrame:
    """`(label, terms, h)`: the distinct buckets of each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            owner, bucket = terms(block.column("text"))
            found = np.unique(owner * (1 << BITS) + bucket)
            bounds = np.searchsorted(found, np.arange(block.num_rows + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((found & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("label"), lists, block.column("h")], names=["label", "terms", "h"])

    return rows.select("label", "text", "h").mapInArrow(run, "label int, terms array<int>, h long")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    sets = settle(_term_sets(labelled_texts(docs, labels, label, TRAIN_ROWS, id_col, text_col)), "terms")
    sets = within(sets, F.size("terms"), TRAIN_TERMS).select("label", "terms")
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, pos = int(total["n"]), int(total["pos"])
    base = float(np.log((pos + 1) / (n - pos + 1)))
    slots = np.full(1 << BITS, -1, np.int64)
    if pos == 0 or pos == n:
        return Machine(base, slots, np.zeros(1), np.zeros((1, FACTORS)))
    # at most TRAIN_ROWS rows and TRAIN_TERMS terms, as Arrow
    rows = sets.toArrow()
    lists, y = rows.column("terms").combine_chunks(), rows.column("label").to_numpy()
    del rows
    bounds, found = lists.offsets.to_numpy(), lists.values.to_numpy()
    known = np.unique(found[bounds[0]:bounds[-1]])
    slots[known] = np.arange(len(known))
    features = [slots[found[a:b]].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
    del lists, found
    order = sorted(range(len(y)), key=lambda i: (y[i], features[i].astype(">i4").tobytes()))
    return _learn([features[i] for i in order], y[order].astype(float), slots, base, len(known))


class _State:
    """What the learner knows: weight, factors and the factors' squares side by side, one look-up a term."""

    def __init__(self, n: int, bias: float, penalty: float):
        self.rng = np.random.default_rng(7)
        self.bias, self.penalty = bias, penalty
        self.p = np.zeros((n, FACTORS + 2), np.float32)
        self.p[:, 1:-1] = self.rng.normal(0, 0.01, (n, FACTORS))
        self.p[:, -1] = (self.p[:, 1:-1] ** 2).sum(axis=1)
        self.pull, self.seen_w, self.seen_v, self.seen_b = np.zeros(n), np.zeros(n), np.full((n, FACTORS), 100.0), 1.0

    def epoch(self, features: list[np.ndarray], sizes: np.ndarray, y: np.ndarray, rows: np.ndarray, factors: bool, rate: float = 0.1) -> None:
        """Every row once: weights by the regularised leader, and, if asked for, the factors."""
        p = self.p
        order = self.rng.permutation(rows)
        for begin in range(0, len(order), 64):
            batch = order[begin:begin + 64]
            q = np.zeros((len(batch), FACTORS + 2))
            size = sizes[batch]
            f = np.concatenate([features[i] for i in batch])
            if len(f):
                q[size > 0] = np.add.reduceat(p[f], (np.cumsum(size) - size)[size > 0], axis=0)
            s = q[:, 1:-1]
            error = sigmoid(self.bias + q[:, 0] + 0.5 * ((s * s).sum(axis=1) - q[:, -1])) - y[batch]
            g = error.sum()
            self.seen_b += g * g
            self.bias -= rate * g / np.sqrt(self.seen_b)
            on = (np.abs(error) > SETTLED) & (size > 0)
            if not on.any():
                continue
            used, at = np.unique(f[np.repeat(on, size)], return_inverse=True)
            text = np.repeat(np.flatnonzero(on), size[on])
            gw = np.bincount(at, error[text])
            v = p[used, 1:-1].astype(float)
            es = error[:, None] * s
            gv = np.stack([np.bincount(at, es[text, k]) for k in range(FACTORS)], axis=1) - v * gw[:, None] if factors else None
            more = self.seen_w[used] + gw ** 2
            self.pull[used] += gw - (np.sqrt(more) - np.sqrt(self.seen_w[used])) * p[used, 0]
            self.seen_w[used] = more
            pull = self.pull[used]
            p[used, 0] = -np.sign(pull) * np.maximum(np.abs(pull) - self.penalty, 0) / (1 + np.sqrt(more))
            if gv is not None:
                self.seen_v[used] += gv ** 2
                v -= rate * gv / np.sqrt(self.seen_v[used])
                p[used, 1:-1] = v
                p[used, -1] = (v * v).sum(axis=1)

    def machine(self, slots: np.ndarray) -> Machine:
        return Machine(self.bias, slots, self.p[:, 0].astype(float), self.p[:, 1:-1].astype(float))


def _learn(features: list[np.ndarray], y: np.ndarray, slots: np.ndarray, base: float, n: int) -> Machine:
    """`EPOCHS` over the weights alone, then as many over weights and factors.

    The weights follow the regularised leader with an L1 penalty, so a term
    gets one as soon as its documents ask for it, however rare it is. The
    factors then learn what the sums leave. Every fifth row at random is kept
    apart: the penalty with the least loss on those rows after the first half
    goes on, and the epoch with the least loss on them is the result.
    """
    sizes = np.array([len(f) for f in features])
    shuffled = np.random.default_rng(8).permutation(len(y))
    apart, rows = shuffled[:len(y) // 5], shuffled[len(y) // 5:]

    def loss(m: Machine) -> float:
        total = 0.0
        for at in range(0, len(apart), 500):  # a few documents at a time: their pairs take memory
            some = apart[at:at + 500]
            text = np.repeat(np.arange(len(some)), sizes[some])
            chance = sigmoid(m.logits(text, np.concatenate([features[i] for i in some]), len(some)))
            total -= float(np.log(np.where(y[some] == 1, chance, 1 - chance)).sum())
        return total

    least, state = np.inf, None
    for penalty in PENALTIES if len(apart) else PENALTIES[:1]:
        tried = _State(n, base, penalty)
        for _ in range(EPOCHS):
            tried.epoch(features, sizes, y, rows, factors=False)
        found = loss(tried.machine(slots))
        if state is None or found < least:
            state, least = tried, found
        del tried
    best, best_epoch = state.machine(slots), 0
    for epoch in range(1, EPOCHS + 1):
        state.epoch(features, sizes, y, rows, factors=True)
        m = state.machine(slots)
        found = loss(m)
        if found < least or not len(apart):
            least, best, best_epoch = found, m, epoch
        elif epoch - best_epoch >= PATIENCE:
            break
    return best


def score(docs: DataFrame, machine: Machine, out: str = "toxicity", text_col: str = "text") -> DataFrame:
    """`docs` and the probability of label 1."""
    return with_block_scores(docs, text_col, out, machine.scores)
