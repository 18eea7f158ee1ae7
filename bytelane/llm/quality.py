"""Quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of `CHUNK` bytes, a new
one every `STEP`, so that every convolution window lies whole in a chunk. Byte
vectors pass a convolution; its filters' maxima over a chunk (what occurs in
it at all) and the chunk's length pass a hidden layer. The hidden values'
maximum and mean over all chunks of the document give one probability.

The fit reads at most `TRAIN_ROWS` labelled documents, the smallest by a hash
of the id, and of these, in that order, as many whole ones as `TRAIN_BYTES`
hold (none that is larger by itself). Fit and scoring read every chunk of a
document, a bounded number at a time.

Defined results: null and empty texts are one chunk without bytes; without
labelled rows, or with one class only, every score is the smoothed share of
label 1; of labelled rows that share an id the least text counts; repeated
rows score alike; an empty table gives no rows; other
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.labelled import labelled_texts, sigmoid, with_block_scores, within
from bytelane.llm.words import expand, text_buffer

TRAIN_ROWS = 8_000
TRAIN_BYTES = 64 << 20
EPOCHS = 5
CHUNK, WIDTH, STRIDE = 256, 8, 2
STEP = CHUNK - WIDTH
VECTOR, FILTERS, HIDDEN = 6, 32, 16
PAD = 256  # the symbol past the end of a text
AT_ONCE = 1024  # chunks computed together


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "bytes": rng.normal(0, 0.5, (257, VECTOR)).astype(f32),
            "conv": rng.normal(0, 0.2, (WIDTH * VECTOR, FILTERS)).astype(f32),
            "conv_b": np.zeros(FILTERS, f32),
            "hidden": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(f32),
            "hidden_b": np.zeros(HIDDEN, f32),
            "out": rng.normal(0, 0.2, 2 * HIDDEN).astype(f32),
            "out_b": np.zeros(1, f32),
        }
        self.constant: float | None = None

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Convolution windows `(chunk, place, WIDTH * VECTOR)`."""
        x = self.p["bytes"][chunks]
        n = (chunks.shape[1] - WIDTH) // STRIDE + 1
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(x), n, WIDTH, VECTOR), (a, b * STRIDE, b, c)).reshape(len(x), n, WIDTH * VECTOR)

    def chunk_values(self, chunks: np.ndarray, sizes: np.ndarray, keep: bool = False):
        w = self.windows(chunks)
        z = w @ self.p["conv"]
        top = z.max(axis=1) + self.p["conv_b"]
        pooled = np.concatenate([np.maximum(top, 0), (np.log1p(sizes) / np.log1p(CHUNK))[:, None].astype(np.float32)], axis=1)
        h = pooled @ self.p["hidden"] + self.p["hidden_b"]
        return (np.maximum(h, 0), h, pooled, top, z, w) if keep else np.maximum(h, 0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = text_buffer(texts)
        return self.score_bytes(raw, offsets)

    def score_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        starts, ends, owner = chunk_spans(offsets)
        best, total = np.full((n, HIDDEN), -np.inf), np.zeros((n, HIDDEN))
        for at in range(0, len(starts), AT_ONCE):
            a, b, own = starts[at:at + AT_ONCE], ends[at:at + AT_ONCE], owner[at:at + AT_ONCE]
            h = self.chunk_values(chunk_bytes(raw, a, b), b - a)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best[own[first]] = np.maximum(best[own[first]], np.maximum.reduceat(h, first, axis=0))
            total[own[first]] += np.add.reduceat(h, first, axis=0)
        pooled = np.concatenate([best, total / np.bincount(owner, minlength=n)[:, None]], axis=1)
        return sigmoid(pooled @ self.p["out"] + self.p["out_b"])


def chunk_spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all chunks of all texts, and the text of each."""
    sizes = np.diff(offsets)
    n = np.maximum(-(-(sizes - CHUNK) // STEP), 0) + 1
    owner = np.repeat(np.arange(len(sizes)), n)
    starts = offsets[owner] + (expand(np.zeros(len(n), np.int64), n)) * STEP
    return starts, np.minimum(starts + CHUNK, offsets[owner + 1]), owner


def chunk_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    place = starts[:, None] + np.arange(CHUNK)[None, :]
    inside = place < ends[:, None]
    out = np.full(place.shape, PAD, np.int16)
    out[inside] = raw[place[inside]]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    texts = labelled_texts(docs, labels, label, TRAIN_ROWS, id_col, text_col)
    # whole documents of TRAIN_BYTES in all
    sample = within(texts, F.octet_length("text"), TRAIN_BYTES).select("label", "text").toArrow()
    rows = []
    for batch in sample.to_batches():
        raw, offsets = text_buffer(batch.column("text"))
        starts, ends, owner = chunk_spans(offsets)
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        for i, y in enumerate(batch.column("label").to_pylist()):
            rows.append((y, [raw[a:b].tobytes() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)]))
    rows.sort()
    return learn([r[1] for r in rows], np.array([r[0] for r in rows], np.float32))


def learn(docs: list[list[bytes]], y: np.ndarray) -> Network:
    net = Network()
    pos = float(y.sum())
    if pos == 0 or pos == len(y):
        net.constant = (pos + 1) / (len(y) + 2)
        return net
    rng = np.random.default_rng(5)
    net.p["out_b"][:] = np.log(pos / (len(y) - pos))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        rate = 3e-3 * (1 - epoch / EPOCHS) + 3e-4
        for at in range(0, len(order), 32):
            step += 1
            batch = order[at:at + 32]
            for k, g in _gradients(net, [docs[i] for i in batch], y[batch]).items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def _gradients(net: Network, docs: list[list[bytes]], y: np.ndarray) -> dict[str, np.ndarray]:
    p = net.p
    parts = [c for d in docs for c in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    sizes = np.array([len(c) for c in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(sizes)
    blocks = [slice(at, at + AT_ONCE) for at in range(0, len(parts), AT_ONCE)]

    def values(block: slice):
        chunks = chunk_bytes(raw, (ends - sizes)[block], ends[block])
        return chunks, net.chunk_values(chunks, sizes[block], keep=True)

    # one block's values are kept; those of more blocks are computed again
    only = values(blocks[0]) if len(blocks) == 1 else None
    h = only[1][0] if only else np.concatenate([values(block)[1][0] for block in blocks])
    first = np.searchsorted(owner, np.arange(len(docs)))
    best, count = np.maximum.reduceat(h, first, axis=0), np.bincount(owner)[:, None]
    features = np.concatenate([best, np.add.reduceat(h, first, axis=0) / count], axis=1)
    error = ((sigmoid(features @ p["out"] + p["out_b"]) - y) / len(y)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"], g["out_b"] = features.T @ error, error.sum(keepdims=True)
    to_features = error[:, None] * p["out"][None, :]
    is_best = h == best[owner]
    dh_all = is_best * to_features[owner, :HIDDEN] + (to_features[:, HIDDEN:] / count)[owner]
    for block in blocks:
        chunks, (_, h_raw, pooled, top, z, w) = only or values(block)
        dh = (dh_all[block] * (h_raw > 0)).astype(np.float32)
        g["hidden"] += pooled.T @ dh
        g["hidden_b"] += dh.sum(axis=0)
        dtop = (dh @ p["hidden"].T)[:, :FILTERS] * (top > 0)
        g["conv_b"] += dtop.sum(axis=0)
        place = z.argmax(axis=1)
        chosen = w[np.arange(len(w))[:, None], place]  # chunk, filter, window
        g["conv"] += np.einsum("cf,cfw->wf", dtop, chosen)
        dw = (dtop[:, :, None] * p["conv"].T[None]).reshape(len(w), FILTERS, WIDTH, VECTOR)
        at = chunks[np.arange(len(w))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
        g["bytes"] += np.stack([np.bincount(at.ravel(), dw[..., j].ravel(), 257) for j in range(VECTOR)], axis=1).astype(np.float32)
    return g


def score(docs: DataFrame, network: Network, out: str = "quality", text_col: str = "text") -> DataFrame:
    """`docs` and the probability of label 1."""
    return with_block_scores(docs, text_col, out, network.scores)
