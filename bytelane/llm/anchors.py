"""Anchors: a sparse choice of places that equal windows share.

A window of `window` units (bytes or words) holds `window - gram + 1` grams;
the leftmost gram with the least hash is its anchor. Equal windows have their
anchors at equal offsets, and neighbouring windows mostly share theirs, so an
anchor owns a stretch of window starts (about one anchor in
`(window - gram + 2) / 2` units). Whatever is repeated is found by looking at
anchors only; nothing is sampled, every window has an anchor.

`shared_grams` finds the anchors whose gram occurs in more than one place. It
is a candidate search: unequal windows may pass it, equal ones always do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.words import BLANK, mix, prefix_hash, span_hashes, split_words, text_blocks, text_buffer

NO_ID = -(1 << 63)  # stands for a null id among the candidates
ANCHORS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 12
BLOCK = 4 << 20  # bytes of text looked at together: repeats inside a block need no exchange
ANSWERED = 1 << 20  # shared hashes that a task remembers, at most


@dataclass
class Units:
    """A block of texts as units."""

    raw: np.ndarray  # bytes of the block
    starts: np.ndarray | None  # byte spans of the units; None: units are bytes
    ends: np.ndarray | None
    bounds: np.ndarray  # text i has units bounds[i]:bounds[i + 1]
    grams: np.ndarray  # hash of the gram at each place
    words: np.ndarray | None = None  # hash of each word


@dataclass
class Stretches:
    text: np.ndarray  # text of the block
    anchor: np.ndarray  # place of the anchor in the block's units
    first: np.ndarray  # first and last window start owned
    last: np.ndarray
    gram: np.ndarray  # hash of the anchor's gram


def byte_units(texts: pa.Array, gram: int) -> Units:
    raw, bounds = text_buffer(texts)
    n = max(len(raw) - gram + 1, 0)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, gram, 8):
            part = np.ndarray((n,), "<u8", padded, at, (1,)) if n else h
            if gram - at < 8:
                part = part & np.uint64((1 << 8 * (gram - at)) - 1)
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return Units(raw, None, None, bounds, mix(h))


def word_units(texts: pa.Array, gram: int) -> Units:
    raw, offsets = text_buffer(texts)
    starts, ends, bounds = split_words(raw, offsets, BLANK)
    h = span_hashes(prefix_hash(raw), starts, ends)
    n = max(len(h) - gram + 1, 0)
    g = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(gram):
            g = (g ^ h[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    return Units(raw, starts, ends, bounds, mix(g), h)


def stretches(units: Units, window: int, gram: int) -> Stretches:
    """The anchors of all windows that lie inside one text, with the window starts they own."""
    per = window - gram + 1
    n = len(units.grams) - per + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Stretches(none, none, none, none, np.zeros(0, np.uint64))
    # hash above, place below: the least is the leftmost of equal hashes
    key = (units.grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(units.grams), dtype=np.uint64)
    span = 1
    while span * 2 <= per:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = per - span
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n, bool)
    for a, b in zip(units.bounds[:-1].tolist(), units.bounds[1:].tolist(), strict=True):
        if b - a >= window:
            inside[a:b - window + 1] = True
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(inside & new)
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(inside & stop)
    a = anchor[first]
    return Stretches(np.searchsorted(units.bounds, first, "right") - 1, a, first, last, units.grams[a])


def shared_grams(docs: DataFrame, cut: Callable[[pa.Array, int], Units], window: int, gram: int, units: int, distinct_ids: bool) -> DataFrame:
    """`(id, grams)` for the ids of `docs (id, text)` whose anchors' grams occur elsewhere too.

    `distinct_ids`: only under another id; otherwise at any other place. Hashes
    travel packed, in buckets that grow in number with the corpus (`units`).
    Within a block a gram that is shared already answers for itself: all its
    places are known, and only two or three of them go on to the bucket of the
    hash as witnesses for other blocks, once a task. Known places need no
    comparison; they go to buckets by their id. So a gram that fills a third of
    the corpus costs its bucket a few entries a task.
    """
    buckets = max(MIN_BUCKETS, 2 * units // ((window - gram + 2) * ANCHORS_PER_BUCKET) + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answered = np.zeros(0, np.uint64)
        for block in text_blocks(batches, "text", BLOCK):
            ids = block.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            s = stretches(cut(block.column("text"), gram), window, gram)
            known, own, h = _in_block(ids[s.text], s.gram, distinct_ids, answered)
            if len(answered) < ANSWERED:
                answered = np.union1d(answered, h[known])[:ANSWERED]
            place = np.where(known, mix(own.view(np.uint64)), h)
            bucket = (place >> np.uint64(40)).astype(np.int64) % buckets
            for flag in (True, False):
                picked = np.flatnonzero(known == flag)
                order = picked[np.lexsort((own[picked], bucket[picked]))]
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.unique(bucket[order]).tolist():
                    rows = order[at[b]:at[b + 1]]
                    yield _packed(b, flag, own[rows], h[rows])

    def resolve(key, table):
        flags = table.column("known").to_numpy(zero_copy_only=False)
        ids = table.column("ids").to_pylist()
        counts = table.column("counts").to_pylist()
        blobs = table.column("hashes").to_pylist()

        def joined(which: bool) -> tuple[np.ndarray, np.ndarray]:
            rows = [i for i in range(len(flags)) if flags[i] == which]
            own = [np.repeat(np.array(ids[i], np.int64), np.array(counts[i], np.int64)) for i in rows]
            return (np.concatenate(own) if rows else np.zeros(0, np.int64),
                    np.frombuffer(b"".join([blobs[i] for i in rows]), np.uint64))

        own, h = joined(False)
        shared = _shared(own, h, distinct_ids)
        known_own, known_h = joined(True)
        own, h = np.concatenate([own[shared], known_own]), np.concatenate([h[shared], known_h])
        order = np.lexsort((h, own))
        own, h = own[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), pa.array(h.view(np.int64)))
        return pa.table({"id": pa.array(own[first]), "grams": lists})

    packed = docs.select("id", "text").mapInArrow(emit, "bucket int, known boolean, ids array<long>, counts array<int>, hashes binary")
    found = packed.groupBy("bucket").applyInArrow(resolve, "id long, grams array<long>")
    return found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))


def _shared(own: np.ndarray, h: np.ndarray, distinct_ids: bool) -> np.ndarray:
    """True for the entries whose hash occurs again (under another id)."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    hs, ids = h[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    counts = np.diff(np.append(first, len(hs)))
    good = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if distinct_ids else counts > 1
    out = np.empty(len(h), bool)
    out[order] = np.repeat(good, counts)
    return out


def _in_block(own: np.ndarray, h: np.ndarray, distinct_ids: bool, answered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries `(known, id, hash)` of a block: answers, and what other blocks have to see.

    `answered`: sorted hashes that are shared, and whose witnesses have been sent.
    """
    before = answered[np.minimum(np.searchsorted(answered, h), len(answered) - 1)] == h if len(answered) else np.zeros(len(h), bool)
    shared = before | _shared(own, h, distinct_ids)
    alone = np.unique(np.stack([own[~shared], h[~shared].view(np.int64)], axis=1), axis=0) if distinct_ids else np.stack([own[~shared], h[~shared].view(np.int64)], axis=1)
    both = np.unique(np.stack([h[shared].view(np.int64), own[shared]], axis=1), axis=0)
    # the least and the largest id of each hash that is shared from this block on
    news = shared & ~before
    fresh = np.unique(np.stack([h[news].view(np.int64), own[news]], axis=1), axis=0) if before.any() else both
    new = fresh[1:, 0] != fresh[:-1, 0]
    ends = fresh[np.concatenate([[True], new]) | np.concatenate([new, [True]])] if len(fresh) else fresh
    if not distinct_ids and len(ends):
        ends = np.concatenate([ends, ends[np.concatenate([[True], ends[1:, 0] != ends[:-1, 0]])]])
    known = np.concatenate([np.zeros(len(alone) + len(ends), bool), np.ones(len(both), bool)])
    return known, np.concatenate([alone[:, 0], ends[:, 1], both[:, 1]]), np.concatenate([alone[:, 1], ends[:, 0], both[:, 0]]).view(np.uint64)


def _packed(bucket: int, known: bool, own: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([known]), pa.array([own[first]], pa.list_(pa.int64())),
         pa.array([np.diff(np.append(first, len(own)))], pa.list_(pa.int32())), pa.array([h.tobytes()], pa.binary())],
        names=["bucket", "known", "ids", "counts", "hashes"])


def candidate_stretches(s: Stretches, grams: list) -> np.ndarray:
    """True for the stretches whose anchor's gram is in its text's list."""
    sizes = np.array([len(g) for g in grams], np.int64)
    wanted = np.unique(np.concatenate([np.asarray(g, np.int64) for g in grams])) if sizes.sum() else np.zeros(0, np.int64)
    at = np.searchsorted(wanted, s.gram.view(np.int64))
    at[at == len(wanted)] = 0
    return wanted[at] == s.gram.view(np.int64) if len(wanted) else np.zeros(len(s.gram), bool)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal spans, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
