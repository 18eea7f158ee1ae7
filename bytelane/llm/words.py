"""Vectorised word splitting over the byte buffers of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# A block of rows holds about this many bytes of text (one longer text is a
# block of its own), so that the arrays below, about a hundred bytes for each of
# text, stay small in every task.
BLOCK_BYTES = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def byte_class(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """True for the bytes outside the given inclusive ranges (the word bytes)."""
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = False
    return table


# words [^\x20\x09-\x0D]+
BLANK = byte_class([(0x20, 0x20), (0x09, 0x0D)])
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def give_back() -> None:
    """Return freed memory to the system: a worker is kept, beside others, for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # only glibc keeps it


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about `limit` bytes of `column`."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = text_buffer(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
    batch = sizes = None
    give_back()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`(bytes, offsets)` of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + BLOCK_BYTES // 4)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P, np.uint64))])
            _inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P_INV, np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of `prefix_hash`."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    _grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[:len(raw)], out=sums[1:])
    return sums


def split_words(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(starts, ends, first)`: byte spans of the words; text i has words `first[i]:first[i+1]`."""
    inside = word[raw]
    left = np.empty(len(raw) + 1, bool)
    left[0], left[1:] = False, inside
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    begins = inside & (~left[:-1] | cut[:-1])
    right = np.empty(len(raw), bool)
    if len(raw):
        right[:-1], right[-1] = inside[1:], False
    stops = inside & (~right | cut[1:])
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges `starts[i], starts[i]+1, ...` of `counts[i]` numbers."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - skip, counts)
