"""Golay(23, 12) code: nearby codeword indices of 23-bit words.

The code is perfect: every word lies within distance 3 of exactly one
codeword. Words at distance 3 from theirs also get the five codewords at
distance 4. Any two words that differ in at most two bits then share an index
(`tests/llm` checks all of them).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
MAX_KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(N - 1, N - K - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (N - K))
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    single = [_remainder(1 << i) for i in range(N)]
    syndrome = np.zeros((3, 256), np.uint16)
    for byte in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and byte * 8 + i < N:
                    syndrome[byte, value] ^= single[byte * 8 + i]
    patterns = np.zeros((1 << (N - K), MAX_KEYS), np.int32)
    counts = np.zeros(1 << (N - K), np.int8)
    weights = np.full(1 << (N - K), 9, np.int8)
    for weight in range(5):
        for bits in combinations(range(N), weight):
            s = 0
            for i in bits:
                s ^= single[i]
            # weight 4 only beside a leader of weight 3
            if weight == 4 and weights[s] != 3:
                continue
            weights[s] = min(weights[s], weight)
            patterns[s, counts[s]] = sum(1 << i for i in bits)
            counts[s] += 1
    return syndrome, patterns, counts


SYNDROME, PATTERNS, COUNTS = _tables()


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(index, source)`: codeword indices near each word, and the word's position."""
    w = words.astype(np.int32)
    s = SYNDROME[0, w & 255] ^ SYNDROME[1, w >> 8 & 255] ^ SYNDROME[2, w >> 16 & 255]
    n = COUNTS[s].astype(np.int64)
    source = np.repeat(np.arange(len(w)), n)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
    codeword = w[source] ^ PATTERNS[s[source], nth]
    return codeword >> (N - K), source
