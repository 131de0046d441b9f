"""The binary Golay code of 23 bits: nearest codewords of many words at once.

The code is perfect: every 23-bit word lies within three errors of exactly one of
its 4,096 codewords. A word at distance three also lies at distance four of
exactly five others. Two words that differ in at most two bits always share a codeword
among those at most four errors away, so the indices of these codewords are keys under
which words with up to two errors meet.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, MESSAGE, PARITY = 23, 12, 11
#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Keys per word at most: the nearest codeword and five at distance four.
KEYS = 6


def _remainder(word: int) -> int:
    for shift in range(BITS - 1, PARITY - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - PARITY)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; error patterns of each syndrome; how many there are."""
    upper = np.array([_remainder(m << PARITY) for m in range(1 << MESSAGE)], dtype=np.int32)
    single = [_remainder(1 << b) for b in range(BITS)]
    errors = np.zeros((1 << PARITY, KEYS), dtype=np.int32)
    count = np.zeros(1 << PARITY, dtype=np.int8)
    for weight in (0, 1, 2, 3, 4):
        for bits in combinations(range(BITS), weight):
            s = e = 0
            for b in bits:
                s ^= single[b]
                e |= 1 << b
            errors[s, count[s]] = e
            count[s] += 1
    return upper, errors, count


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For an int array of 23-bit words: indices of the codewords nearby, with one more axis of
    length :data:`KEYS`, and a mask of those in use (one, or six where the nearest is three errors away)."""
    upper, errors, count = _tables()
    words = words.astype(np.int32)
    syndrome = upper[words >> PARITY] ^ (words & ((1 << PARITY) - 1))
    index = (words[..., None] ^ errors[syndrome]) >> PARITY
    return index, np.arange(KEYS) < count[syndrome][..., None]
