"""Fuzzy keys from the perfect binary Golay code of length 23.

Every 23-bit word lies within 3 bits of exactly one of the 4096 codewords. The keys of a word are the
indices of all codewords within 4 bits: one, or six where the nearest is 3 bits away. Two words that
differ in at most 2 bits share a key, as some word within one bit of both lies within 3 bits of a codeword.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, DATA_BITS, CHECK_BITS = 23, 12, 11
KEY_RADIUS = 4


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each data word, and for each syndrome the error patterns of up to 4 bits (-1: none)."""
    check = np.zeros(1 << DATA_BITS, np.int64)
    for data in range(1 << DATA_BITS):
        rest = data << CHECK_BITS
        for bit in range(BITS - 1, CHECK_BITS - 1, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - CHECK_BITS)
        check[data] = rest
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(KEY_RADIUS + 1):
        for places in combinations(range(BITS), weight):
            error = sum(1 << p for p in places)
            found[int(check[error >> CHECK_BITS]) ^ error & (1 << CHECK_BITS) - 1].append(error)
    widest = max(map(len, found))
    errors = np.full((1 << CHECK_BITS, widest), -1, np.int64)
    for syndrome, patterns in enumerate(found):
        errors[syndrome, : len(patterns)] = patterns
    return check, errors


def keys(words: np.ndarray) -> np.ndarray:
    """A row of codeword indices for each word; -1 where it has fewer."""
    check, errors = tables()
    patterns = errors[check[words >> CHECK_BITS] ^ words & (1 << CHECK_BITS) - 1]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> CHECK_BITS, -1)
