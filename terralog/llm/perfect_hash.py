"""Minimal perfect hash of 64-bit keys: levels of bit arrays in which a key takes a bit that no other key of the level wants.

``n`` keys get the numbers 0..n-1 at about three bits a key; building and probing are array operations.
"""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)             # fixed values of the 64-bit finaliser
MUL1, MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * MUL1
        x = (x ^ (x >> np.uint64(27))) * MUL2
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray, gamma: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """``sizes`` of the levels in bits and the ``words`` of all levels in one array; keys are distinct."""
    sizes, words, left = [], [], np.asarray(keys, dtype=np.uint64)
    while len(left):
        size = max(64, -(-int(gamma * len(left)) // 64) * 64)
        at = mix(left, len(sizes)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size)[at.astype(np.int64)] == 1
        bits = np.zeros(size, dtype=np.uint8)
        bits[at[alone].astype(np.int64)] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone]
    return np.asarray(sizes, dtype="<u8"), np.concatenate(words) if words else np.zeros(0, dtype="<u8")


def ranks(words: np.ndarray) -> np.ndarray:
    """Set bits before each word."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])


def probe(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Number of each key, -1 where no level has it; a foreign key may get a number, so callers compare fingerprints."""
    out = np.full(len(keys), -1, dtype=np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(open_):
            break
        at = base + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        low = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[open_[hit]] = before[word[hit]] + np.bitwise_count(low)
        open_, base = open_[~hit], base + size
    return out
