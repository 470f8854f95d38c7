"""Lockstep merging of two tokenisations of the same bytes: one state vector advances the pointers of every lane at once."""

from __future__ import annotations

import numpy as np

LANE_BYTES = 256                   # documents are split into lanes of so many bytes, so that no lane is much longer than another


def lanes(sizes: np.ndarray, lane_bytes: int = LANE_BYTES) -> np.ndarray:
    """Byte offsets at which lanes begin, over documents of ``sizes`` bytes that follow one another, and the end of the last."""
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // lane_bytes)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(starts, parts) + inner * lane_bytes, sizes.sum())


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends at the same byte, -1 if none; both lists of ends ascend strictly.

    A lane owns the tokens that end after its first byte offset and not after the next lane's. Each step compares the two tokens under the pointers of
    every lane, notes those that end together, and moves the pointer that is behind (both, where they end together); finished lanes are taken out.
    """
    partner = np.full(len(ends_a), -1, dtype=np.int64)
    at_a, at_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
    i, stop_a, j, stop_b = at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]
    live = (i < stop_a) & (j < stop_b)
    i, j, stop_a, stop_b = i[live], j[live], stop_a[live], stop_b[live]
    while len(i):
        a, b = ends_a[i], ends_b[j]
        same = a == b
        partner[i[same]] = j[same]
        i, j = i + (a <= b), j + (b <= a)
        live = (i < stop_a) & (j < stop_b)
        if not live.all():
            i, j, stop_a, stop_b = i[live], j[live], stop_a[live], stop_b[live]
    return partner


class Decimals:
    """Decimal texts of ids below ``size`` as rows of bytes, padded by zeros, with room for one sign."""

    def __init__(self, size: int):
        width = len(str(size))
        ids, self.rows, self.digits = np.arange(size), np.zeros((size, width + 1), dtype=np.uint8), np.ones(size, dtype=np.int64)
        for k in range(1, width):
            self.digits += ids >= 10 ** k
        for k in range(width):
            on = self.digits > k
            self.rows[on, k] = 48 + ids[on] // 10 ** (self.digits[on] - 1 - k) % 10

    def text(self, ids: np.ndarray, signs: np.ndarray) -> bytes:
        """Each id followed by its sign."""
        out = self.rows[ids]
        out[np.arange(len(ids)), self.digits[ids]] = signs
        return out[out != 0].tobytes()


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, decimals: Decimals) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the groups of a document from its ids and the numbers of A and B tokens in each group."""
    if not len(a_sizes):
        return b""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_at = np.arange(len(a_ids)) + np.repeat(b_end - b_sizes, a_sizes)
    b_at = np.arange(len(b_ids)) + np.repeat(a_end, b_sizes)
    ids, signs = np.empty(len(a_ids) + len(b_ids), dtype=np.int64), np.full(len(a_ids) + len(b_ids), ord(","), dtype=np.uint8)
    ids[a_at], ids[b_at] = a_ids, b_ids
    signs[a_at[a_end - 1]], signs[b_at[b_end - 1]] = ord("|"), ord(";")
    return decimals.text(ids, signs)[:-1]
