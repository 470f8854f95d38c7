"""Cutting stock by column generation over a histogram of piece widths.

The linear program has a row per width and a column per pattern; a knapsack dynamic program prices new patterns from the duals. The
fractional solution is rounded down, and what it leaves is packed by first fit decreasing over the histogram. Size and time
depend on the number of widths only, never on the number of pieces.
"""

from __future__ import annotations

import numpy as np


def _knapsack(value: np.ndarray, width: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of widths with repetition within the capacity, and how often each width is taken."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(width, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = best[c - width[:fits[c]]] + value[:fits[c]]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    taken, c = np.zeros(len(width)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            taken[pick[c]] += 1
            c -= width[pick[c]]
    return float(best[capacity]), taken


def _columns(width: np.ndarray, demand: np.ndarray, capacity: int, gap: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns) and how often each is used, fractional; every demand is met exactly."""
    fit = capacity // width
    basis, inverse, use = np.diag(fit.astype(float)), np.diag(1.0 / fit), demand / fit
    least = float(demand @ width) / capacity                  # no solution uses fewer sequences
    for _ in range(rounds):
        if use.sum() <= least * (1 + gap):
            break
        value, new = _knapsack(inverse.sum(axis=0), width, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ new
        ok = step > 1e-9
        ratio = np.where(ok, use / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        use = np.maximum(use - theta * step, 0)
        use[out] = theta
        basis[:, out] = new
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
    return basis, use


def patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """``(pieces of each width, number of sequences)`` that use every piece exactly once."""
    width = np.asarray(sorted(w for w, n in demand.items() if n), dtype=np.int64)
    if not len(width):
        return []
    left = np.asarray([demand[int(w)] for w in width], dtype=np.int64)
    basis, use = _columns(width, left.astype(float), capacity, gap, rounds)
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: np.ndarray, times: int):
        nonlocal left
        left = left - pattern * times
        out.append(({int(w): int(a) for w, a in zip(width, pattern) if a}, int(times)))

    for j in np.flatnonzero(use >= 1):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        has = pattern > 0
        times = min(int(use[j] + 1e-9), int((left[has] // pattern[has]).min()))
        if times:
            take(pattern, times)
    while left.any():
        room, pattern = capacity, np.zeros(len(width), dtype=np.int64)
        for i in range(len(width) - 1, -1, -1):
            pattern[i] = min(int(left[i]), room // int(width[i]))
            room -= int(pattern[i] * width[i])
        has = pattern > 0
        take(pattern, int((left[has] // pattern[has]).min()))
    return out
