"""Batched Viterbi segmentation over a piece vocabulary: equal-length words advance together, one array step per end and piece length."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x100000001B3)        # odd, so that powers of it are invertible
UNKNOWN_PENALTY = 10.0                 # fixed value: below the least score of a piece
CELLS = 1 << 20                        # characters of the words that advance together


def code_points(words: list[str]) -> np.ndarray:
    """One row per word; the words are equally long."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)


def prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix, modulo 2^64."""
    out = np.zeros((len(chars), chars.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(chars.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + chars[:, j] + np.uint64(1)
    return out


class PieceTable:
    """Pieces by length, with sorted hashes to probe."""

    def __init__(self, pieces: list[str], ids: list[int], scores: list[float]):
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for n, at in by.items():
            keys = prefix_hashes(code_points([pieces[i] for i in at]))[:, n]
            order = np.argsort(keys)
            if len(keys) != len(set(keys.tolist())):
                raise ValueError("two pieces share a hash: choose another base")
            self.keys[n] = keys[order], np.asarray([ids[i] for i in at])[order], np.asarray([scores[i] for i in at], dtype=float)[order]
        self.lengths = sorted(by, reverse=True)
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.power = np.ones(max(by) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, len(self.power)):
                self.power[n] = self.power[n - 1] * BASE

    def probe(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and score of each substring of length ``n``; -1 and minus infinity where it is no piece."""
        keys, ids, scores = self.keys[n]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        return np.where(hit, ids[at], -1), np.where(hit, scores[at], -np.inf)

    def segment(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """``(id, length)`` of the pieces of each word, -1 for an unknown character; equal scores prefer the longer last piece."""
        out: list[list[tuple[int, int]]] = [[] for _ in words]
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, at in by.items():
            step = max(1, CELLS // max(length, 1))
            for k in range(0, len(at) if length else 0, step):
                for i, pieces in zip(at[k:k + step], self._advance([words[i] for i in at[k:k + step]])):
                    out[i] = pieces
        return out

    def _advance(self, words: list[str]) -> list[list[tuple[int, int]]]:
        chars = code_points(words)
        n, length = chars.shape
        prefix = prefix_hashes(chars)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        piece, back = np.full((length + 1, n), -1, dtype=np.int64), np.ones((length + 1, n), dtype=np.int64)
        for j in range(1, length + 1):
            for k in self.lengths:
                if k > j:
                    continue
                with np.errstate(over="ignore"):
                    ids, scores = self.probe(k, prefix[:, j] - prefix[:, j - k] * self.power[k])
                if k == 1:
                    scores = np.where(ids < 0, self.unknown, scores)
                total = best[j - k] + scores
                better = total > best[j]
                best[j], piece[j], back[j] = np.where(better, total, best[j]), np.where(better, ids, piece[j]), np.where(better, k, back[j])
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            for i, p, k in zip(rows.tolist(), piece[at[rows], rows].tolist(), back[at[rows], rows].tolist()):
                out[i].append((p, k))
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [x[::-1] for x in out]
