"""Generative label model and linear classifier for weak supervision, on bounded arrays."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def correlations(votes: np.ndarray, p: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Correlation of the voters given the class: of what their votes deviate from the expected vote of the class."""
    rest = votes - (p[:, None] * hit[1] + (1 - p)[:, None] * hit[0])
    rest /= np.sqrt((rest ** 2).mean(axis=0) + 1e-9)
    return rest.T @ rest / max(len(votes), 1)


def label_model(votes: np.ndarray, prior: float, labels: np.ndarray, trust: float = 0.95, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, ``P(vote | class)`` per voter, and the correlations; by expectation maximisation.

    A voter that repeats others counts by the inverse of its total positive correlation, so ten spellings of one clue weigh as one. The given
    label is one more voter, of fixed accuracy ``trust``: it names the classes, which the votes alone could confuse with any
    other cluster, such as a large group of copies.
    """
    named = np.where(labels > 0, 1.0, -1.0) * np.log(trust / (1 - trust))
    votes, share = votes.astype(float), np.ones(votes.shape[1])
    p = sigmoid(np.log(prior / (1 - prior)) + named)
    for _ in range(rounds):
        mass = np.stack([1 - p, p])
        hit = (mass @ votes + np.array([[0.01], [0.5]])) / (mass.sum(axis=1, keepdims=True) + 1.0)
        hit = np.clip(hit, 1e-5, 1 - 1e-5)
        share = 1.0 / np.maximum(np.where((c := correlations(votes, p, hit)) > 0.1, c, 0).sum(axis=0), 1.0)
        yes, no = np.log(hit[1] / hit[0]), np.log((1 - hit[1]) / (1 - hit[0]))
        new = sigmoid(np.log(prior / (1 - prior)) + named + votes @ (share * yes) + (1 - votes) @ (share * no))
        done = np.abs(new - p).max(initial=0) < 1e-4
        p = new
        if done:
            break
    return p, hit, c


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights (last one the constant) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (p - q) - keep * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w
