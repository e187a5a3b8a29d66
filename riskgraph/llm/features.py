"""Hashed sparse features and a linear scorer, fitted on the driver over a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Linear:
    """sigmoid(bias + sum of weights over a document's features), weights in 2**bits hashed places."""

    weights: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, place: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        z = self.bias + np.bincount(doc, self.weights[place] * value, docs)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(doc: np.ndarray, place: np.ndarray, value: np.ndarray, target: np.ndarray, size: int, weight: np.ndarray | None = None, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Linear:
    """Logistic regression with soft targets in [0, 1], full-batch Adagrad. Without documents: a zero scorer."""
    n = len(target)
    w, b = np.zeros(size), 0.0
    if not n:
        return Linear(w, b)
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    sums, sum_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(doc, w[place] * value, n)
        err = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        g = np.bincount(place, err[doc] * value, size) + decay * w
        sums += g * g
        w -= rate * g / np.sqrt(sums)
        sum_b += err.sum() ** 2
        b -= rate * err.sum() / np.sqrt(sum_b)
    return Linear(w, float(b))
