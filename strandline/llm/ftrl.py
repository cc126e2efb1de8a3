"""Follow-the-regularised-leader (proximal) training of sparse linear models in numpy, on a sample of bounded size."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression with elastic-net penalties; with one output, binary logistic regression.

    ``fit`` takes (indices, values) pairs of sparse rows; a constant feature at ``dim`` is the intercept, which bears no penalty.
    """

    def __init__(self, dim: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.dim, self.outputs, self.alpha, self.beta, self.l1, self.l2 = dim, outputs, alpha, beta, l1, l2
        self.z = np.zeros((dim + 1, outputs))
        self.n = np.zeros((dim + 1, outputs))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                at, x = np.append(rows[r][0], self.dim), np.append(rows[r][1], 1.0)
                w = self.weights(at)
                s = x @ w
                if self.outputs == 1:
                    error = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - labels[r]
                else:
                    error = softmax(s)
                    error[labels[r]] -= 1
                g = x[:, None] * error
                n = self.n[at]
                grown = n + g * g
                self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[at] = grown
        return self.weights()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature among a grid that makes the labels of rows not trained on likeliest; 1.0 without rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
