"""Follow-the-regularised-leader (proximal) for logistic and multinomial regression, on sparse rows in numpy."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate rates; l1 makes weights sparse, l2 shrinks them. classes = 1: logistic; more: softmax."""

    def __init__(self, dims: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.free = np.zeros(dims, bool)  # coordinates without penalty, such as the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(self.free[at], 0.0, self.l1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> None:
        """One row: coordinates (distinct), values, the wanted probability of each class, and what the row counts."""
        w = self.weights(at)
        p = predict(x @ w)
        g = weight * x[:, None] * (p - y)[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def predict(scores: np.ndarray) -> np.ndarray:
    """Probabilities from scores, along the last axis; one score is a logit."""
    scores = np.clip(scores, -500, 500)
    if scores.shape[-1] == 1:
        return 1 / (1 + np.exp(-scores))
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
