"""Logistic fits on the driver, over a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_binary_features(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, values: np.ndarray, l2: float, epochs: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows: entry (rows[k], cols[k]) has the value values[cols[k]].  Classes weigh alike."""
    n, d = len(y), len(values)
    w, b, adam = np.zeros(d), 0.0, Adam(d + 1, 0.05)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(epochs):
        z = np.bincount(rows, weights=(w * values)[cols], minlength=n) + b
        r = weight * (sigmoid(z) - y)
        g = np.bincount(cols, weights=r[rows], minlength=d) * values + l2 * w
        step = adam.step(np.append(g, r.sum()))
        w -= step[:-1]
        b -= step[-1]
    return w * values, b
