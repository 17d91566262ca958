"""Hashed features and a logistic regression on a bounded sample, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, most: int, key: Column) -> DataFrame:
    """About ``most`` rows at most, taken by a hash of ``key``; the same rows each time."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * most / n))


class Sparse:
    """Rows of feature numbers, each with weight 1 or a value; small integers, as the driver holds them."""

    def __init__(self, rows: list, bins: int):
        lens = np.array([len(r) for r in rows], np.int64)
        self._set(np.concatenate([np.asarray(r, np.int32) for r in rows]) if len(rows) else np.empty(0, np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), lens), len(rows), bins)

    def _set(self, at: np.ndarray, row: np.ndarray, n: int, bins: int, value: np.ndarray | None = None) -> None:
        self.at, self.row, self.n, self.bins = at, row, n, bins
        self.value = np.ones(len(at), np.float32) if value is None else value

    @classmethod
    def differences(cls, gone: np.ndarray, come: np.ndarray, bins: int) -> Sparse:
        """Rows of two features each, one taken away (the score loses it) and one brought."""
        out = object.__new__(cls)
        out._set(np.stack([gone, come], axis=1).reshape(-1).astype(np.int32), np.repeat(np.arange(len(gone), dtype=np.int32), 2), len(gone), bins, np.tile(np.array([1, -1], np.float32), len(gone)))
        return out

    def only(self, keep: np.ndarray) -> Sparse:
        """Without the features that ``keep`` excludes."""
        out, at = object.__new__(Sparse), keep[self.at]
        out._set(self.at[at], self.row[at], self.n, self.bins, self.value[at])
        return out

    def frequent(self, least: int) -> Sparse:
        """Without the features in fewer than ``least`` rows."""
        return self.only(np.bincount(self.at, minlength=self.bins) >= least)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], minlength=self.bins)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, difference: Sparse | None = None, penalty: float = 0.0, screen: float = 4.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps.

    ``difference``: rows of feature changes; ``penalty`` times the mean square of the score change they make is added
    to the loss. Features whose score test against the labels is under ``screen`` standard errors get no weight.
    Returns weights and bias.
    """
    w, bias = np.zeros(x.bins), 0.0
    if not x.n or len(np.unique(y)) < 2:
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return w, float(np.log(rate / (1 - rate)))
    s = np.ones(x.n) if weight is None else weight
    total = s.sum()
    first, second, m_b, v_b = np.zeros(x.bins), np.zeros(x.bins), 0.0, 0.0
    rate = np.clip((s @ y) / total, 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    error = np.sqrt(np.bincount(x.at, (x.value * s[x.row]) ** 2, minlength=x.bins) * rate * (1 - rate))
    x = x.only(np.abs(x.back(s * (y - rate))) > screen * error)
    for t in range(1, steps + 1):
        r = s * (sigmoid(x.times(w) + bias) - y) / total
        g, gb = x.back(r) + l2 / total * w, r.sum()
        if difference is not None and difference.n:
            g = g + 2 * penalty / difference.n * difference.back(difference.times(w))
        step = 0.1 / (1 + 3 * t / steps)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.99 * v_b + 0.01 * gb * gb
        w = w - step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        bias -= step * (m_b / (1 - 0.9**t)) / (np.sqrt(v_b / (1 - 0.99**t)) + 1e-6)
    return w, float(bias)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients [columns + 1] of a logistic regression of y on the columns of z, by Newton steps."""
    a = np.column_stack([z, np.ones(len(z))])
    c = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ c)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, a.T @ (p - y) + 1e-2 * c)
        c = c - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return c
