"""Small linear models for bounded samples, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sparse:
    """Rows of (feature, value) pairs: row i holds ``index[start[i]:start[i + 1]]``."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        start = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        if not rows:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.float32), start)
        return cls(np.concatenate([i for i, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]).astype(np.float32), start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows(), self.value * w[self.index], len(self))

    def pick(self, chosen: np.ndarray) -> Sparse:
        n = np.diff(self.start)[chosen]
        start = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        at = np.repeat(self.start[:-1][chosen] - start[:-1], n) + np.arange(start[-1])
        return Sparse(self.index[at], self.value[at], start)


def fit_logistic(x: Sparse, y: np.ndarray, dim: int, extra: np.ndarray | None = None, l2: float = 1e-3, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with both classes weighing the same: (weights, weights of ``extra`` columns, bias).

    Full-batch Adam from zero, so the same rows give the same model.
    """
    extra = np.zeros((len(y), 0)) if extra is None else extra
    k, rows = extra.shape[1], x.rows()
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(dim + k + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(rows, x.value * w[x.index], len(y)) + extra @ w[dim : dim + k] + w[-1]
        g = (sigmoid(z) - y) * weight
        grad = np.empty_like(w)
        grad[:dim] = np.bincount(x.index, x.value * g[rows], dim) + l2 * w[:dim]
        grad[dim : dim + k] = extra.T @ g + l2 * w[dim : dim + k]
        grad[-1] = g.sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
    return w[:dim], w[dim : dim + k], float(w[-1])


def platt(score: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities (Newton steps on smoothed targets)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * score * score).sum() + 1e-6, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * score).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
