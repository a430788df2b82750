"""Regularised logistic regression on a matrix in memory, in numpy: for fits on bounded samples."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model(NamedTuple):
    """A column of weights and a bias for each output."""

    weights: np.ndarray
    bias: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights + self.bias


def fit_logistic(rows: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 150, rate: float = 0.2) -> Model:
    """One logistic model per column of `labels` (0 or 1), by full-batch Adam from zero: the same rows give the same weights.

    Both classes weigh alike. An output with one class only gets a bias that says so; no rows give weights of 0. Columns are
    scaled by their root mean square; the weights take it back.
    """
    n, width = rows.shape
    outputs = labels.shape[1]
    if not n:
        return Model(np.zeros((width, outputs)), np.zeros(outputs))
    positive = labels.sum(0)
    row_weight = np.where(labels > 0, 0.5 / np.maximum(positive, 1), 0.5 / np.maximum(n - positive, 1))
    scale = (1 / np.sqrt(np.einsum("ij,ij->j", rows, rows, dtype=np.float64) / n + 1e-6)).astype(np.float32)
    rows = rows.astype(np.float32) * scale
    w, b = np.zeros((width, outputs)), np.zeros((1, outputs))
    m, v = np.zeros((width + 1, outputs)), np.zeros((width + 1, outputs))
    for t in range(1, rounds + 1):
        error = (sigmoid(rows @ w.astype(np.float32) + b) - labels) * row_weight
        grad = np.vstack([rows.T @ error.astype(np.float32) + penalty * w, error.sum(0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = rate / np.sqrt(t) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1:]
    one_class = (positive == 0) | (positive == n)
    return Model(np.where(one_class, 0.0, w * scale[:, None]), np.where(one_class, np.where(positive > 0, 8.0, -8.0), b[0]))
