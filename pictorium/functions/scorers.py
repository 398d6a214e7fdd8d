"""How alike two blocks of vectors are: (m, d) and (n, d) give (m, n). Plain NumPy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosine(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    return unit(asked) @ unit(known).T


def compared(layers: list[tuple[np.ndarray, np.ndarray]]) -> Scorer:
    """A comparing network's forward pass: the absolute difference of the two vectors through dense layers, rectified
    between them and squashed to 0..1 at the end. layers: (weights, bias) of each, the last with one output."""

    def score(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.empty((len(asked), len(known)))
        for i, row in enumerate(asked):
            x = np.abs(known - row)
            for k, (weights, bias) in enumerate(layers):
                x = x @ weights + bias
                if k + 1 < len(layers):
                    x = np.maximum(x, 0)
            out[i] = 1 / (1 + np.exp(-np.clip(x[:, 0], -500, 500)))
        return out

    return score


def class_shares(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Shares of the classes of a linear classifier, (n, classes): one against the rest, squashed, made to sum to 1."""
    out = 1 / (1 + np.exp(-np.clip(rows @ weights + bias, -500, 500)))
    return out / out.sum(axis=1, keepdims=True)
