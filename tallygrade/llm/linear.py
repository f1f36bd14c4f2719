"""Logistic regression over hashed features, fitted on bounded samples, and its calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Pairs that are worked on at a time.
STRETCH = 1 << 18


@dataclass
class Sparse:
    """Rows of (index, value) pairs: row i has those from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def rows(self, which: np.ndarray) -> Sparse:
        begins, ends = self.starts[:-1][which], self.starts[1:][which]
        own = [slice(a, z) for a, z in zip(begins.tolist(), ends.tolist())]
        index, value = (np.concatenate([v[:0], *(v[o] for o in own)]) for v in (self.index, self.value))
        return Sparse(np.concatenate([[0], np.cumsum(ends - begins)]), index, value)

    def stretches(self) -> Iterator[tuple[int, int]]:
        """From which row to which there are about `STRETCH` pairs; a larger row stands alone."""
        at = 0
        while at < len(self.starts) - 1:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + STRETCH, "right")) - 1)
            yield at, to
            at = to

    def times(self, weights: np.ndarray) -> np.ndarray:
        out, before = np.zeros(len(self.starts) - 1), 0.0
        for at, to in self.stretches():
            here = self.starts[at : to + 1]
            sums = np.cumsum(np.concatenate([[before], weights[self.index[here[0] : here[-1]]] * self.value[here[0] : here[-1]]]))
            out[at:to] = sums[here[1:] - here[0]] - sums[here[:-1] - here[0]]
            before = sums[-1]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Sparse, y: np.ndarray, size: int, rounds: int = 60, rate: float = 0.3, shrink: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with adaptive rates; the same input gives the same weights.

    Without rows, or with one class only, the weights stay zero and the bias says the share.
    """
    w = np.zeros(size)
    weight = np.ones(len(y)) if weight is None else weight
    share = float(np.clip(np.average(y, weights=weight) if len(y) else 0.5, 1e-3, 1 - 1e-3))
    b = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return w, b
    lengths = np.diff(x.starts)
    squares, square = np.full(size, 1e-8), 1e-8
    grad, scratch = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        error = (sigmoid(x.times(w) + b) - y) * weight / weight.sum()
        grad[:] = 0
        for at, to in x.stretches():
            own = slice(int(x.starts[at]), int(x.starts[to]))
            np.add.at(grad, x.index[own], x.value[own] * np.repeat(error[at:to], lengths[at:to]))
        # in place, as a table of weights is large
        np.multiply(w, shrink, out=scratch)
        scratch /= len(y)
        grad += scratch
        np.multiply(grad, grad, out=scratch)
        squares += scratch
        grad *= rate
        np.sqrt(squares, out=scratch)
        grad /= scratch
        w -= grad
        bias = float(error.sum())
        square += bias * bias
        b -= rate * bias / np.sqrt(square)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of sigmoid(slope * z + shift) on rows that the fit has not seen, by Newton steps.

    The slope is never negative: without use in the scores it is near zero.
    """
    a, c = 1.0, 0.0
    if len(y) < 10 or y.min() == y.max():
        return a, c
    soft = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    u, a = z / scale, scale
    for _ in range(50):
        p = sigmoid(a * u + c)
        g = np.array([((p - soft) * u).sum() + 1e-3 * a, (p - soft).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(float(np.abs(step).max()), 1e-9))
        a, c = max(a - step[0], 1e-3), c - step[1]
    return a / scale, c
