"""Follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class FTRL:
    """Weights of shape ``shape``; ``step`` takes gradients at rows ``at`` only."""

    def __init__(self, shape: tuple[int, ...], *, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at, grad: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        grown = n + grad * grad
        self.z[at] += grad - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
