"""Follow-the-regularised-leader (proximal) training of sparse linear models.

One implementation serves both classifiers: a model has ``k`` weight vectors
(one for a binary model), each coordinate with its own adaptive rate, an L1
penalty that keeps weights at exactly zero and an L2 penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Ftrl:
    classes: int
    dim: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0

    def __post_init__(self) -> None:
        self.z = np.zeros((self.classes, self.dim))
        self.n = np.zeros((self.classes, self.dim))
        self.bias_z = np.zeros(self.classes)
        self.bias_n = np.zeros(self.classes)

    def _solve(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._solve(self.z, self.n, self.l1), self._solve(self.bias_z, self.bias_n, 0.0)

    def step(self, idx: np.ndarray, val: np.ndarray, target: int, weight: float = 1.0) -> None:
        """One example: ``idx`` are distinct coordinates. With one weight
        vector ``target`` is 0 or 1, else it is the class number."""
        z, n = self.z[:, idx], self.n[:, idx]
        w, b = self._solve(z, n, self.l1), self._solve(self.bias_z, self.bias_n, 0.0)
        p = probabilities((w @ val + b)[None, :])[0]
        if self.classes == 1:
            error = p - target
        else:
            error = p.copy()
            error[target] -= 1.0
        error *= weight
        g = error[:, None] * val[None, :]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, idx] = z + g - sigma * w
        self.n[:, idx] = n + g * g
        sigma = (np.sqrt(self.bias_n + error * error) - np.sqrt(self.bias_n)) / self.alpha
        self.bias_z += error - sigma * b
        self.bias_n += error * error

    def fit(self, examples: list, epochs: int, seed: int) -> None:
        """``examples``: (idx, val, target, weight) each."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                self.step(*examples[i])


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Sigmoid of one column, softmax of several, row by row."""
    if logits.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
