"""Follow-the-regularised-leader with elastic-net penalties, for small sparse training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) for ``n_classes`` rows of ``n_features`` weights.

    ``l1`` keeps weights at zero until their gradients agree, ``l2`` shrinks the others.
    """

    n_classes: int
    n_features: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((self.n_classes, self.n_features))
        self.n = np.zeros((self.n_classes, self.n_features))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> None:
        """One update by the loss's gradient (classes x features at hand)."""
        w, n = self.weights(at), self.n[:, at]
        squared = gradient * gradient
        sigma = (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha
        self.z[:, at] += gradient - sigma * w
        self.n[:, at] = n + squared


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the negative log-likelihood of held-back rows, by golden section."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
