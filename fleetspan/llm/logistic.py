"""A small ridge logistic regression for calibrating scores on bounded samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardises features, clips them to `clip` deviations and fits by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.1, clip: float = 6.0):
        weight = np.ones(len(y)) if weight is None else weight
        self.clip = clip
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6

        def loss(w: np.ndarray) -> float:
            t = z @ w
            return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (penalty * w * w).sum())

        now = loss(self.w)
        for _ in range(60):
            p = self._sigmoid(z @ self.w)
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * self.w)
            size = 1.0
            while size > 1e-6 and loss(self.w + size * step) > now:
                size /= 2
            after = loss(self.w + size * step)
            if not after < now - 1e-9:
                break
            self.w, now = self.w + size * step, after

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -self.clip, self.clip)
        return np.column_stack([np.ones(len(z)), z])

    @staticmethod
    def _sigmoid(t: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(t, -40, 40)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(x) @ self.w)
