"""Logistic curve through scores and labels."""

from __future__ import annotations

import numpy as np


def calibrate(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset, by Newton steps with softened targets as usual for separable data."""
    weights = np.ones(len(raw)) if weights is None else weights.astype(float)
    positive, rest = float(weights @ labels), float(weights @ (1 - labels))
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (rest + 2))
    slope = offset = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -60, 60)))
        w = weights * p * (1 - p)
        gradient = np.array([weights @ ((p - target) * raw) + 1e-3 * slope, weights @ (p - target)])
        hessian = np.array([[w @ (raw * raw) + 1e-3, w @ raw], [w @ raw, w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hessian, gradient), -3, 3)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)
