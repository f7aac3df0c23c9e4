"""Logistic calibration on a few features of a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> dict:
    """Newton's method on standardised features; works with one class or no rows (then the rate, smoothed, is the score)."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    width = x.shape[1]
    span = (x.min(0), x.max(0)) if len(x) else (np.full(width, -np.inf), np.full(width, np.inf))
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(width), "b": float(np.log(rate / (1 - rate))), "span": span}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(y), 1))])
    w = np.zeros(width + 1)
    penalty = ridge * np.eye(width + 1)
    penalty[-1, -1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": float(w[-1]), "span": span}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities; features beyond what the fit saw count as its extremes, so nothing is extrapolated."""
    x = np.clip(np.asarray(x, dtype=float).reshape(len(x), len(model["w"])), *model["span"])
    return 1 / (1 + np.exp(-np.clip(((x - model["mean"]) / model["scale"]) @ model["w"] + model["b"], -30, 30)))
