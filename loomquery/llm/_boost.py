"""Boosted regression trees for a bounded sample, as arrays that travel to tasks."""

from __future__ import annotations

import numpy as np

ROUNDS, DEPTH, RATE, RIDGE, CUTS = 60, 3, 0.2, 1.0, 31


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of DEPTH levels on the logistic loss of ``y`` (0 or 1) given ``x`` (rows, features); no rows give no trees.

    Each feature is cut at up to CUTS of its quantiles. All nodes of a level split at once, from sums of gradients over (node, feature, cut).
    """
    n, features = x.shape
    model = {"feature": [], "cut": [], "leaf": [], "base": -2.0}
    if not n:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for j in range(features)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: cut b - 1 < x <= cut b
    width = CUTS + 1
    flat = bins + np.arange(features) * width
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(n, np.log(rate / (1 - rate)))
    model["base"] = float(score[0])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        gradient, weight, node = y - p, p * (1 - p), np.zeros(n, dtype=np.int64)
        split, at = [], []
        for level in range(DEPTH):
            nodes = 1 << level
            where = (node[:, None] * (features * width) + flat).ravel()
            sums = [np.bincount(where, np.repeat(v, features), nodes * features * width).reshape(nodes, features, width).cumsum(axis=2) for v in (gradient, weight)]
            (g, h), (gs, hs) = sums, (s[:, :1, -1:] for s in sums)
            gain = g**2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            j, b = best // width, best % width
            split += j.tolist()
            at += [float(cuts[f][k]) if k < len(cuts[f]) else np.inf for f, k in zip(j, b)]
            node = node * 2 + (bins[np.arange(n), j[node]] > b[node])
        leaves = 1 << DEPTH
        step = RATE * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + RIDGE)
        score += step[node]
        model["feature"].append(split)
        model["cut"].append(at)
        model["leaf"].append(step.tolist())
    return {k: np.array(v) if k != "base" else v for k, v in model.items()}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    score, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for split, at, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            k = (1 << level) - 1 + node
            node = node * 2 + (x[rows, split[k]] > at[k])
        score += leaf[node]
    return score
