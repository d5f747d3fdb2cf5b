"""How a privacy budget is split over measurements."""

from __future__ import annotations

import numpy as np


def shares(v: np.ndarray, p: np.ndarray | float, cost: float) -> np.ndarray:
    """Noise levels s of least sum(v s) among those with sum(p / s) = cost: proportional to sqrt(p / v)."""
    v = np.maximum(v, 1e-300)
    return np.sum(np.sqrt(v * p)) / cost * np.sqrt(p / v)


def level(blocks: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, cost: float, rounds: int = 20_000, gap: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Noise levels s of least largest row value among those with sum(p / s) = cost, that value, and a bound from below.

    blocks: (places, rows); a row's value is its product with s at the places.  Multiplicative weights on the rows:
    for weights y that add up to 1 no s has a largest value under the least y-mean, which ``shares`` finds.
    """
    y = [np.full(len(rows), 1.0) for _, rows in blocks]
    best, least, low = None, np.inf, 0.0
    power = 1.0
    for _ in range(rounds):
        total = sum(float(w.sum()) for w in y)
        v = np.zeros(len(p))
        for w, (at, rows) in zip(y, blocks, strict=True):
            np.add.at(v, at, w @ rows / total)
        s = shares(v, p, cost)
        values = [rows @ s[at] for at, rows in blocks]
        bound, top = float(v @ s), max(float(x.max()) for x in values)
        power = 1.0 if bound >= low else max(0.25, power * 0.5)
        low = max(low, bound)
        if top < least:
            best, least = s, top
        if least <= low * (1 + gap):
            break
        y = [np.maximum(w * (x / top) ** power, 1e-300) for w, x in zip(y, values, strict=True)]
        most = max(float(w.max()) for w in y)
        y = [w / most for w in y]
    return best, least, low
