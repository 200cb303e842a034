"""Inverse normal distribution for whole arrays."""

from __future__ import annotations

import numpy as np


def normal_quantile(p: np.ndarray, steps: int = 4) -> np.ndarray:
    """Inverse of the standard normal CDF, by a starting estimate and Newton-Halley steps."""
    import math

    p = np.asarray(p, dtype=float)
    tail = np.minimum(p, 1 - p)
    # Abramowitz and Stegun 26.2.23
    t = np.sqrt(-2 * np.log(tail))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    erfc = np.frompyfunc(math.erfc, 1, 1)
    for _ in range(steps):
        error = 0.5 * erfc(x / np.sqrt(2)).astype(float) - tail
        u = error * np.sqrt(2 * np.pi) * np.exp(x * x / 2)
        x = x + u / (1 - x * u / 2)
    return np.where(p < 0.5, -x, x)
