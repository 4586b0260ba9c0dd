"""The approximate confined Gaussian taper."""

from __future__ import annotations

import numpy as np

#: Width of the Gaussian in window lengths.
SIGMA = 0.14


def taper(n: int, dt: float) -> np.ndarray:
    """n weights, scaled so that dt times the sum of their squares is 1. The grid runs from 0 to n, both included."""
    grid, length = np.linspace(0, n, n), n + 1
    bell = lambda x: np.exp(-(((x - n / 2) / (2 * length * SIGMA)) ** 2))
    edge = bell(-0.5) / (bell(length - 0.5) + bell(-length - 0.5))
    weights = bell(grid) - edge * (bell(grid + length) + bell(grid - length))
    return weights / np.sqrt(np.sum(weights**2) * dt)
