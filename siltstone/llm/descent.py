"""Limited-memory BFGS, to a stated norm of the gradient."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The largest component of the gradient at which a fit is done, and the most steps.
TOLERANCE, MOST_STEPS = 1e-4, 300
_MEMORY = 10


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(x, largest component of the gradient there) from f: x -> (value, gradient); deterministic.

    Ends at the tolerance, or where no step along the gradient lowers the value any more.
    """
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.abs(g).max() <= tolerance:
            break
        d, scale = -g, []
        for s, y in reversed(steps):
            scale.append((s @ d) / (s @ y))
            d = d - scale[-1] * y
        d = d * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(g))))
        for (s, y), a in zip(steps, reversed(scale), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        size, slope = 1.0, float(g @ d)
        while True:
            to = x + size * d
            v, h = f(to)
            if v <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        if v >= value:
            if not steps:
                break
            steps = []  # start again along the gradient
            continue
        if (to - x) @ (h - g) > 1e-14:
            steps = [*steps[1 - _MEMORY :], (to - x, h - g)]
        x, value, g = to, v, h
    return x, float(np.abs(g).max())
