"""Natural cubic regression splines in cardinal form, as a lookup table by whole months."""

from __future__ import annotations

import numpy as np


def basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """(points, knots): each column is the natural cubic spline that is 1 at one knot and 0 at the others; linear outside.

    The second derivatives at the inner knots solve a tridiagonal system in the values at the knots.
    """
    h = np.diff(knots)
    n = len(knots)
    values, curves = np.zeros((n - 2, n)), np.zeros((n - 2, n - 2))
    for i in range(n - 2):
        values[i, i : i + 3] = [1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]]
        curves[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            curves[i, i - 1] = curves[i - 1, i] = h[i] / 6
    second = np.vstack([np.zeros(n), np.linalg.solve(curves, values), np.zeros(n)])
    inside = np.clip(x, knots[0], knots[-1])
    k = np.clip(np.searchsorted(knots, inside, side="right") - 1, 0, n - 2)
    step, left, right = h[k][:, None], (knots[k + 1] - inside)[:, None], (inside - knots[k])[:, None]
    unit = np.eye(n)
    out = (left * unit[k] + right * unit[k + 1]) / step
    out += ((left**3 / step - step * left) * second[k] + (right**3 / step - step * right) * second[k + 1]) / 6
    slope_low = (unit[1] - unit[0]) / h[0] - h[0] / 6 * second[1]
    slope_high = (unit[-1] - unit[-2]) / h[-1] + h[-1] / 6 * second[-2]
    return out + np.minimum(x - knots[0], 0)[:, None] * slope_low + np.maximum(x - knots[-1], 0)[:, None] * slope_high


def month_table(edges: tuple[int, ...], last: int) -> tuple[list[str], list[tuple]]:
    """Column names and rows (months_on_book, basis...) for months 0 to last."""
    knots = np.array([0, *[e for e in edges if 0 < e < last], last], float)
    table = basis(np.arange(last + 1, dtype=float), knots)
    return ["months_on_book", *[f"mob_{i}" for i in range(len(knots))]], [(m, *map(float, row)) for m, row in enumerate(table)]
