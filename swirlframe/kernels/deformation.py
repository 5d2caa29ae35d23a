"""Cubic splines, image deformation, and bilinear evaluation of vector fields."""

from __future__ import annotations

import numpy as np

#: Pixels resampled at once.
BLOCK = 32_768


def _prefilter(f: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along axis 0 (n + 2 of them), the second derivative vanishing at both ends."""
    n = len(f)
    if n == 1:
        return np.concatenate([f, f, f])
    c = np.empty((n + 2, *f.shape[1:]), float)
    c[1], c[n] = f[0], f[-1]  # at an end, c0 - 2 c1 + c2 = 0 makes (c0 + 4 c1 + c2) / 6 = c1
    if n > 2:
        d = 6.0 * f[1:-1].astype(float)
        d[0] -= c[1]
        d[-1] -= c[n]
        m = n - 2
        ratio = np.empty(m)
        ratio[0] = 0.25
        d[0] /= 4
        for i in range(1, m):
            ratio[i] = 1 / (4 - ratio[i - 1])
            d[i] = (d[i] - d[i - 1]) * ratio[i]
        for i in range(m - 2, -1, -1):
            d[i] -= ratio[i] * d[i + 1]
        c[2:n] = d
    c[0] = 2 * c[1] - c[2]
    c[n + 1] = 2 * c[n] - c[n - 1]
    return c


class Spline:
    """Interpolating cubic spline of an image; zero outside."""

    def __init__(self, image: np.ndarray) -> None:
        self.shape = image.shape
        self.c = _prefilter(_prefilter(np.asarray(image, float)).T).T

    def __call__(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if rows.ndim == 2 and rows.size > BLOCK:  # a few rows at a time, so that what is in between stays in the cache
            step = max(1, BLOCK // rows.shape[1])
            return np.concatenate([self(rows[i : i + step], cols[i : i + step]) for i in range(0, len(rows), step)])
        nr, nc = self.shape
        r, c = np.clip(rows, 0, nr - 1), np.clip(cols, 0, nc - 1)
        inside = (r == rows) & (c == cols)
        r, c = np.where(inside, r, 0.0), np.where(inside, c, 0.0)
        i, j = np.minimum(r.astype(np.int64), max(nr - 2, 0)), np.minimum(c.astype(np.int64), max(nc - 2, 0))
        wr, wc = self._weights(r - i), self._weights(c - j)
        flat, width = self.c.reshape(-1), self.c.shape[1]
        base = i * width + j
        out = np.zeros(rows.shape)
        for a in range(4):
            line = wc[0] * flat.take(base)
            for b in range(1, 4):
                line += wc[b] * flat.take(base + b)
            out += wr[a] * line
            base += width
        return np.where(inside, out, 0.0)

    @staticmethod
    def _weights(d: np.ndarray) -> tuple[np.ndarray, ...]:
        e, d2, d3 = 1 - d, d * d, d * d * d
        return e * e * e / 6, (4 - 6 * d2 + 3 * d3) / 6, (1 + 3 * d + 3 * d2 - 3 * d3) / 6, d3 / 6


def _cell(axis: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the cell and the share within it, held at the ends."""
    if len(axis) == 1:
        return np.zeros(np.shape(at), int), np.zeros(np.shape(at))
    i = np.clip(np.searchsorted(axis, at, side="right") - 1, 0, len(axis) - 2)
    return i, np.clip((at - axis[i]) / (axis[i + 1] - axis[i]), 0.0, 1.0)


def field_at(x: np.ndarray, y: np.ndarray, f: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Bilinear values of f (rows y, columns x) on the grid at_y x at_x, held beyond the ends."""
    i, p = _cell(y, at_y)
    j, q = _cell(x, at_x)
    rows = f[i] * (1 - p)[:, None] + f[np.minimum(i + 1, len(y) - 1)] * p[:, None]
    return rows[:, j] * (1 - q) + rows[:, np.minimum(j + 1, len(x) - 1)] * q


def deform(a: Spline, b: Spline, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both images moved half the field each, towards each other. x and y are 1-based."""
    nr, nc = a.shape
    at_x, at_y = np.arange(1.0, nc + 1), np.arange(1.0, nr + 1)
    du, dv = field_at(x, y, u, at_x, at_y) / 2, field_at(x, y, v, at_x, at_y) / 2
    rows, cols = np.mgrid[0:nr, 0:nc].astype(float)
    return a(rows - dv, cols - du), b(rows + dv, cols + du)


def warp_image(image: np.ndarray, matrix: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Bilinear resampling at matrix @ (x, y) + offset (1-based), zero outside."""
    nr, nc = image.shape
    y, x = np.mgrid[1 : nr + 1, 1 : nc + 1].astype(float)
    sx = matrix[0, 0] * x + matrix[0, 1] * y + offset[0] - 1
    sy = matrix[1, 0] * x + matrix[1, 1] * y + offset[1] - 1
    inside = (sx >= 0) & (sx <= nc - 1) & (sy >= 0) & (sy <= nr - 1)
    i, j = np.clip(sy.astype(int), 0, max(nr - 2, 0)), np.clip(sx.astype(int), 0, max(nc - 2, 0))
    p, q = sy - i, sx - j
    i1, j1 = np.minimum(i + 1, nr - 1), np.minimum(j + 1, nc - 1)
    out = (image[i, j] * (1 - q) + image[i, j1] * q) * (1 - p) + (image[i1, j] * (1 - q) + image[i1, j1] * q) * p
    return np.where(inside, out, 0.0)


def registration(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares (matrix, offset) that takes source points to target points; three or more, not on a line."""
    if len(source) < 3 or len(source) != len(target):
        raise ValueError("a registration takes three pairs of points or more")
    design = np.column_stack([source, np.ones(len(source))])
    if np.linalg.matrix_rank(design) < 3:
        raise ValueError("the points are on a line")
    got, *_ = np.linalg.lstsq(design, target, rcond=None)
    return got[:2].T, got[2]
