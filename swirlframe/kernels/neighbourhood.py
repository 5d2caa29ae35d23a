"""Outliers, replacement and smoothing on grids (rows, columns), vectorised over the neighbours' offsets."""

from __future__ import annotations

import warnings

import numpy as np


def _stack(f: np.ndarray, radius: int, centre: bool = False) -> np.ndarray:
    """Neighbours of each cell within a square, NaN beyond the grid."""
    p = np.pad(f.astype(float), radius, constant_values=np.nan)
    nr, nc = f.shape
    d = range(2 * radius + 1)
    return np.stack([p[i : i + nr, j : j + nc] for i in d for j in d if centre or (i, j) != (radius, radius)])


def _median(stack: np.ndarray) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanmedian(stack, axis=0)


def outliers(u: np.ndarray, v: np.ndarray, threshold: float = 2.0, radius: int = 1, epsilon: float = 0.1, exclude: np.ndarray | None = None) -> np.ndarray:
    """Normalised median test on both components; excluded cells are neither tested nor used, and NaN isn't flagged."""
    out = np.zeros(u.shape, bool)
    for f in (u, v):
        near = _stack(np.where(exclude, np.nan, f) if exclude is not None else f, radius)
        med = _median(near)
        spread = _median(np.abs(near - med))
        with np.errstate(invalid="ignore"):
            out |= np.abs(f - med) / (spread + epsilon) > threshold
    return out & ~exclude if exclude is not None else out


def replace(u: np.ndarray, v: np.ndarray, invalid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Invalid cells get the median of the valid ones in the smallest square that holds three; else they stay."""
    u2, v2, todo = u.copy(), v.copy(), invalid.copy()
    for radius in range(1, max(u.shape)):
        if not todo.any():
            break
        rows, cols = np.nonzero(todo)
        for r, c in zip(rows, cols, strict=True):
            box = (slice(max(0, r - radius), r + radius + 1), slice(max(0, c - radius), c + radius + 1))
            good = ~invalid[box]
            if good.sum() >= 3:
                u2[r, c], v2[r, c], todo[r, c] = np.median(u[box][good]), np.median(v[box][good]), False
    return u2, v2


def replace_at(row: np.ndarray, col: np.ndarray, u: np.ndarray, v: np.ndarray, todo: np.ndarray, good: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``u`` and ``v`` of nodes (row, col); those to do get the median of the good ones in the smallest square that holds three."""
    shape = int(row.max()) + 1, int(col.max()) + 1
    gu, gv, ok = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, bool)
    gu[row, col], gv[row, col], ok[row, col] = u, v, good
    total = np.pad(np.cumsum(np.cumsum(ok, axis=0), axis=1), ((1, 0), (1, 0)))
    u2, v2 = u.copy(), v.copy()
    for i in np.flatnonzero(todo):
        r, c = int(row[i]), int(col[i])
        for radius in range(1, min(max(shape), most or max(shape)) + 1):
            a, b, d, e = max(0, r - radius), min(shape[0], r + radius + 1), max(0, c - radius), min(shape[1], c + radius + 1)
            if total[b, e] - total[a, e] - total[b, d] + total[a, d] >= 3:
                box = ok[a:b, d:e]
                u2[i], v2[i] = np.median(gu[a:b, d:e][box]), np.median(gv[a:b, d:e][box])
                break
    return u2, v2


def smooth(f: np.ndarray) -> np.ndarray:
    """Binomial [1 2 1] / 4 both ways, edges repeated."""
    for axis in (0, 1):
        p = np.pad(f, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        lo, mid, hi = (np.take(p, range(k, k + f.shape[axis]), axis) for k in range(3))
        f = (lo + 2 * mid + hi) / 4
    return f


def substitute(u: np.ndarray, v: np.ndarray, flags: np.ndarray, mask: np.ndarray, alt_u: np.ndarray, alt_v: np.ndarray, threshold: float, radius: int, epsilon: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, flags): flagged cells take their first other peak that passes the median test among unflagged neighbours."""
    bad = flags | mask
    near = [_stack(np.where(bad, np.nan, f), radius) for f in (u, v)]
    enough = (~np.isnan(near[0])).sum(axis=0) >= 3
    med = [_median(n) for n in near]
    spread = [_median(np.abs(n - m)) for n, m in zip(near, med, strict=True)]
    u, v, flags, open_ = u.copy(), v.copy(), flags.copy(), flags & enough
    for k in range(alt_u.shape[-1]):
        with np.errstate(invalid="ignore"):
            ok = open_ & (np.abs(alt_u[..., k] - med[0]) / (spread[0] + epsilon) <= threshold) & (np.abs(alt_v[..., k] - med[1]) / (spread[1] + epsilon) <= threshold)
        u[ok], v[ok] = alt_u[..., k][ok], alt_v[..., k][ok]
        flags &= ~ok
        open_ &= ~ok
    return u, v, flags


def _dct(n: int) -> np.ndarray:
    """Orthonormal cosine transform as a matrix."""
    k, i = np.mgrid[0:n, 0:n]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def smoothn(y: np.ndarray, s: float | None = None, weights: np.ndarray | None = None, robust: bool = False, maxiter: int = 100, tol: float = 1e-3) -> np.ndarray:
    """Penalised least squares in the cosine domain; the penalty by generalised cross-validation where s isn't given.

    NaN cells have no weight and are filled. ``robust`` reweights four times by bisquare residuals.
    """
    y = np.asarray(y, float)
    base = np.where(np.isfinite(y), 1.0 if weights is None else weights, 0.0)
    if not (base > 0).any():
        raise ValueError("there is nothing to smooth")
    base, z0 = base / base.max(), np.where(np.isfinite(y), y, np.median(y[base > 0]))
    nr, nc = y.shape
    tr, tc = _dct(nr), _dct(nc)
    lam = (-2 + 2 * np.cos(np.pi * np.arange(nr) / nr))[:, None] + (-2 + 2 * np.cos(np.pi * np.arange(nc) / nc))[None, :]
    grid = 10.0 ** np.linspace(-6, 8, 43)
    data, z, w = np.where(base > 0, z0, 0.0), z0.copy(), base
    for turn in range(4 if robust else 1):
        penalty = s
        for i in range(maxiter):
            spectrum = tr @ (w * (data - z) + z) @ tc.T
            if penalty is None:
                n = (w > 0).sum()
                best = []
                for g in grid:
                    gamma = 1 / (1 + g * lam**2)
                    if (w == 1).all():
                        rss = ((spectrum * (gamma - 1)) ** 2).sum()
                    else:
                        rss = (w * (data - tr.T @ (gamma * spectrum) @ tc) ** 2).sum()
                    best.append((rss / n) / (1 - gamma.mean()) ** 2 if gamma.mean() < 1 else np.inf)
                penalty = grid[int(np.argmin(best))]
            new = tr.T @ (spectrum / (1 + penalty * lam**2)) @ tc
            change = np.linalg.norm(new - z) / max(np.linalg.norm(z), 1e-300)
            z = new
            if (w == 1).all() or change < tol:
                break
        if robust and turn < 3:
            res = np.where(base > 0, data - z, 0.0)
            spread = 1.4826 * np.median(np.abs(res[base > 0])) * 4.685
            w = base * np.where(np.abs(res) < spread, (1 - (res / spread) ** 2) ** 2, 0.0) if spread > 0 else base
    return z


def scattered_outliers(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float = 2.0, neighbors: int = 8, epsilon: float = 0.1) -> np.ndarray:
    """Normalised median test over each point's nearest others; too few points flag nothing."""
    n = len(x)
    if n < 4:
        return np.zeros(n, bool)
    near = Cells(x, y).nearest(x, y, min(neighbors, n - 1), skip=np.arange(n))
    out = np.zeros(n, bool)
    enough = (near >= 0).sum(axis=1) >= 3
    for f in (u, v):
        some = np.where(near >= 0, f[near], np.nan)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            med = np.nanmedian(some, axis=1)
            spread = np.nanmedian(np.abs(some - med[:, None]), axis=1)
        out |= enough & (np.abs(f - med) / (spread + epsilon) > threshold)
    return out


class Cells:
    """Points in square cells: neighbours within a radius, or the nearest, without looking at all points."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: float | None = None) -> None:
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n = max(1, len(self.x))
        wide = max(np.ptp(self.x) if len(self.x) else 1.0, np.ptp(self.y) if len(self.y) else 1.0, 1e-9)
        self.size = float(size or wide / max(1.0, np.sqrt(n / 2)))
        key = np.stack([np.floor(self.x / self.size), np.floor(self.y / self.size)], axis=1).astype(np.int64)
        self.cell: dict[tuple[int, int], np.ndarray] = {}
        if len(key):
            order = np.lexsort((key[:, 1], key[:, 0]))
            cut = np.flatnonzero((np.diff(key[order], axis=0) != 0).any(axis=1)) + 1
            for part in np.split(order, cut):
                self.cell[tuple(key[part[0]])] = np.sort(part)
        self.low, self.high = (key.min(axis=0), key.max(axis=0)) if len(key) else (np.zeros(2), np.zeros(2))

    def _ring(self, i: int, j: int, k: int) -> list[np.ndarray]:
        return [self.cell[c] for a in range(i - k, i + k + 1) for b in (range(j - k, j + k + 1) if abs(a - i) == k else {j - k, j + k}) if (c := (a, b)) in self.cell]

    def within(self, px: float, py: float, radius: float) -> np.ndarray:
        """Indices of points at most ``radius`` away, ascending."""
        i, j = int(np.floor(px / self.size)), int(np.floor(py / self.size))
        reach = int(np.ceil(radius / self.size))
        found = [self.cell[c] for a in range(i - reach, i + reach + 1) for b in range(j - reach, j + reach + 1) if (c := (a, b)) in self.cell]
        if not found:
            return np.zeros(0, np.int64)
        at = np.sort(np.concatenate(found))
        return at[(self.x[at] - px) ** 2 + (self.y[at] - py) ** 2 <= radius**2]

    def nearest(self, px: np.ndarray, py: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
        """The k nearest points' indices, nearest first, ties by index; -1 where there are fewer."""
        out = np.full((len(px), k), -1, np.int64)
        for q in range(len(px)):
            i, j = int(np.floor(px[q] / self.size)), int(np.floor(py[q] / self.size))
            last = int(max(abs(self.low - (i, j)).max(), abs(self.high - (i, j)).max()))
            held, ring = np.zeros(0, np.int64), 0
            while ring <= last:
                held = np.concatenate([held, *self._ring(i, j, ring)])
                mine = held if skip is None else held[held != skip[q]]
                if len(mine) >= k:
                    d = np.hypot(self.x[mine] - px[q], self.y[mine] - py[q])
                    if np.partition(d, k - 1)[k - 1] <= ring * self.size:  # nothing nearer is outside
                        break
                ring += 1
            mine = held if skip is None else held[held != skip[q]]
            d = (self.x[mine] - px[q]) ** 2 + (self.y[mine] - py[q]) ** 2
            best = mine[np.lexsort((mine, d))[:k]]
            out[q, : len(best)] = best
        return out
