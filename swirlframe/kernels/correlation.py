"""Window correlation: planes, peaks and sub-pixel positions of many windows at once (arrays of shape k x rows x cols).

Axes: row, column; all positions here are 0-based. A plane's zero lag is at ``size // 2``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Windows transformed together; bounds the memory of a stage whatever the image's size.
BATCH = 512


def apodization(size: tuple[int, int], kind: str) -> np.ndarray:
    """Gaussian weights of a quarter window's width, or ones."""
    if kind == "none":
        return np.ones(size)
    r, c = (np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * (n / 4) ** 2)) for n in size)
    return r[:, None] * c[None, :]


#: Correlators by name: functions of (a, b, plan) that give the planes (k x plan.fft, no lag in the middle) of centred, weighted windows a in b.
CORRELATORS: dict[str, Callable] = {}


def register_correlator(name: str, correlator: Callable) -> None:
    """Makes ``name`` a ``correlation_method``. Parameters take up the function itself, so it goes to the executors with the plan."""
    if name in ("cross", "phase") or not callable(correlator):
        raise ValueError("a correlator of one's own is a function and has a name of its own")
    CORRELATORS[name] = correlator


@dataclass(frozen=True)
class Plan:
    """What planes depend on besides pixels. ``method`` is 'cross', 'phase' or a correlator."""

    window: tuple[int, int]
    search: tuple[int, int]
    padding: bool = False
    apodization: str = "none"
    method: str | Callable = "cross"

    @staticmethod
    def of(p) -> Plan:
        return Plan(p.window_size, p.search_area_size, p.padding, p.apodization, p.correlation_method)

    @property
    def fft(self) -> tuple[int, int]:
        return tuple(2 * s for s in self.search) if self.padding else self.search

    @property
    def margin(self) -> tuple[int, int]:
        return tuple((s - w) // 2 for s, w in zip(self.search, self.window, strict=True))


@lru_cache(maxsize=32)
def _constants(plan: Plan) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Weights of a window, gain of a plane, filter of a phase spectrum."""
    weights = apodization(plan.window, plan.apodization)
    gain = filter_ = None
    if plan.padding and plan.window == plan.search:
        share = np.fft.fftshift(np.abs(np.fft.ifft2(np.abs(np.fft.fft2(weights, plan.fft)) ** 2)))
        gain = np.where(share >= share.max() / 2, share.max() / np.maximum(share, 1e-300), 0.0)
    if plan.method == "phase":
        sigma = min(plan.fft) / 8
        r, c = (np.fft.fftfreq(n, 1 / n) for n in plan.fft)
        filter_ = np.exp(-(r[:, None] ** 2 + c[None, : plan.fft[1] // 2 + 1] ** 2) / (2 * sigma**2))
    return weights, gain, filter_


def _centred(w: np.ndarray, masked: np.ndarray | None) -> np.ndarray:
    """Less its mean; masked pixels are left out of the mean and become zero."""
    if masked is None:
        return w - w.mean(axis=(-2, -1), keepdims=True)
    n = (~masked).sum(axis=(-2, -1), keepdims=True)
    mean = np.where(masked, 0, w).sum(axis=(-2, -1), keepdims=True) / np.maximum(n, 1)
    return np.where(masked, 0.0, w - mean)


def planes(a: np.ndarray, b: np.ndarray, plan: Plan, mask_a: np.ndarray | None = None, mask_b: np.ndarray | None = None) -> np.ndarray:
    """Correlation planes of windows a (k x window) in b (k x search area)."""
    weights, gain, filter_ = _constants(plan)
    dtype = np.result_type(a.dtype, b.dtype, np.float32)
    a, b = _centred(a.astype(dtype), mask_a) * weights.astype(dtype), _centred(b.astype(dtype), mask_b)
    mr, mc = plan.margin
    if plan.window == plan.search:
        b = b * weights.astype(dtype)
    else:
        a = np.pad(a, ((0, 0), (mr, mr), (mc, mc)))
    if callable(plan.method):
        out = np.array(plan.method(a, b, plan), dtype)
        if out.shape != (len(a), *plan.fft):
            raise ValueError(f"a correlator's planes are {plan.fft[0]} x {plan.fft[1]}")
        return _near(out * gain.astype(dtype) if gain is not None else out, plan)
    # Real windows and a symmetric filter: half the spectrum is enough, and the plane is the size of a real inverse.
    s = np.conj(np.fft.rfft2(a, plan.fft)) * np.fft.rfft2(b, plan.fft)
    if filter_ is not None:
        s = filter_ * s / (np.abs(s) + np.finfo(dtype).eps)
    out = np.fft.fftshift(np.abs(np.fft.irfft2(s, plan.fft)), axes=(-2, -1)).astype(dtype, copy=False)
    if gain is not None:
        out *= gain.astype(dtype)
    return _near(out, plan)


def _near(out: np.ndarray, plan: Plan) -> np.ndarray:
    """Planes with lags beyond the margin of a search area set to zero."""
    mr, mc = plan.margin
    if mr or mc:
        keep = np.zeros(plan.fft, bool)
        cr, cc = (n // 2 for n in plan.fft)
        keep[cr - mr : cr + mr + 1, cc - mc : cc + mc + 1] = True
        out *= keep
    return out


def local_maxima(r: np.ndarray) -> np.ndarray:
    """Whether each value tops its eight neighbours; of a plateau, the last point in column order does."""
    nr, nc = r.shape[-2:]
    wide = nc + 2
    padded = np.full((*r.shape[:-2], nr + 2, wide), -np.inf, r.dtype)
    padded[..., 1:-1, 1:-1] = r
    # In one run of memory every neighbour is a fixed step away; the borders' own results are cut off.
    flat = padded.reshape(-1)
    core = flat[wide + 1 : len(flat) - wide - 1]
    out = core == core  # a NaN tops nothing
    for step, later in ((-wide - 1, False), (-1, False), (wide - 1, False), (-wide, False), (wide, True), (-wide + 1, True), (1, True), (wide + 1, True)):
        near = flat[wide + 1 + step : len(flat) - wide - 1 + step]
        out &= (near < core) if later else (near <= core)
    whole = np.zeros(padded.shape, bool)
    whole.reshape(-1)[wide + 1 : len(flat) - wide - 1] = out
    return whole[..., 1:-1, 1:-1]


def find_peaks(r: np.ndarray, k: int, finder: str = "regionalmax", radius: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values k, rows k, columns k) of up to k peaks in descending order; NaN and -1 where there are fewer."""
    n, nr, nc = r.shape
    values, at = np.full((n, k), np.nan), np.full((n, k), -1, np.int64)
    rows, alive = np.arange(n), np.ones(n, bool)
    if finder == "regionalmax":
        # Maxima are few: each plane's are put side by side, in column order (in which ties go to the first).
        places = np.flatnonzero(local_maxima(r).transpose(0, 2, 1))
        plane, cell = np.divmod(places, nr * nc)
        many = np.bincount(plane, minlength=n)
        slot = np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many)
        among = np.full((n, max(1, int(many.max(initial=0)))), -np.inf)
        among[plane, slot] = r[plane, cell % nr, cell // nr]
        cells = np.zeros(among.shape, np.int64)
        cells[plane, slot] = cell
    elif finder == "exclusion":
        flat = r.transpose(0, 2, 1).reshape(n, -1)
        among = np.where(np.isnan(flat), -np.inf, flat)
        cols, rws = np.arange(nr * nc) // nr, np.arange(nr * nc) % nr
    else:
        raise ValueError("peak_finder is 'regionalmax' or 'exclusion'")
    for m in range(k):
        best = among.argmax(axis=1)
        value = among[rows, best]
        alive &= value > (-np.inf if m == 0 else 0)
        values[alive, m] = value[alive]
        if finder == "regionalmax":
            at[alive, m] = cells[rows, best][alive]
            among[rows, best] = -np.inf
        else:
            at[alive, m] = best[alive]
            pr, pc = best % nr, best // nr
            among[(np.abs(rws - pr[:, None]) <= radius) & (np.abs(cols - pc[:, None]) <= radius)] = -np.inf
    return values, np.where(at < 0, -1, at % nr), np.where(at < 0, -1, at // nr)


def _around(r: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 values about each peak, and whether they all exist."""
    nr, nc = r.shape[-2:]
    inside = (row > 0) & (row < nr - 1) & (col > 0) & (col < nc - 1)
    rr, cc = np.clip(row, 1, nr - 2), np.clip(col, 1, nc - 2)
    d = np.arange(-1, 2)
    return r[np.arange(len(r))[:, None, None], rr[:, None, None] + d[:, None], cc[:, None, None] + d[None, :]].astype(float), inside


def _three(low: np.ndarray, mid: np.ndarray, high: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Offset of a Gaussian through three positive samples; 0 without."""
    ok = ok & (low > 0) & (mid > 0) & (high > 0)
    a, b, c = (np.log(np.where(ok, v, 1.0)) for v in (low, mid, high))
    below = 2 * (a - 2 * b + c)
    return np.where(ok & (below != 0), (a - c) / np.where(below == 0, 1.0, below), 0.0)


def subpixel(r: np.ndarray, row: np.ndarray, col: np.ndarray, method: str = "gauss3") -> tuple[np.ndarray, np.ndarray]:
    """Refined (row, column) of each peak."""
    row, col = np.asarray(row), np.asarray(col)
    if method == "none":
        return row.astype(float), col.astype(float)
    nr, nc = r.shape[-2:]
    k = np.arange(len(r))
    take = lambda i, j: r[k, np.clip(i, 0, nr - 1), np.clip(j, 0, nc - 1)].astype(float)
    dr = _three(take(row - 1, col), take(row, col), take(row + 1, col), (row > 0) & (row < nr - 1))
    dc = _three(take(row, col - 1), take(row, col), take(row, col + 1), (col > 0) & (col < nc - 1))
    if method == "gauss3" or nr < 3 or nc < 3:
        return row + dr, col + dc
    box, inside = _around(r, row, col)
    if method == "gauss9":
        ok = inside & (box > 0).all(axis=(1, 2))
        g = np.log(np.where(ok[:, None, None], box, 1.0))
        x = y = np.arange(-1.0, 2.0)
        sx, sy, sxx, syy = ((g * w).sum(axis=(1, 2)) for w in (x[None, None, :], y[None, :, None], x[None, None, :] ** 2, y[None, :, None] ** 2))
        a1, a2, a4 = sx / 6, sy / 6, (g * (y[:, None] * x[None, :])[None]).sum(axis=(1, 2)) / 4
        total = g.sum(axis=(1, 2)) / 3
        a3, a5 = sxx / 2 - total, syy / 2 - total
        det = 4 * a3 * a5 - a4**2
        safe = np.where(det > 0, det, 1.0)
        fx, fy = (a4 * a2 - 2 * a5 * a1) / safe, (a4 * a1 - 2 * a3 * a2) / safe
        ok &= (a3 < 0) & (det > 0) & (np.abs(fx) <= 1) & (np.abs(fy) <= 1)
        return row + np.where(ok, fy, dr), col + np.where(ok, fx, dc)
    if method != "gauss2d":
        raise ValueError("subpixel_method is 'gauss3', 'gauss9', 'gauss2d' or 'none'")
    for i in np.flatnonzero(inside & np.isfinite(box).all(axis=(1, 2))):
        dr[i], dc[i] = _gauss2d(box[i])
    return row + dr, col + dc


def _gauss2d(box: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Centre of a 2-D Gaussian with offset fitted to 3 x 3 values: damped least squares, clamped to its bounds."""
    y, x = (g.ravel() for g in np.mgrid[-1:2, -1:2].astype(float))
    z = box.ravel()
    low = np.array([0, -1, 0.1, -1, 0.1, -np.inf])
    high = np.array([np.inf, 1, 3, 1, 3, np.inf])
    p = np.array([np.ptp(z) or 1.0, 0, 1, 0, 1, z.min()])

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = (x - p[1]) / p[2], (y - p[3]) / p[4]
        e = np.exp(-(dx**2 + dy**2) / 2)
        g = p[0] * e
        return g + p[5], np.stack([e, g * dx / p[2], g * dx**2 / p[2], g * dy / p[4], g * dy**2 / p[4], np.ones_like(e)], axis=1)

    damp, (f, j) = 1e-3, model(p)
    cost = ((z - f) ** 2).sum()
    for _ in range(steps):
        h = j.T @ j
        try:
            move = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), j.T @ (z - f))
        except np.linalg.LinAlgError:
            break
        new = np.clip(p + move, low, high)
        f2, j2 = model(new)
        if (c := ((z - f2) ** 2).sum()) < cost:
            done = np.abs(new - p).max() < 1e-10
            p, f, j, cost, damp = new, f2, j2, c, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[3]), float(p[1])


def correlation_moment(r: np.ndarray, row: np.ndarray, col: np.ndarray, neighborhood: int = 3) -> np.ndarray:
    """Root of the second moment about the refined peak over the values near it."""
    n, nr, nc = r.shape
    h = neighborhood // 2
    r0, c0 = np.rint(np.nan_to_num(row)).astype(int), np.rint(np.nan_to_num(col)).astype(int)
    d = np.arange(-h, h + 1)
    rr, cc = r0[:, None, None] + d[:, None], c0[:, None, None] + d[None, :]
    inside = (rr >= 0) & (rr < nr) & (cc >= 0) & (cc < nc)
    w = np.maximum(r[np.arange(n)[:, None, None], np.clip(rr, 0, nr - 1), np.clip(cc, 0, nc - 1)].astype(float), 0) * inside
    total = w.sum(axis=(1, 2))
    second = (w * ((rr - row[:, None, None]) ** 2 + (cc - col[:, None, None]) ** 2)).sum(axis=(1, 2))
    return np.where(total >= 1e-9, np.sqrt(second / np.where(total >= 1e-9, total, 1)), np.nan)


def peak_ratio(values: np.ndarray) -> np.ndarray:
    """First to second peak; infinite where a positive one stands alone."""
    first, second = values[:, 0], values[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(second), np.where(first > 0, np.inf, np.nan), first / second)


def analyze(r: np.ndarray, n_peaks: int = 3, subpixel_method: str = "gauss3", finder: str = "regionalmax") -> dict[str, np.ndarray]:
    """du, dv, peak_ratio, moment of each plane, and displacements alt_u, alt_v of its peaks (always three-point)."""
    n, nr, nc = r.shape
    k = max(n_peaks, 2)
    values, rows, cols = find_peaks(r, k, finder)
    some = rows[:, 0] >= 0
    first_r, first_c = np.maximum(rows[:, 0], 0), np.maximum(cols[:, 0], 0)
    fr, fc = subpixel(r, first_r, first_c, subpixel_method)
    nan = np.where(some, 0.0, np.nan)
    out = {"du": fc - nc // 2 + nan, "dv": fr - nr // 2 + nan, "peak_ratio": peak_ratio(values) + nan, "moment": correlation_moment(r, fr, fc) + nan, "row": fr + nan, "col": fc + nan, "value": values[:, 0]}
    alt_u, alt_v = np.full((n, n_peaks), np.nan), np.full((n, n_peaks), np.nan)
    for m in range(n_peaks):
        has = rows[:, m] >= 0
        ar, ac = subpixel(r, np.maximum(rows[:, m], 0), np.maximum(cols[:, m], 0), "gauss3")
        alt_u[has, m], alt_v[has, m] = (ac - nc // 2)[has], (ar - nr // 2)[has]
    return out | {"alt_u": alt_u, "alt_v": alt_v}


def correlate(a: np.ndarray, b: np.ndarray, plan: Plan | None = None, subpixel_method: str = "gauss3", mask: np.ndarray | None = None) -> tuple[float, float, np.ndarray]:
    """(du, dv, plane) of one pair of windows, by the largest value."""
    plan = plan or Plan(a.shape, b.shape)
    m = None if mask is None else mask[None]
    r = planes(a[None], b[None], plan, m, m)
    at = np.unravel_index(int(np.nanargmax(r[0].T)), r[0].T.shape)
    row, col = subpixel(r, np.array([at[1]]), np.array([at[0]]), subpixel_method)
    return float(col[0] - r.shape[2] // 2), float(row[0] - r.shape[1] // 2), r[0]


def correlate_deformable(a: np.ndarray, b: np.ndarray, plan: Plan | None = None, iterations: int = 3, subpixel_method: str = "gauss3", tol: float = 1e-3) -> tuple[float, float]:
    """Displacement of one pair of windows, b being moved back by what is known until little is left."""
    from .deformation import Spline

    spline, u, v = Spline(b), 0.0, 0.0
    rows, cols = np.mgrid[0 : b.shape[0], 0 : b.shape[1]].astype(float)
    for i in range(iterations):
        moved = b if i == 0 else spline(rows + v, cols + u)
        du, dv, _ = correlate(a, moved, plan, subpixel_method)
        u, v = u + du, v + dv
        if np.hypot(du, dv) < tol:
            break
    return u, v
