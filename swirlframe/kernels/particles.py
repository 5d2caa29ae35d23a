"""Particles: detection, one-to-one matching between frames, and linking over many frames. Coordinates are 1-based."""

from __future__ import annotations

import numpy as np

from ..params import PTVParameters
from .correlation import local_maxima
from .deformation import field_at
from .neighbourhood import Cells, scattered_outliers

FIELDS = ("x", "y", "intensity", "diameter")


def _log_axis(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and sigma of a Gaussian through three samples; NaN where they aren't one."""
    ok = (low > 0) & (mid > 0) & (high > 0)
    a, b, c = (np.log(np.where(ok, v, 1.0)) for v in (low, mid, high))
    curve = a + c - 2 * b
    ok &= curve < 0
    safe = np.where(ok, curve, -1.0)
    at = (a - c) / (2 * safe)
    ok &= np.abs(at) < 1
    return np.where(ok, at, np.nan), np.where(ok, np.sqrt(-1 / safe), np.nan)


def detect(image: np.ndarray, p: PTVParameters, mask: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Local maxima above a robust threshold, refined per axis; too large or small ones and close fainter ones go."""
    image = np.asarray(image, float)
    good = image if mask is None else image[~mask]
    none = {k: np.zeros(0) for k in FIELDS}
    if good.size == 0 or min(image.shape) < 3:
        return none
    ground = np.median(good)
    spread = 1.4826 * np.median(np.abs(good - ground))
    least = p.threshold if p.threshold is not None else ground + (p.threshold_k * spread if spread > 0 else 0.1 * (good.max() - ground))
    peak = local_maxima(image) & (image > least)
    peak[[0, -1]] = peak[:, [0, -1]] = False
    if mask is not None:
        peak &= ~mask
    cols, rows = np.nonzero(peak.T)  # column order
    if not len(rows):
        return none
    j = image - ground
    dx, sx = _log_axis(j[rows, cols - 1], j[rows, cols], j[rows, cols + 1])
    dy, sy = _log_axis(j[rows - 1, cols], j[rows, cols], j[rows + 1, cols])
    box = np.maximum(np.stack([j[rows + a, cols + b] for a in (-1, 0, 1) for b in (-1, 0, 1)]), 0)
    total = box.sum(axis=0)
    d = np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], float)
    centre = np.where(total > 0, (d.T[:, :, None] * box).sum(axis=1) / np.where(total > 0, total, 1), 0)
    dx, dy = np.where(np.isnan(dx), centre[1], dx), np.where(np.isnan(dy), centre[0], dy)
    both = np.stack([sx, sy])
    n = (~np.isnan(both)).sum(axis=0)
    diameter = np.where(n > 0, 4 * np.nansum(both, axis=0) / np.maximum(n, 1), np.nan)
    with np.errstate(invalid="ignore"):
        fits = ~((diameter < p.min_diameter) | (diameter > p.max_diameter))
    out = {"x": cols + 1 + dx, "y": rows + 1 + dy, "intensity": j[rows, cols], "diameter": diameter}
    out = {k: v[fits] for k, v in out.items()}
    order = np.argsort(-out["intensity"], kind="stable")
    keep = apart(out["x"][order], out["y"][order], p.min_separation)
    return {k: v[order][keep] for k, v in out.items()}


def apart(x: np.ndarray, y: np.ndarray, separation: float) -> np.ndarray:
    """Which points stay when each, in order, is dropped if an earlier one that stays is nearer than ``separation``."""
    cells = Cells(x, y, separation)
    keep = np.zeros(len(x), bool)
    for i in range(len(x)):
        near = cells.within(x[i], y[i], separation)
        near = near[keep[near]]
        keep[i] = not ((x[near] - x[i]) ** 2 + (y[near] - y[i]) ** 2 < separation**2).any()
    return keep


def assign(cost: np.ndarray, d2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of the pairs taken greedily by (cost, squared distance, i, j), each index once."""
    used_i, used_j, out = set(), set(), []
    for k in np.lexsort((j, i, d2, cost)):
        if i[k] not in used_i and j[k] not in used_j:
            used_i.add(i[k])
            used_j.add(j[k])
            out.append(k)
    return np.array(out, np.int64)


def match(px: np.ndarray, py: np.ndarray, a: dict, b: dict, p: PTVParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in a, index in b, residual) of particles of b at the predicted places of those of a; 0-based, by a."""
    if not len(px) or not len(b["x"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cells = Cells(b["x"], b["y"], p.search_radius)
    near = [cells.within(x, y, p.search_radius) if np.isfinite(x) and np.isfinite(y) else np.zeros(0, np.int64) for x, y in zip(px, py, strict=True)]
    i, j = np.repeat(np.arange(len(px)), [len(n) for n in near]), np.concatenate(near).astype(np.int64)
    d2 = (b["x"][j] - px[i]) ** 2 + (b["y"][j] - py[i]) ** 2
    cost = d2.copy()
    for weight, name in ((p.intensity_weight, "intensity"), (p.diameter_weight, "diameter")):
        if weight > 0:
            with np.errstate(invalid="ignore", divide="ignore"):
                cost += np.nan_to_num(weight * np.log(b[name][j] / a[name][i]) ** 2, nan=0.0, posinf=np.inf)
    k = assign(cost, d2, i, j)
    k = k[np.argsort(i[k], kind="stable")]
    return i[k], j[k], np.sqrt(d2[k])


def predicted(x: np.ndarray, y: np.ndarray, pred) -> tuple[np.ndarray, np.ndarray]:
    """Displacement at particles of a predictor (x, y, u, v), or of None."""
    if pred is None or not len(x):
        return np.zeros(len(x)), np.zeros(len(x))
    gx, gy, u, v = pred
    at = lambda f: np.array([field_at(gx, gy, f, np.array([a]), np.array([b]))[0, 0] for a, b in zip(x, y, strict=True)])
    return at(np.nan_to_num(u)), at(np.nan_to_num(v))


def track_pair(a: dict, b: dict, p: PTVParameters, pred=None) -> dict[str, np.ndarray]:
    """Matches of two frames: index_a, index_b (1-based), x, y, u, v, match_residual, outlier."""
    du, dv = predicted(a["x"], a["y"], pred)
    i, j, residual = match(a["x"] + du, a["y"] + dv, a, b, p)
    u, v = b["x"][j] - a["x"][i], b["y"][j] - a["y"][i]
    flag = scattered_outliers(a["x"][i], a["y"][i], u, v, p.uod_threshold, p.uod_neighbors, p.uod_epsilon) if p.uod_enable else np.zeros(len(i), bool)
    return {"index_a": i + 1, "index_b": j + 1, "x": a["x"][i], "y": a["y"][i], "u": u, "v": v, "match_residual": residual, "outlier": flag}


def bin_to_grid(x, y, u, v, shape: tuple[int, int], window: int = 32, overlap: int = 16, min_count: int = 3):
    """(x, y, u, v, mask) of medians about regular centres; cells with too few are masked."""
    step = window - overlap
    gx = np.arange(1 + (window - 1) / 2, shape[1] - (window - 1) / 2 + 1e-9, step)
    gy = np.arange(1 + (window - 1) / 2, shape[0] - (window - 1) / 2 + 1e-9, step)
    j = np.clip(np.rint((x - gx[0]) / step).astype(int), 0, len(gx) - 1)
    i = np.clip(np.rint((y - gy[0]) / step).astype(int), 0, len(gy) - 1)
    out_u, out_v = np.full((len(gy), len(gx)), np.nan), np.full((len(gy), len(gx)), np.nan)
    cell = i * len(gx) + j
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        if len(part) >= min_count:
            out_u[i[part[0]], j[part[0]]], out_v[i[part[0]], j[part[0]]] = np.median(u[part]), np.median(v[part])
    return gx, gy, out_u, out_v, np.isnan(out_u)


class Tracker:
    """Tracks as frames come in: heads are predicted, matched, kept over gaps, and started anew from what is left."""

    def __init__(self, p: PTVParameters, max_gap: int = 0, pred=None, shape: tuple[int, int] | None = None) -> None:
        self.p, self.max_gap, self.pred, self.shape = p, max_gap, pred, shape
        self.live: list[list[tuple[int, float, float, float, float]]] = []  # (frame, x, y, intensity, diameter)
        self.missed: list[int] = []
        self.done: list[list] = []

    def add(self, frame: int, b: dict) -> None:
        heads = self.live
        a = {n: np.array([t[-1][k] for t in heads]) for k, n in enumerate(FIELDS, 1)}
        px, py = a["x"].copy(), a["y"].copy()
        fu, fv = predicted(a["x"], a["y"], self.pred)
        for k, t in enumerate(heads):
            gone = frame - t[-1][0]
            if len(t) > 1:
                since = t[-1][0] - t[-2][0]
                px[k] += (t[-1][1] - t[-2][1]) * gone / since
                py[k] += (t[-1][2] - t[-2][2]) * gone / since
            else:
                px[k] += fu[k] * gone
                py[k] += fv[k] * gone
        i, j, _ = match(px, py, a, b, self.p)
        u, v = b["x"][j] - a["x"][i], b["y"][j] - a["y"][i]
        if self.p.uod_enable and len(i):
            fine = ~scattered_outliers(a["x"][i], a["y"][i], u, v, self.p.uod_threshold, self.p.uod_neighbors, self.p.uod_epsilon)
            i, j, u, v = i[fine], j[fine], u[fine], v[fine]
        if self.shape is not None and len(i):
            x, y, gu, gv, bad = bin_to_grid(a["x"][i], a["y"][i], u, v, self.shape)
            if (~bad).any():
                self.pred = (x, y, np.where(bad, np.nanmedian(gu), gu), np.where(bad, np.nanmedian(gv), gv))
        linked = dict(zip(i.tolist(), j.tolist(), strict=True))
        live, missed = [], []
        for k, t in enumerate(heads):
            gap = 0 if k in linked else self.missed[k] + 1
            if k in linked:
                t.append((frame, *(float(b[n][linked[k]]) for n in FIELDS)))
            if gap > self.max_gap:
                self.done.append(t)
            else:
                live.append(t)
                missed.append(gap)
        for k in sorted(set(range(len(b["x"]))) - set(linked.values())):
            live.append([(frame, *(float(b[n][k]) for n in FIELDS))])
            missed.append(0)
        self.live, self.missed = live, missed

    def tracks(self, least: int = 3) -> list[list]:
        """Tracks of enough points by first frame, then place."""
        return sorted((t for t in self.done + self.live if len(t) >= least), key=lambda t: (t[0][0], t[0][1], t[0][2]))
