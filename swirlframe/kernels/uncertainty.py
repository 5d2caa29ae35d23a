"""Uncertainty from correlation statistics: additive sums of matched windows, and the deviation that they imply."""

from __future__ import annotations

import numpy as np

REACH, SHARE = 4, 0.05
#: Offsets of one half plane, ring by ring: (0 < dr) or (dr = 0 < dc).
OFFSETS = [(dr, dc) for dr in range(REACH + 1) for dc in range(-REACH, REACH + 1) if (dr > 0 or dc > 0)]
RING = np.array([max(abs(a), abs(b)) for a, b in OFFSETS])


def _component(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums for a shift along the last axis: C0, C+, C-, S00 and the 40 covariances, k x 44."""
    a0, a1, b0, b1 = a[:, :, :-1], a[:, :, 1:], b[:, :, :-1], b[:, :, 1:]
    d = a0 * b1 - a1 * b0
    p = np.pad(d, ((0, 0), (0, 0), (1, 1)), mode="edge")
    d = (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 4
    d = d - d.mean(axis=(1, 2), keepdims=True)
    nr, nc = d.shape[1:]
    cov = []
    for dr, dc in OFFSETS:
        if dr >= nr or abs(dc) >= nc:
            cov.append(np.zeros(len(d)))
            continue
        x = d[:, : nr - dr, max(0, -dc) : nc - max(0, dc)]
        y = d[:, dr:, max(0, dc) : nc - max(0, -dc)]
        cov.append((x * y).sum(axis=(1, 2)))
    return np.stack([(a0 * b0).sum(axis=(1, 2)), (a0 * b1).sum(axis=(1, 2)), (a1 * b0).sum(axis=(1, 2)), (d * d).sum(axis=(1, 2)), *cov], axis=1)


def sums(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums for u and v of windows that match (k x rows x cols, means removed); they add up over pairs."""
    a, b = a.astype(float), b.astype(float)
    return _component(a, b), _component(a.transpose(0, 2, 1), b.transpose(0, 2, 1))


def deviation(s: np.ndarray) -> np.ndarray:
    """Standard deviation of the displacement from sums (k x 44); NaN where the peak has no shape."""
    c0, plus, minus, s00 = s[:, :4].T
    var, open_ = s00.copy(), np.ones(len(s), bool)
    for ring in range(1, REACH + 1):
        part = s[:, 4:][:, RING == ring]
        open_ &= part.max(axis=1) >= SHARE * s00
        var = np.where(open_, var + 2 * part.sum(axis=1), var)
    c = (plus + minus) / 2
    half = np.sqrt(np.maximum(var, 0)) / 2
    lo, hi = c - half, c + half
    ok = (c0 > 0) & (lo > 0) & (hi > 0)
    l0, ll, lh = (np.log(np.where(ok, v, 1.0)) for v in (c0, lo, hi))
    below = 2 * (2 * l0 - lh - ll)
    ok &= below > 0
    return np.where(ok, (lh - ll) / np.where(below > 0, below, 1.0), np.nan)
