"""Image preparation and masks. Images are row x column arrays; masks are true where pixels are left out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, over 2 * ceil(3 sigma) + 1 pixels, edges repeated."""
    h = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-h, h + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = np.asarray(image, float)
    for axis in (0, 1):
        p = np.pad(out, [(h, h) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = np.tensordot(np.lib.stride_tricks.sliding_window_view(p, 2 * h + 1, axis=axis), k, axes=([-1], [0]))
    return out


def compute_background(images, method: str = "min") -> np.ndarray:
    stack = [np.asarray(i, float) for i in images]
    if not stack or method not in ("min", "mean"):
        raise ValueError("a background takes images, and 'min' or 'mean'")
    return np.minimum.reduce(stack) if method == "min" else sum(stack) / len(stack)


def subtract_background(image: np.ndarray, background: np.ndarray) -> np.ndarray:
    return np.maximum(image - background, 0)


def intensity_cap(image: np.ndarray, n_sigma: float = 2.0) -> np.ndarray:
    return np.minimum(image, np.median(image) + n_sigma * np.std(image, ddof=1))


def highpass_filter(image: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    return np.maximum(image - gaussian_blur(image, sigma), 0)


def percentile_stretch(image: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    lo, hi = np.quantile(image, [low / 100, high / 100])
    return np.full(image.shape, 0.5) if hi <= lo else np.clip((image - lo) / (hi - lo), 0, 1)


def invert_image(image: np.ndarray) -> np.ndarray:
    return image.min() + image.max() - image


def local_variance_normalize(image: np.ndarray, sigma: float = 3.0, epsilon: float = 1e-3) -> np.ndarray:
    mean = gaussian_blur(image, sigma)
    var = np.maximum(gaussian_blur(np.asarray(image, float) ** 2, sigma) - mean**2, 0)
    return (image - mean) / np.sqrt(var + epsilon**2)


def clahe(image: np.ndarray, tiles: tuple[int, int] = (8, 8), clip_limit: float = 2.0, nbins: int = 256) -> np.ndarray:
    """Equalised histograms of tiles, clipped, blended between tile centres; a constant image becomes 0.5."""
    image = np.asarray(image, float)
    lo, hi = image.min(), image.max()
    if hi <= lo:
        return np.full(image.shape, 0.5)
    bins = np.rint((image - lo) * (nbins - 1) / (hi - lo)).astype(int)
    edges = [np.rint(np.linspace(0, n, t + 1)).astype(int) for n, t in zip(image.shape, tiles, strict=True)]
    cdf = np.zeros((*tiles, nbins))
    for i in range(tiles[0]):
        for j in range(tiles[1]):
            part = bins[edges[0][i] : edges[0][i + 1], edges[1][j] : edges[1][j + 1]]
            n = max(1, part.size)
            h = np.bincount(part.ravel(), minlength=nbins).astype(float)
            top = max(clip_limit * n / nbins, 1.0)
            h = np.minimum(h, top) + np.maximum(h - top, 0).sum() / nbins
            cdf[i, j] = np.cumsum(h) / n
    at = []
    for axis, n in enumerate(image.shape):
        centre = (edges[axis][:-1] + edges[axis][1:] - 1) / 2
        p = np.arange(n)
        low = np.clip(np.searchsorted(centre, p, side="right") - 1, 0, len(centre) - 1)
        high = np.minimum(low + 1, len(centre) - 1)
        span = centre[high] - centre[low]
        at.append((low, high, np.clip(np.where(span > 0, (p - centre[low]) / np.where(span > 0, span, 1), 0), 0, 1)))
    (r0, r1, p), (c0, c1, q) = at
    take = lambda r, c: cdf[r[:, None], c[None, :], bins]
    p, q = p[:, None], q[None, :]
    return np.clip((take(r0, c0) * (1 - q) + take(r0, c1) * q) * (1 - p) + (take(r1, c0) * (1 - q) + take(r1, c1) * q) * p, 0, 1)


#: Steps of a pipeline by name.
STEPS: dict[str, Callable] = {f.__name__: f for f in (subtract_background, intensity_cap, highpass_filter, clahe, percentile_stretch, invert_image, local_variance_normalize, gaussian_blur)}


def build_preprocess(steps: list[tuple[str, dict]]) -> Callable[[np.ndarray], np.ndarray]:
    """One function of an ordered list of (step, options); an option enabled=False leaves a step out."""
    for name, _ in steps:
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}")

    def run(image: np.ndarray) -> np.ndarray:
        for name, options in steps:
            if options.get("enabled", True):
                image = STEPS[name](image, **{k: v for k, v in options.items() if k != "enabled"})
        return image

    return run


def polygon_mask(size: tuple[int, int], vertices) -> np.ndarray:
    """Pixels inside a polygon of (x, y) vertices, 1-based, by the even-odd rule on each row (y1 <= y < y2)."""
    if len(vertices) < 3:
        raise ValueError("a polygon has three vertices or more")
    out = np.zeros(size, bool)
    v = np.asarray(vertices, float)
    w = np.roll(v, -1, axis=0)
    for r in range(1, size[0] + 1):
        lo, hi = np.minimum(v[:, 1], w[:, 1]), np.maximum(v[:, 1], w[:, 1])
        cross = (lo <= r) & (r < hi)
        xs = np.sort(v[cross, 0] + (r - v[cross, 1]) * (w[cross, 0] - v[cross, 0]) / (w[cross, 1] - v[cross, 1]))
        for a, b in zip(xs[::2], xs[1::2], strict=True):
            out[r - 1, max(1, int(np.ceil(a))) - 1 : max(0, min(size[1], int(np.floor(b))))] = True
    return out


def _disc(radius: float) -> list[tuple[int, int]]:
    n = int(np.floor(radius))
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= radius * radius]


def grow_mask(mask: np.ndarray, radius: float = 1) -> np.ndarray:
    """Of an image, or of each image along the leading axes."""
    out, (nr, nc) = np.zeros(mask.shape, bool), mask.shape[-2:]
    for a, b in _disc(radius):
        if abs(a) < nr and abs(b) < nc:
            out[..., max(0, a) : nr + min(0, a), max(0, b) : nc + min(0, b)] |= mask[..., max(0, -a) : nr - max(0, a), max(0, -b) : nc - max(0, b)]
    return out


def at_least_quantile(pixels: np.ndarray, share: float) -> np.ndarray:
    """Which pixels of each row reach the row's quantile, linear between order statistics; NaN is the largest."""
    s = np.sort(pixels, axis=-1)
    at = (s.shape[-1] - 1) * share
    low = int(np.floor(at))
    lo = s[..., low, None]
    with np.errstate(invalid="ignore"):
        return (pixels >= lo + (s[..., min(low + 1, s.shape[-1] - 1), None] - lo) * (at - low)) | np.isnan(pixels)


def shrink_mask(mask: np.ndarray, radius: float = 1) -> np.ndarray:
    """What a grown complement leaves; beyond the image nothing is masked."""
    n = int(np.floor(radius))
    whole = np.pad(mask, n)
    return ~grow_mask(~whole, radius)[n : n + mask.shape[0], n : n + mask.shape[1]]


def local_variance(image: np.ndarray, radius: int) -> np.ndarray:
    """Population variance in a square clipped to the image."""

    def box(f: np.ndarray) -> np.ndarray:
        s = np.pad(np.cumsum(np.cumsum(f, axis=0), axis=1), ((1, 0), (1, 0)))
        r, c = np.arange(f.shape[0]), np.arange(f.shape[1])
        r0, r1 = np.maximum(r - radius, 0)[:, None], np.minimum(r + radius + 1, f.shape[0])[:, None]
        c0, c1 = np.maximum(c - radius, 0)[None, :], np.minimum(c + radius + 1, f.shape[1])[None, :]
        return s[r1, c1] - s[r0, c1] - s[r1, c0] + s[r0, c0]

    image = np.asarray(image, float)
    n = box(np.ones(image.shape))
    return np.maximum(box(image**2) / n - (box(image) / n) ** 2, 0)


def automatic_mask(image: np.ndarray, second: np.ndarray | None = None, method: str = "intensity", threshold: float | None = None, side: str = "low", radius: int = 5, grow: float = 0) -> np.ndarray:
    """Masked where intensity, contrast (local deviation) or edges are beyond a threshold; of two images, either's."""
    if second is not None:
        return automatic_mask(image, None, method, threshold, side, radius, grow) | automatic_mask(second, None, method, threshold, side, radius, grow)
    if method not in ("intensity", "contrast", "edge") or side not in ("low", "high"):
        raise ValueError("method is 'intensity', 'contrast' or 'edge'; side is 'low' or 'high'")
    image = np.asarray(image, float)
    if method == "edge":
        dy, dx = np.gradient(image)
        measure = np.hypot(dx, dy)
    else:
        measure = image if method == "intensity" else np.sqrt(local_variance(image, radius))
    if threshold is None:
        share = {"low": 0.05 if method == "intensity" else 0.01, "high": 0.95 if method == "intensity" else 0.99}[side]
        threshold = np.quantile(measure, share)
    out = measure <= threshold if side == "low" else measure >= threshold
    return grow_mask(out, grow) if grow > 0 else out


def otsu_threshold(image: np.ndarray, bins: int = 256) -> float:
    """Threshold between the histogram's classes of largest separation."""
    lo, hi = float(image.min()), float(image.max())
    if hi <= lo:
        return lo
    h = np.bincount(np.minimum(((image - lo) / (hi - lo) * bins).astype(int), bins - 1).ravel(), minlength=bins).astype(float)
    centre = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
    w, m = np.cumsum(h), np.cumsum(h * centre)
    rest = w[-1] - w
    ok = (w > 0) & (rest > 0)
    between = np.where(ok, w * rest * (m / np.where(w > 0, w, 1) - (m[-1] - m) / np.where(rest > 0, rest, 1)) ** 2, -1)
    return float(centre[int(between.argmax())])
