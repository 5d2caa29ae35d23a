"""Column functions with the library's numeric rules."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def above(value: Column, limit) -> Column:
    """value > limit where NaN isn't (Spark orders NaN above everything)."""
    return ~F.isnan(value) & (value > limit)


def ratio(n: Column, d: Column) -> Column:
    """n / d with infinities and NaN instead of an error at zero."""
    inf = F.lit(float("inf"))
    return F.when(d != 0, n / d).when(n > 0, inf).when(n < 0, -inf).otherwise(F.lit(float("nan")))


def magnitude(u, v) -> Column:
    return F.hypot(col(u), col(v))


def valid(u="u", v="v", masked="masked", outlier="outlier", include_invalid: bool = False) -> Column:
    """A sample that statistics use: finite, not masked, and no outlier unless those are included."""
    u, v = col(u), col(v)
    finite = u.isNotNull() & v.isNotNull() & ~F.isnan(u) & ~F.isnan(v) & (F.abs(u) < float("inf")) & (F.abs(v) < float("inf"))
    out = finite & ~F.coalesce(col(masked), F.lit(False))
    return out if include_invalid else out & ~F.coalesce(col(outlier), F.lit(False))


def fails(spec, u="u", v="v", peak_ratio="peak_ratio", moment="correlation_moment") -> Column:
    """Whether a local validator flags a row: NaN fails every limit."""
    from ..params import parse_validator

    s = parse_validator(spec)
    if s.kind == "uod":
        raise ValueError("the median test needs neighbours: use operators.fields.outliers")
    if s.kind == "peak_ratio":
        return F.isnan(col(peak_ratio)) | (col(peak_ratio) < s.threshold)
    if s.kind == "correlation_moment":
        return F.isnan(col(moment)) | (col(moment) > s.threshold)
    size = magnitude(u, v)
    return F.isnan(size) | (size < s.min) | (size > s.max)


def in_rectangle(x, y, x0: float, x1: float, y0: float, y1: float) -> Column:
    return col(x).between(x0, x1) & col(y).between(y0, y1)


def in_polygon(x, y, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges."""
    if len(vertices) < 3:
        raise ValueError("a polygon has three vertices or more")
    x, y = col(x), col(y)
    n = F.lit(0)
    for (xa, ya), (xb, yb) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if ya != yb:
            crosses = (F.lit(ya) > y) != (F.lit(yb) > y)
            n = n + F.when(crosses & (x < (xb - xa) * (y - ya) / (yb - ya) + xa), 1).otherwise(0)
    return n % 2 == 1


# Velocity fields (x, y, z, t) -> (u, v, w).


def linear_flow(u: float, v: float, w: float = 0.0):
    return lambda x, y, z, t: (F.lit(float(u)), F.lit(float(v)), F.lit(float(w)))


def vortex_flow(x0: float, y0: float, speed: float):
    def at(x, y, z, t):
        r = F.hypot(x - x0, y - y0)
        return F.when(r > 0, -speed * (y - y0) / r).otherwise(0.0), F.when(r > 0, speed * (x - x0) / r).otherwise(0.0), F.lit(0.0)

    return at


def shear_flow(rate: float, y0: float = 0.0):
    return lambda x, y, z, t: (rate * (y - y0), F.lit(0.0), F.lit(0.0))


def laser_intensity(z, centre: float = 0.0, thickness: float = 1.0, peak: float = 1.0) -> Column:
    s = thickness / 2.3548200450309493
    return peak * F.exp(-((col(z) - centre) * (col(z) - centre)) / (2 * s * s))


# Pixel arrays (row-major array<double>).


def subtract_background(pixels, background) -> Column:
    return F.zip_with(col(pixels), col(background), lambda p, b: F.greatest(p - b, F.lit(0.0)))


def invert_image(pixels) -> Column:
    p = col(pixels)
    return F.transform(p, lambda x: F.array_min(p) + F.array_max(p) - x)


def mask_of(pixels, threshold: float = 0.5, invert: bool = False) -> Column:
    return F.transform(col(pixels), lambda x: x < threshold if invert else x >= threshold)


def union_masks(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda p, q: p | q)


def quantile(pixels, share: float) -> Column:
    """Linear between order statistics, of an array column."""
    s = F.sort_array(col(pixels))
    at = (F.size(s) - 1) * F.lit(float(share))
    low = F.floor(at).cast("int")
    lo = F.get(s, low)
    return lo + (F.get(s, F.least(low + 1, F.size(s) - 1)) - lo) * (at - low)


def mean(pixels) -> Column:
    return F.aggregate(col(pixels), F.lit(0.0), lambda a, x: a + x) / F.size(col(pixels))


def sample_std(pixels) -> Column:
    p = col(pixels)
    m = F.transform(F.array(mean(p)), lambda mu: F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)))[0]
    return F.sqrt(m / (F.size(p) - 1))


def percentile_stretch(pixels, low: float = 1.0, high: float = 99.0) -> Column:
    p = col(pixels)
    ends = F.struct(quantile(p, low / 100).alias("lo"), quantile(p, high / 100).alias("hi"))
    return F.transform(F.array(ends), lambda e: F.transform(p, lambda x: F.when(e["hi"] <= e["lo"], F.lit(0.5)).otherwise(F.least(F.greatest((x - e["lo"]) / F.when(e["hi"] > e["lo"], e["hi"] - e["lo"]), F.lit(0.0)), F.lit(1.0)))))[0]


def intensity_cap(pixels, n_sigma: float = 2.0) -> Column:
    p = col(pixels)
    return F.transform(F.array(quantile(p, 0.5) + n_sigma * sample_std(p)), lambda cap: F.transform(p, lambda x: F.least(x, cap)))[0]


# Cameras and plane transforms.


def pinhole(P, x, y, z) -> tuple[Column, Column]:
    """Pixel (x, y) of a world point through a 3 x 4 matrix."""
    h = [col(x) * float(r[0]) + col(y) * float(r[1]) + col(z) * float(r[2]) + float(r[3]) for r in P]
    return ratio(h[0], h[2]), ratio(h[1], h[2])


def soloff(camera, x, y, z) -> tuple[Column, Column]:
    from ..kernels.geometry import SOLOFF

    n = [(col(c) - float(m)) / float(s) for c, m, s in zip((x, y, z), camera.center, camera.scale, strict=True)]
    power = lambda c, k: F.lit(1.0) if k == 0 else c if k == 1 else c * power(c, k - 1)
    terms = [power(n[0], i) * power(n[1], j) * power(n[2], k) for i, j, k in SOLOFF]
    total = lambda a: sum((t * float(w) for t, w in zip(terms, a, strict=True)), F.lit(0.0))
    return total(camera.ax), total(camera.ay)


def planar_point(t, x, y) -> tuple[Column, Column]:
    return tuple(float(m[0]) * col(x) + float(m[1]) * col(y) + float(o) for m, o in zip(t.matrix, t.offset, strict=True))


def planar_vector(t, u, v) -> tuple[Column, Column]:
    return tuple(float(m[0]) * col(u) + float(m[1]) * col(v) for m in t.matrix)


def gauss3(low, mid, high) -> Column:
    """Sub-pixel offset through three samples; 0 where one isn't positive."""
    a, b, c = (F.ln(F.when(col(v) > 0, col(v))) for v in (low, mid, high))
    below = 2 * (a - 2 * b + c)
    return F.coalesce(F.when(below != 0, (a - c) / below), F.lit(0.0))


def frame_index_strings(a: str, b: str) -> tuple[str, str]:
    """What differs in two paths' stems, with whole runs of digits; equal stems are an error."""
    import os
    import re

    x, y = (os.path.splitext(os.path.basename(p))[0] for p in (a, b))
    if x == y:
        raise ValueError("the two names are the same")
    px, py = (re.findall(r"[0-9]+|[^0-9]", s) for s in (x, y))
    lead = 0
    while lead < min(len(px), len(py)) and px[lead] == py[lead]:
        lead += 1
    tail = 0
    while tail < min(len(px), len(py)) - lead and px[-1 - tail] == py[-1 - tail]:
        tail += 1
    return "".join(px[lead : len(px) - tail]), "".join(py[lead : len(py) - tail])


def scale_from_points(p1, p2, distance: float, dt: float, length_unit: str = "mm", time_unit: str = "s"):
    """A PhysicalScale from two points a known distance apart."""
    import math

    from ..params import PhysicalScale

    return PhysicalScale(distance / math.dist(p1, p2), dt, length_unit, time_unit)


def index_strings(a, b) -> Column:
    """struct<a, b> of what differs in two path columns, a batch at a time."""
    @F.pandas_udf("a string, b string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([frame_index_strings(p, q) for p, q in zip(x, y, strict=True)], columns=["a", "b"])

    return run(col(a), col(b))
