"""Analytics on gridded vectors as DataFrames: one row a node, keyed by frame, gi (row) and gj (column), from 1.

Neighbours are reached by lag and lead along a row or column, or by an equi-join on shifted indices; both shuffle by the
frame (and row), so a recording of any length spreads over its frames. What needs a whole grid or series (replacement,
spectra) is one Arrow call for each frame or node.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from ..functions import above, col, fails, in_polygon, in_rectangle, ratio, valid
from ..kernels import neighbourhood
from ..params import PhysicalScale, parse_validator
from . import selection

KEY, NODE = "frame", ("gi", "gj")
_NAN = float("nan")


def _nan_if_none(c: Column, n: Column) -> Column:
    return F.when(n > 0, c).otherwise(F.lit(_NAN))


def field_statistics(f: DataFrame, include_invalid: bool = False) -> DataFrame:
    """Mean, population RMS and Reynolds stress at each node over all frames; NaN where no sample is valid."""
    three = "w" in f.columns
    names = ("u", "v", "w") if three else ("u", "v")
    good = f.withColumn("_ok", valid(include_invalid=include_invalid) & (~F.isnan("w") if three else F.lit(True)))
    take = lambda n: F.when(F.col("_ok"), F.col(n))
    aggs = [F.count(F.when(F.col("_ok"), 1)).alias("count")]
    for i, n in enumerate(names):
        aggs += [F.avg(take(n)).alias(f"mean_{n}"), F.stddev_pop(take(n)).alias(f"rms_{n}")]
        aggs += [F.covar_pop(take(n), take(m)).alias(f"{n}{m}") for m in names[i if three else i + 1 :]]
    out = good.groupBy(*NODE).agg(*aggs)
    return out.select(*NODE, *[F.coalesce(c, F.lit(_NAN)).alias(c) if c != "count" else F.col(c) for c in out.columns if c not in NODE])


def validate_temporal(f: DataFrame, threshold: float = 3.0, epsilon: float = 0.1, gather: int = selection.GATHER) -> DataFrame:
    """Flags samples far from their node's median over time, in units of the median deviation; three samples at least.

    Medians are selected (``selection.quantiles``), so a node's series of any length meets in no task. ``f`` is written first.
    """
    names = [n for n in ("u", "v", "w") if n in f.columns]
    rows = written(f, "field")
    good = rows.filter(valid())
    middle = selection.quantiles(good, NODE, names, names=[f"_m{n}" for n in names], gather=gather).withColumnRenamed("n__mu", "_n").select(*NODE, "_n", *[f"_m{n}" for n in names])
    middle = written(middle, "medians")
    off = selection.beside(good, middle, NODE, "inner").select(*NODE, *[F.abs(F.col(n) - F.col(f"_m{n}")).alias(f"_d{n}") for n in names])
    spread = selection.quantiles(off, NODE, [f"_d{n}" for n in names], gather=gather).select(*NODE, *[f"_d{n}" for n in names])
    out = selection.beside(rows.withColumn("_ok", valid()), middle.join(spread, list(NODE), "left"), NODE)
    flag = F.lit(False)
    for n in names:
        flag = flag | F.coalesce(F.abs(F.col(n) - F.col(f"_m{n}")) / (F.col(f"_d{n}") + epsilon) > threshold, F.lit(False))
    out = out.withColumn("outlier", F.coalesce("outlier", F.lit(False)) | (F.col("_ok") & (F.col("_n") >= 3) & flag))
    return out.select(*f.columns)


def neighbours(f: DataFrame, radius: int, values: Sequence[str]) -> DataFrame:
    """(frame, gi, gj, n_<value> ..): each usable node's values at every node around it, by an equi-join on shifted indices."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (a, b) != (0, 0)]))
    return f.select(KEY, *NODE, *values, shifts.alias("_s")).select(KEY, (F.col("gi") + F.col("_s.a")).alias("gi"), (F.col("gj") + F.col("_s.b")).alias("gj"), *[F.col(v).alias(f"n_{v}") for v in values])


def outliers(f: DataFrame, threshold: float = 2.0, radius: int = 2, epsilon: float = 0.1) -> DataFrame:
    """``f`` with flag: the normalised median test on both components. Masked nodes are neither tested nor used."""
    good = f.filter(~F.coalesce("masked", F.lit(False)))
    near = neighbours(good.filter(~F.isnan("u") & ~F.isnan("v")), radius, ("u", "v"))
    keys = [KEY, *NODE]
    gathered = near.groupBy(*keys).agg(F.collect_list("n_u").alias("nu"), F.collect_list("n_v").alias("nv"))  # at most (2 radius + 1)^2 - 1
    flag = F.lit(False)
    joined = good.join(gathered, keys, "left")
    for n in ("u", "v"):
        joined = joined.withColumn(f"_m{n}", array_median(F.col(f"n{n}")))
        joined = joined.withColumn(f"_d{n}", array_median(F.transform(F.col(f"n{n}"), distance(f"_m{n}"))))
        flag = flag | F.coalesce(above(F.abs(F.col(n) - F.col(f"_m{n}")) / (F.col(f"_d{n}") + epsilon), threshold), F.lit(False))
    tested = joined.select(*keys, flag.alias("flag"))
    return f.join(tested, keys, "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def distance(name: str) -> Callable[[Column], Column]:
    return lambda x: F.abs(x - F.col(name))


def array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def validate(f: DataFrame, specs: Sequence) -> DataFrame:
    """``outlier`` or-ed with every validator's flag; masked nodes are never outliers.

    A validator of one's own is a function of the rows (a DataFrame) that gives a boolean column; null flags nothing.
    """
    out = f
    for spec in specs:
        if callable(spec):
            out = out.withColumn("outlier", F.coalesce("outlier", F.lit(False)) | F.coalesce(spec(out), F.lit(False)))
            continue
        s = parse_validator(spec)
        if s.kind == "uod":
            out = outliers(out, s.threshold, s.neighborhood_size, s.epsilon).withColumn("outlier", F.coalesce("outlier", F.lit(False)) | F.col("flag")).drop("flag")
        else:
            out = out.withColumn("outlier", F.coalesce("outlier", F.lit(False)) | fails(s))
    return out.withColumn("outlier", F.col("outlier") & ~F.coalesce("masked", F.lit(False)))


def replace_outliers(f: DataFrame, max_radius: int | None = None) -> DataFrame:
    """Outliers get the median of valid nodes in the smallest square that holds three, however large (or ``max_radius`` at
    most); those of a frame without three valid nodes stay. A frame is one grid, and one call."""
    names, at = f.columns, {n: f.columns.index(n) for n in (*NODE, "u", "v", "masked", "outlier")}

    def run(part: pa.Table) -> pa.Table:
        gi, gj, u, v, masked, outlier = (part.column(at[n]).combine_chunks().to_numpy(zero_copy_only=False) for n in (*NODE, "u", "v", "masked", "outlier"))
        u, v = u.astype(float), v.astype(float)
        masked, outlier = (np.array([bool(x) for x in m]) if m.dtype == object else m for m in (masked, outlier))
        todo = outlier & ~masked
        if todo.any():
            u, v = neighbourhood.replace_at(gi - gi.min(), gj - gj.min(), u, v, todo, ~(outlier | masked | np.isnan(u) | np.isnan(v)), max_radius)
        new = {"u": pa.array(u), "v": pa.array(v)}
        return pa.Table.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(names)], names=names)

    run.__annotations__ = {"part": pa.Table, "return": pa.Table}
    return f.groupBy(KEY).applyInArrow(run, f.schema)


def smooth(f: DataFrame, values: Sequence[str] = ("u", "v")) -> DataFrame:
    """Binomial [1 2 1] / 4 along columns, then along rows, edges repeated."""
    out = f
    for along, over in (("gi", "gj"), ("gj", "gi")):
        w = Window.partitionBy(KEY, over).orderBy(along)
        out = out.withColumns({v: (F.coalesce(F.lag(v).over(w), F.col(v)) + 2 * F.col(v) + F.coalesce(F.lead(v).over(w), F.col(v))) / 4 for v in values})
    return out


def flow_derivatives(f: DataFrame, include_invalid: bool = False) -> DataFrame:
    """``f`` with dudx, dudy, dvdx, dvdy: central differences, one-sided next to an end or an invalid node, else NaN."""
    out = f.withColumn("_ok", valid(include_invalid=include_invalid))
    for axis, along, over in (("x", "gj", "gi"), ("y", "gi", "gj")):
        w = Window.partitionBy(KEY, over).orderBy(along)
        before, after = F.coalesce(F.lag("_ok").over(w), F.lit(False)), F.coalesce(F.lead("_ok").over(w), F.lit(False))
        new = {}
        for n in ("u", "v"):
            slope = lambda a, b, c, d: (a - b) / (c - d)
            here, at = F.col(n), F.col(axis)
            lo, hi, lo_at, hi_at = F.lag(n).over(w), F.lead(n).over(w), F.lag(axis).over(w), F.lead(axis).over(w)
            both = F.when(before & after, slope(hi, lo, hi_at, lo_at)).when(after, slope(hi, here, hi_at, at)).when(before, slope(here, lo, at, lo_at))
            new[f"d{n}d{axis}"] = F.when(F.col("_ok"), F.coalesce(both, F.lit(_NAN))).otherwise(F.lit(_NAN))
        out = out.withColumns(new)
    return out.drop("_ok")


def derived(f: DataFrame) -> DataFrame:
    """Adds vorticity, divergence, strain (xx, yy, xy, magnitude), swirling strength and Q to rows with derivatives."""
    ux, uy, vx, vy = (F.col(c) for c in ("dudx", "dudy", "dvdx", "dvdy"))
    xy = (uy + vx) / 2
    swirl = ux * vy - uy * vx - ((ux + vy) / 2) * ((ux + vy) / 2)
    return f.withColumns({
        "vorticity": vx - uy, "divergence": ux + vy, "strain_xx": ux, "strain_yy": vy, "strain_xy": xy,
        "strain_magnitude": F.sqrt(2 * (ux * ux + vy * vy + 2 * xy * xy)),
        "swirling_strength": F.when(F.isnan(swirl), F.lit(_NAN)).otherwise(F.sqrt(F.greatest(swirl, F.lit(0.0)))),
        "q_criterion": -(ux * ux + 2 * uy * vx + vy * vy) / 2,
    })


def extract_region(f: DataFrame, region, include_invalid: bool = False) -> DataFrame:
    """Valid nodes in a rectangle (x0, x1, y0, y1) or in a polygon of (x, y) vertices."""
    inside = in_rectangle("x", "y", *region) if len(region) == 4 and not isinstance(region[0], tuple) else in_polygon("x", "y", region)
    return f.filter(inside & valid(include_invalid=include_invalid))


def circulation_area(f: DataFrame, include_invalid: bool = False) -> DataFrame:
    """(frame, circulation): vorticity times each node's share of the area; an end node counts a whole spacing."""
    d = f if "dudx" in f.columns else flow_derivatives(f, include_invalid)
    for axis, along, over in (("x", "gj", "gi"), ("y", "gi", "gj")):
        w = Window.partitionBy(KEY, over).orderBy(along)
        lo, hi, at = F.lag(axis).over(w), F.lead(axis).over(w), F.col(axis)
        d = d.withColumn(f"_{axis}", F.when(lo.isNotNull() & hi.isNotNull(), F.abs(hi - lo) / 2).otherwise(F.abs(F.coalesce(hi, lo) - at)))
    w = F.col("dvdx") - F.col("dudy")
    return d.groupBy(KEY).agg(F.sum(F.when(~F.isnan(w), w * F.col("_x") * F.col("_y"))).alias("circulation"))


def sample(f: DataFrame, points: DataFrame, include_invalid: bool = False) -> DataFrame:
    """``points`` (frame, x, y, ..) with u, v between the four nodes around them; NaN outside or by an invalid node.

    The grid must be regular within a frame; spacing and origin come from the frame's own nodes. Points meet the cell that
    they lie in, whose corners are gathered from the nodes, so no row number has to be the same in two readings of the points.
    """
    good = valid(include_invalid=include_invalid)
    g = f.groupBy(KEY).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"), F.max("gj").alias("_nx"), F.max("gi").alias("_ny"))
    p = points.join(g, KEY)
    p = p.withColumn("_sx", (F.col("_x1") - F.col("_x0")) / F.greatest(F.col("_nx") - 1, F.lit(1))).withColumn("_sy", (F.col("_y1") - F.col("_y0")) / F.greatest(F.col("_ny") - 1, F.lit(1)))
    p = p.withColumn("_inside", in_between("x", "_x0", "_x1") & in_between("y", "_y0", "_y1"))
    j = F.least(F.greatest(F.floor(ratio(F.col("x") - F.col("_x0"), F.col("_sx"))), F.lit(0)), F.col("_nx") - 2)
    i = F.least(F.greatest(F.floor(ratio(F.col("y") - F.col("_y0"), F.col("_sy"))), F.lit(0)), F.col("_ny") - 2)
    p = p.withColumn("_j", j.cast("int")).withColumn("_i", i.cast("int"))
    p = p.withColumn("_q", (F.col("x") - F.col("_x0")) / F.col("_sx") - F.col("_j")).withColumn("_p", (F.col("y") - F.col("_y0")) / F.col("_sy") - F.col("_i"))
    places = [(a, b) for a in (0, 1) for b in (0, 1)]
    of = F.explode(F.array(*[F.struct((F.col("gi").cast("int") - 1 - a).alias("i"), (F.col("gj").cast("int") - 1 - b).alias("j"), F.lit(2 * a + b).alias("at")) for a, b in places])).alias("_c")
    node = f.filter(good).select(KEY, "u", "v", of).select(KEY, F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), "_c.at", "u", "v")
    corner = lambda n, k: F.max(F.when(F.col("at") == k, F.col(n))).alias(f"_{n}{k}")
    cells = node.groupBy(KEY, "_i", "_j").agg(F.count("*").alias("_n"), *[corner(n, k) for n in ("u", "v") for k in range(4)])
    ok = F.col("_inside") & (F.col("_n") == 4)
    weight = [(F.col("_p") if a else 1 - F.col("_p")) * (F.col("_q") if b else 1 - F.col("_q")) for a, b in places]
    between = {n: reduce(add, [F.col(f"_{n}{k}") * w for k, w in enumerate(weight)]) for n in ("u", "v")}
    got = p.join(cells, [KEY, "_i", "_j"], "left")
    return got.select(*points.columns, *[F.when(ok, c).otherwise(F.lit(_NAN)).alias(n) for n, c in between.items()])


def in_between(c: str, lo: str, hi: str) -> Column:
    return (col(c) >= col(lo)) & (col(c) <= col(hi))


def polyline(points: Sequence[tuple[float, float]], n: int) -> list[tuple[float, float, float]]:
    """n points (distance, x, y) at even distances along a line."""
    import numpy as np

    p = np.asarray(points, float)
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    at = np.linspace(0, s[-1], n)
    return list(zip(at.tolist(), np.interp(at, s, p[:, 0]).tolist(), np.interp(at, s, p[:, 1]).tolist(), strict=True))


def extract_profile(f: DataFrame, points: Sequence[tuple[float, float]], n: int = 100, include_invalid: bool = False) -> DataFrame:
    """(frame, sample, distance, x, y, u, v) along a line of points in every frame."""
    if len(points) < 2 or n < 2:
        raise ValueError("a profile has two points and two samples or more")
    line = F.explode(F.array(*[F.struct(F.lit(k).alias("sample"), F.lit(s).alias("distance"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (s, x, y) in enumerate(polyline(points, n), 1)]))
    return sample(f, f.select(KEY).distinct().select(KEY, line.alias("l")).select(KEY, "l.*"), include_invalid)


def circulation_contour(f: DataFrame, contour: Sequence[tuple[float, float]], close: bool = True, include_invalid: bool = False) -> DataFrame:
    """(frame, circulation) along a contour: 20 samples an edge, trapezoids; NaN if any sample is."""
    ends = [*contour, contour[0]] if close else list(contour)
    rows = []
    for e, ((xa, ya), (xb, yb)) in enumerate(zip(ends, ends[1:], strict=False)):
        for k in range(20):
            weight = (0.5 if k in (0, 19) else 1.0) / 19
            rows.append((e, k, xa + (xb - xa) * k / 19, ya + (yb - ya) * k / 19, (xb - xa) * weight, (yb - ya) * weight))
    line = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("edge", "k", "x", "y", "dx", "dy"), r, strict=True)]) for r in rows]))
    got = sample(f, f.select(KEY).distinct().select(KEY, line.alias("l")).select(KEY, "l.*"), include_invalid)
    return got.groupBy(KEY).agg(F.sum(F.col("u") * F.col("dx") + F.col("v") * F.col("dy")).alias("circulation"))


def error_statistics(f: DataFrame, u_ref: Column, v_ref: Column, include_invalid: bool = False) -> DataFrame:
    """One row: n, bias and RMS of u and v against reference columns, over valid nodes."""
    e = f.filter(valid(include_invalid=include_invalid)).select((F.col("u") - u_ref).alias("eu"), (F.col("v") - v_ref).alias("ev"))
    aggs = [F.count("*").alias("n")]
    for n in ("u", "v"):
        aggs += [F.avg(f"e{n}").alias(f"bias_{n}"), F.sqrt(F.avg(F.col(f"e{n}") * F.col(f"e{n}"))).alias(f"rms_{n}")]
    return e.agg(*aggs)


def peak_locking(values: DataFrame, value: str, nbins: int = 21) -> DataFrame:
    """(bin, centre, n, locking_index): fractional parts of displacements; near 1 when they stick to whole pixels."""
    x = F.col(value)
    frac = F.when(x - F.rint(x) == 0.5, F.lit(-0.5)).otherwise(x - F.rint(x))
    f = values.filter(x.isNotNull() & ~F.isnan(x)).select(frac.alias("f"))
    bins = f.groupBy(F.least(F.greatest(F.floor((F.col("f") + 0.5) * nbins) + 1, F.lit(1)), F.lit(nbins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.abs("f") <= 0.1).alias("c"), F.count_if(F.abs("f") >= 0.4).alias("e"))
    every = values.sparkSession.range(1, nbins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(bins, "bin", "left").na.fill(0)
    total = joined.agg(F.sum("c").alias("_c"), F.sum("e").alias("_e"))  # one row
    both = joined.crossJoin(F.broadcast(total))
    index = F.when(F.col("_c") + F.col("_e") > 0, (F.col("_c") - F.col("_e")) / (F.col("_c") + F.col("_e"))).otherwise(F.lit(_NAN))
    return both.select("bin", (-0.5 + (F.col("bin") - 0.5) / nbins).alias("centre"), "n", index.alias("locking_index"))


def filled_series(s: DataFrame, keys: Sequence[str], order: str, value: str, invalid: str = "error") -> DataFrame:
    """Series with invalid samples filled: 'mean', 'linear' between the nearest valid ones (ends held), or an error."""
    if invalid not in ("error", "mean", "linear"):
        raise ValueError("invalid is 'error', 'mean' or 'linear'")
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    if invalid == "error":
        return s.withColumn(value, F.coalesce(good, F.raise_error(F.lit("a series has invalid samples"))))
    every = Window.partitionBy(*keys)
    if invalid == "mean":
        return s.withColumn(value, F.coalesce(good, F.avg(good).over(every)))
    w = every.orderBy(order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(good.isNotNull(), F.col("_k"))
    out = s.withColumn("_k", F.row_number().over(w))
    lo, hi, lo_at, hi_at = F.last(good, True).over(back), F.first(good, True).over(on), F.last(at, True).over(back), F.first(at, True).over(on)
    between = lo + (hi - lo) * (F.col("_k") - lo_at) / F.when(hi_at > lo_at, hi_at - lo_at)
    return out.withColumn(value, F.coalesce(good, between, lo, hi)).drop("_k")


def power_spectrum(s: DataFrame, keys: Sequence[str], order: str, value: str, dt: float | str = 1.0, window: str = "hann") -> DataFrame:
    """(keys, k, frequency, psd) of each series: mean removed, one-sided. A series is one call and one fast transform.

    ``dt`` is a number, or a column: each series goes by its own (1 where it is null), and one of several is an error.
    """
    if window not in ("hann", "none"):
        raise ValueError("window is 'hann' or 'none'")
    each = F.coalesce(F.col(dt) if isinstance(dt, str) else F.lit(float(dt)), F.lit(1.0))
    rows, m = s.select(*keys, order, F.col(value).cast("double").alias("_x"), each.cast("double").alias("_dt")), len(keys)
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part.column(m)))
        x, steps = part.column(m + 1).to_numpy().astype(float), part.column(m + 2).to_numpy()
        n, step = len(x), steps[0]
        if (steps != step).any():
            raise ValueError("a series has frames of several lengths in time")
        w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))) if window == "hann" else np.ones(n)
        psd, k = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2, np.arange(n // 2 + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            psd = psd * 2 * step / (w**2).sum() * np.where((k == 0) | (2 * k == n), 0.5, 1.0)
        first = [part.column(i).take(pa.array(np.zeros(len(k), np.int64))) for i in range(m)]
        return pa.Table.from_arrays([*first, pa.array(k.astype(np.int32)), pa.array(k / (n * step)), pa.array(psd)], names=[*keys, "k", "frequency", "psd"])

    run.__annotations__ = {"part": pa.Table, "return": pa.Table}
    return rows.groupBy(*keys).applyInArrow(run, kinds + ", k int, frequency double, psd double")


def result_spectrum(f: DataFrame, value: str = "u", invalid: str = "mean", window: str = "hann", dt: float | None = None, scale: PhysicalScale | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Spectra of every node's series over frames (of each recording, if ``keys`` tell them apart): invalid samples filled.

    Time between frames is ``dt``, or the scale's: the one given, or the one that the series' own rows carry; else one frame.
    """
    step = dt if dt is not None else scale.dt if scale is not None else "scale_dt" if "scale_dt" in f.columns else 1.0
    usable = f.withColumn(value, F.when(valid(), F.col(value)))
    own = [*keys, *NODE]
    return power_spectrum(filled_series(usable, own, KEY, value, invalid), own, KEY, value, step, window)


def bin_to_grid(points: DataFrame, nx: int, ny: int, x0: float, y0: float, step: float, min_count: int = 3, key: str = KEY, gather: int = selection.GATHER) -> DataFrame:
    """Medians (selected, so a crowded node meets in no task) of scattered vectors about regular centres; every node has a row, those with too few are masked NaN."""
    at = lambda c, o, n: F.least(F.greatest(F.rint((F.col(c) - o) / step) + 1, F.lit(1.0)), F.lit(float(n))).cast("int")
    dealt = written(points.select(key, at("y", y0, ny).alias("gi"), at("x", x0, nx).alias("gj"), "u", "v"), "binned")
    b = dealt.groupBy(key, *NODE).agg(F.count("*").alias("n")).join(selection.quantiles(dealt, (key, *NODE), ("u", "v"), gather=gather).drop("n_u", "n_v"), [key, *NODE], "left")
    grid = points.select(key).distinct().withColumn("gi", F.explode(F.sequence(F.lit(1), F.lit(ny)))).withColumn("gj", F.explode(F.sequence(F.lit(1), F.lit(nx))))
    j = grid.join(b, [key, *NODE], "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= min_count
    return j.select(key, *NODE, (x0 + (F.col("gj") - 1) * step).alias("x"), (y0 + (F.col("gi") - 1) * step).alias("y"), *[F.when(enough, F.col(c)).otherwise(F.lit(_NAN)).alias(c) for c in ("u", "v")], F.coalesce("n", F.lit(0)).cast("long").alias("n"), (~enough).alias("masked"))


def transform_field(f: DataFrame, matrix, offset) -> DataFrame:
    """x' = A x + b, u' = A u."""
    mul = lambda a, b, r: float(matrix[r][0]) * F.col(a) + float(matrix[r][1]) * F.col(b)
    return f.withColumns({"x": mul("x", "y", 0) + float(offset[0]), "y": mul("x", "y", 1) + float(offset[1]), "u": mul("u", "v", 0), "v": mul("u", "v", 1)})


SCALE = ("scale_pixel_size", "scale_dt", "scale_length_unit", "scale_time_unit")


def with_scale(f: DataFrame, scale: PhysicalScale | None) -> DataFrame:
    """``f`` with a scale attached (columns SCALE, values untouched) or, with None, without one."""
    f = f.drop(*SCALE)
    return f if scale is None else f.withColumns(dict(zip(SCALE, map(F.lit, (scale.pixel_size, scale.dt, scale.length_unit, scale.time_unit)), strict=True)))


def attached_scale(f: DataFrame) -> PhysicalScale | None:
    """The scale that all rows carry; None without one or without rows. Rows of several have none in common, which is an error."""
    if not set(SCALE) <= set(f.columns):
        return None
    known = f.select(*SCALE).distinct().limit(2).collect()
    if len(known) > 1:
        raise ValueError("the rows carry several scales")
    return PhysicalScale(*known[0]) if known and known[0][0] is not None else None


def physical(f: DataFrame, scale: PhysicalScale | None = None) -> DataFrame:
    """Positions and residuals times the pixel size, displacements and deviations also by time; done once, as units tell.

    Without a scale each row goes by the one that it carries (columns SCALE); rows without either stay as they are.
    """
    if scale is None and not set(SCALE) <= set(f.columns):
        return f
    size, dt, length, time = (F.col(c) for c in SCALE) if scale is None else (F.lit(v) for v in (scale.pixel_size, scale.dt, scale.length_unit, scale.time_unit))
    if "length_unit" not in f.columns:
        f = f.withColumns({"length_unit": F.lit("px"), "time_unit": F.lit("frame"), "velocity_unit": F.lit("px/frame")})
    todo = (F.col("length_unit") == "px") & size.isNotNull() & dt.isNotNull()
    by = dict.fromkeys(("x", "y", "z", "match_residual"), size) | dict.fromkeys(("u", "v", "w", "uncertainty_u", "uncertainty_v", "uncertainty_w"), size / dt)
    new = {c: F.when(todo, F.col(c) * k).otherwise(F.col(c)) for c, k in by.items() if c in f.columns}
    units = {"length_unit": length, "time_unit": time, "velocity_unit": F.concat(length, F.lit("/"), time)}
    return f.withColumns(new | {c: F.when(todo, v).otherwise(F.col(c)) for c, v in units.items()})


def color_limits(f: DataFrame, value: str, gather: int = selection.GATHER) -> DataFrame:
    """(lo, hi): the 2nd and 98th percentile by nearest rank of valid values, half a unit about it where they're equal."""
    good = f.filter(valid()).select(F.col(value).alias("lo"))
    n = F.col("_n")
    ends = [F.greatest(F.ceil(q * n) - 1, F.lit(0)) for q in (0.02, 0.98)]
    got = selection.ranked(good, (), ("lo",), ends, gather)
    v = got.agg(*[F.max(F.when(F.col("_rank") == r, F.col("_value"))).alias(c) for r, c in enumerate(("lo", "hi"))])
    same = F.col("lo") == F.col("hi")
    return v.select(F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))


def arrow_scale(f: DataFrame, gather: int = selection.GATHER) -> DataFrame:
    """(length): 0.99 quantile of valid magnitudes."""
    return selection.quantiles(f.filter(valid()).select(F.hypot("u", "v").alias("length")), (), ("length",), 0.99, gather=gather).select("length")
