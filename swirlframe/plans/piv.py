"""Image velocimetry over recordings: one Python call a batch of pairs, all passes of a pair without leaving its task."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import geometry, neighbourhood, piv, uncertainty
from ..kernels.correlation import BATCH, analyze, find_peaks
from ..kernels.deformation import Spline, deform, field_at
from ..operators.recordings import with_pixels
from ..params import PIVParameters, effort_schedule
from ..schema import STEREO, VECTORS


def schedule(passes, effort: str | None, shape: tuple[int, int], ensemble: bool = False) -> list[PIVParameters]:
    if passes is None:
        return effort_schedule(effort or "medium", ensemble, shape)
    return list(passes) if isinstance(passes, (list, tuple)) else [passes]


def image(flat, n_rows: int, n_cols: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(n_rows, n_cols)


def field_batch(pair_id: int, f: piv.Field) -> pa.RecordBatch:
    """A field's nodes in column order as VECTORS."""
    ny, nx = f.u.shape
    gj, gi = (a.ravel() for a in np.mgrid[1 : nx + 1, 1 : ny + 1])
    flat = lambda a: pa.array(np.ascontiguousarray(a.T).ravel())
    cols = [pa.array(np.full(gi.size, pair_id, np.int64)), pa.array(gi.astype(np.int32)), pa.array(gj.astype(np.int32)), pa.array(f.x[gj - 1].astype(float)), pa.array(f.y[gi - 1].astype(float))]
    cols += [flat(a.astype(float)) for a in (f.u, f.v, f.peak_ratio, f.correlation_moment, f.uncertainty_u, f.uncertainty_v)] + [flat(f.outliers), flat(f.mask)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in VECTORS.split(", ")])


def run_piv_sequence(pairs: DataFrame, frames: DataFrame | None = None, passes=None, effort: str | None = None, mask: np.ndarray | None = None, mask_threshold: float = 0.5, preprocess: Callable | None = None, roi=None, pair_mask: Callable | None = None, keys: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> DataFrame:
    """VECTORS of every pair, and its ``labels`` (columns of ``pairs``, such as its frames' sources). ``pairs`` has pixels_a, pixels_b,
    n_rows, n_cols, or gets them from ``frames``.

    A pair's own column ``mask`` (array<boolean>, row-major; ``recordings.with_masks``), the given mask and ``pair_mask(a, b, pair_id)`` are united. A mask
    given or called may be two, one for each image; a function of two arguments goes without the pair's number.
    """
    rows = pairs if frames is None else with_pixels(pairs, frames, keys=keys)
    own = "mask" in rows.columns
    kinds = "".join(f", `{c}` {dict(rows.dtypes)[c]}" for c in labels)
    rows = rows.select("pair_id", "n_rows", "n_cols", "pixels_a", "pixels_b", *labels, *(["mask"] if own else []))
    numbered = pair_mask is not None and len(inspect.signature(pair_mask).parameters) > 2
    given = either_mask(mask)
    mask_at = 5 + len(labels)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                get = lambda c, r=r, part=part: part.column(c)[r].values.to_numpy(zero_copy_only=False)
                pair, nr, nc = (part.column(c)[r].as_py() for c in (0, 1, 2))
                a, b = image(get(3), nr, nc), image(get(4), nr, nc)
                if preprocess is not None:
                    a, b = preprocess(a), preprocess(b)
                m = given
                if own and part.column(mask_at)[r].is_valid:
                    mine = get(mask_at).reshape(nr, nc).astype(bool)
                    m = mine if m is None else m | mine
                if pair_mask is not None:
                    called = either_mask(pair_mask(a, b, pair) if numbered else pair_mask(a, b))
                    m = called if m is None else m if called is None else m | called
                out = field_batch(pair, piv.run(a, b, schedule(passes, effort, a.shape), m, mask_threshold, roi=roi))
                same = pa.array(np.full(out.num_rows, r))
                yield pa.RecordBatch.from_arrays([*out.columns, *[part.column(5 + k).take(same) for k in range(len(labels))]], names=[*out.schema.names, *labels])

    return rows.mapInArrow(run, VECTORS + kinds)


def either_mask(mask) -> np.ndarray | None:
    """One mask of a mask, of two (one for each image), or of none."""
    if isinstance(mask, tuple):
        one, two = mask
        return two if one is None else one if two is None else one | two
    return mask


PEAKS = "pair_id long, gi int, gj int, rank int, lag_v int, lag_u int, value double, du double, dv double, peak_ratio double, correlation_moment double"


def correlation_peaks(pairs: DataFrame, frames: DataFrame | None = None, p: PIVParameters | None = None, keys: tuple[str, ...] = (), mask_threshold: float = 0.5) -> DataFrame:
    """PEAKS: the ``p.n_peaks`` best peaks of every window's plane of every pair, with their whole lags, the first refined as
    ``p`` says, others by three points; ratio and moment are the window's. One pass, without a predictor. A pair's column ``mask``
    (array<boolean>) leaves its pixels out, and windows with a share ``mask_threshold`` of such pixels have no peaks."""
    p = p or PIVParameters()
    rows = pairs if frames is None else with_pixels(pairs, frames, keys=keys)
    own = ["mask"] if "mask" in rows.columns else []
    rows = rows.select(F.col("pair_id").cast("long"), "n_rows", "n_cols", "pixels_a", "pixels_b", *own)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                pair, nr, nc = (part.column(c)[r].as_py() for c in range(3))
                a, b = (image(part.column(c)[r].values.to_numpy(zero_copy_only=False), nr, nc) for c in (3, 4))
                m = part.column(5)[r].values.to_numpy(zero_copy_only=False).reshape(nr, nc).astype(bool) if own and part.column(5)[r].is_valid else None
                g = piv.grid(a.shape, p, m, mask_threshold)
                for at in range(0, len(g.rows), BATCH):
                    yield from _peak_rows(pair, g.gi[at : at + BATCH], g.gj[at : at + BATCH], piv.job_planes(g, a, b, p, m, slice(at, at + BATCH)), p)

    return rows.mapInArrow(run, PEAKS)


def ensemble_peaks(pairs: DataFrame, p: PIVParameters) -> DataFrame:
    """PEAKS of planes summed over all pairs (one pass; ``pair_id`` is 0)."""
    first = pairs.select("n_rows", "n_cols").first()
    g = piv.grid((first.n_rows, first.n_cols), p)
    fft = tuple(2 * s for s in p.search_area_size) if p.padding else p.search_area_size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                job = part.column(0).to_numpy()
                yield from _peak_rows(0, g.gi[job], g.gj[job], np.stack([np.asarray(x) for x in part.column(1).to_pylist()]).reshape(-1, *fft), p)

    return ensemble_sums(pairs, p, None).mapInArrow(run, PEAKS)


def _peak_rows(pair: int, gi: np.ndarray, gj: np.ndarray, planes: np.ndarray, p: PIVParameters) -> Iterator[pa.RecordBatch]:
    x = analyze(planes, p.n_peaks, p.subpixel_method, p.peak_finder)
    values, rows, cols = find_peaks(planes, max(2, p.n_peaks), p.peak_finder)
    lags = rows - planes.shape[1] // 2, cols - planes.shape[2] // 2
    for m in range(p.n_peaks):
        some = ~np.isnan(values[:, m])
        if not some.any():
            continue
        du, dv = (x["du"], x["dv"]) if m == 0 else (x["alt_u"][:, m], x["alt_v"][:, m])
        out = [np.full(some.sum(), pair, np.int64), *[c[some].astype(np.int32) for c in (gi + 1, gj + 1, np.full(len(gi), m + 1), lags[0][:, m], lags[1][:, m])]]
        out += [c[some].astype(float) for c in (values[:, m], du, dv, x["peak_ratio"], x["moment"])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[c.split()[0] for c in PEAKS.split(", ")])


def each_result(results: DataFrame, output: Callable[[int, pd.DataFrame], None], cancelled: Callable[[], bool] | None = None, key: str = "pair_id") -> int:
    """Calls ``output(pair, rows)`` for every pair's rows, in order of pairs, and returns how many there were.

    The driver holds one partition's rows at a time. ``cancelled`` is asked before each pair; when it says so, what has
    come out stays, and nothing else is computed. An exception of ``output`` ends the run as well.
    """
    names, held, last, n = results.columns, [], None, 0
    for row in results.repartitionByRange(key).sortWithinPartitions(key).toLocalIterator():
        if last is not None and row[key] != last:
            if cancelled is not None and cancelled():
                return n
            output(last, pd.DataFrame(held, columns=names))
            held, n = [], n + 1
        last = row[key]
        held.append(tuple(row))
    if held and not (cancelled is not None and cancelled()):
        output(last, pd.DataFrame(held, columns=names))
        n += 1
    return n


def run_piv(a: np.ndarray, b: np.ndarray, passes=None, effort: str | None = None, mask=None, roi=None, mask_threshold: float = 0.5) -> piv.Field:
    """One pair on the driver, for interactive use; recordings go through run_piv_sequence."""
    return piv.run(np.asarray(a, float), np.asarray(b, float), schedule(passes, effort, a.shape), mask, mask_threshold, roi=roi)


def ensemble_sums(pairs: DataFrame, p: PIVParameters, pred, mask=None, mask_threshold: float = 0.5, preprocess: Callable | None = None) -> DataFrame:
    """(job, plane array, su array, sv array): sums over pairs of each window's plane and uncertainty terms.

    Tasks add up their own pairs first, so a task sends one row a window whatever the number of pairs; the rows of
    a window are then added in array form by the final aggregation.
    """

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = su = sv = None
        for part in parts:
            for r in range(part.num_rows):
                nr, nc = part.column(0)[r].as_py(), part.column(1)[r].as_py()
                a, b = (image(part.column(c)[r].values.to_numpy(zero_copy_only=False), nr, nc) for c in (2, 3))
                if preprocess is not None:
                    a, b = preprocess(a), preprocess(b)
                g = piv.grid(a.shape, p, mask, mask_threshold)
                if pred is not None:
                    a, b = deform(Spline(a), Spline(b), *pred)
                for at in range(0, len(g.rows), BATCH):
                    s = slice(at, at + BATCH)
                    plane = piv.job_planes(g, a, b, p, mask, s).astype(float)
                    if total is None:
                        total = np.zeros((len(g.rows), plane[0].size))
                        su, sv = np.zeros((len(g.rows), 44)), np.zeros((len(g.rows), 44))
                    total[s] += plane.reshape(len(plane), -1)
                    if p.uncertainty:
                        for into, x in zip((su, sv), piv.job_sums(g, a, b, p, mask, s), strict=True):
                            into[s] += x
        if total is not None:
            for at in range(0, len(total), BATCH):
                s = slice(at, at + BATCH)
                lists = [pa.array(list(x[s]), pa.list_(pa.float64())) for x in (total, su, sv)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)[s]), *lists], names=["job", "plane", "su", "sv"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, held = None, None
        for part in parts:
            sums = [np.stack([np.asarray(x) for x in part.column(c).to_pylist()]).sum(axis=0) for c in (1, 2, 3)]
            job, held = part.column(0)[0], sums if held is None else [a + b for a, b in zip(held, sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([job.as_py()], pa.int32()), *[pa.array([x], pa.list_(pa.float64())) for x in held]], names=["job", "plane", "su", "sv"])

    merge.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    kind = "job int, plane array<double>, su array<double>, sv array<double>"
    return pairs.select("n_rows", "n_cols", "pixels_a", "pixels_b").mapInArrow(add, kind).groupBy("job").applyInArrow(merge, kind)


def run_piv_ensemble(pairs: DataFrame, passes=None, effort: str | None = None, mask=None, mask_threshold: float = 0.5, preprocess: Callable | None = None) -> piv.Field:
    """One field of all pairs: planes are summed over pairs before peaks are sought. One Spark job a pass.

    The driver holds one grid's planes a block at a time; images stay on the executors.
    """
    first = pairs.select("n_rows", "n_cols").first()
    if first is None:
        raise ValueError("an ensemble has one pair or more")
    shape = (first.n_rows, first.n_cols)
    steps, pred, f = schedule(passes, effort, shape, True), None, None
    for k, p in enumerate(steps):
        last = k + 1 == len(steps)
        if f is not None:
            pred = piv.predictor(f)
        g = piv.grid(shape, p, mask, mask_threshold)
        fft = tuple(2 * s for s in p.search_area_size) if p.padding else p.search_area_size
        got: dict[str, np.ndarray] = {}

        def peaks(parts: Iterator[pa.RecordBatch], p=p, fft=fft) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if not part.num_rows:
                    continue
                r = np.stack([np.asarray(x) for x in part.column(1).to_pylist()]).reshape(-1, *fft)
                x = analyze(r, p.n_peaks, p.subpixel_method, p.peak_finder)
                s = [uncertainty.deviation(np.stack([np.asarray(v) for v in part.column(c).to_pylist()])) if p.uncertainty else np.full(part.num_rows, np.nan) for c in (2, 3)]
                lists = [pa.array(list(x[c]), pa.list_(pa.float64())) for c in ("alt_u", "alt_v")]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x[c].astype(float)) for c in ("du", "dv", "peak_ratio", "moment")], *[pa.array(v) for v in s], *lists], names=["job", "du", "dv", "ratio", "moment", "su", "sv", "alt_u", "alt_v"])

        rows = ensemble_sums(pairs, p, pred, mask, mask_threshold, preprocess).mapInArrow(peaks, "job int, du double, dv double, ratio double, moment double, su double, sv double, alt_u array<double>, alt_v array<double>").orderBy("job").collect()
        got = {n: np.array([r[n] for r in rows], float) for n in ("du", "dv", "ratio", "moment", "su", "sv", "alt_u", "alt_v")}
        nan = np.where(g.mask, np.nan, 0.0)
        u0, v0 = (np.zeros(g.mask.shape),) * 2 if pred is None else (field_at(pred[0], pred[1], x, g.x, g.y) for x in pred[2:])
        put = lambda n, fill, g=g, got=got: piv.scatter(g, got[n], fill)
        f = piv.Field(g.x, g.y, u0 + put("du", 0.0) + nan, v0 + put("dv", 0.0) + nan, put("ratio", np.nan), put("moment", np.nan), put("su", np.nan), put("sv", np.nan), np.zeros(g.mask.shape, bool), g.mask)
        alt = (put("alt_u", np.nan) + u0[..., None], put("alt_v", np.nan) + v0[..., None]) if p.n_peaks > 1 else None
        f = piv.validate(f, p, not last, alt)
    return f


def combine_stereo(f1: piv.Field, f2: piv.Field, c1: geometry.Camera, c2: geometry.Camera, grid: geometry.DewarpGrid) -> dict[str, np.ndarray]:
    """Three components on the nodes of two fields of dewarped images."""
    sx = float(grid.x[1] - grid.x[0])
    sy = float(grid.y[1] - grid.y[0])
    gx, gy = np.meshgrid(grid.x[0] + (f1.x - 1) * sx, grid.y[0] + (f1.y - 1) * sy)
    world = np.column_stack([gx.ravel(), gy.ravel(), np.full(gx.size, grid.z)])
    step = max(abs(sx), abs(sy))
    t1, t2 = geometry.ray_slopes(c1, world, step), geometry.ray_slopes(c2, world, step)
    r = lambda a: a.ravel()
    out, dev = geometry.reconstruct(t1, t2, r(f1.u), r(f1.v), r(f2.u), r(f2.v), sx, sy, (r(f1.uncertainty_u), r(f1.uncertainty_v)), (r(f2.uncertainty_u), r(f2.uncertainty_v)))
    shape = f1.u.shape
    mask = f1.mask | f2.mask | ~np.isfinite(out).all(axis=1).reshape(shape)
    return {"x": gx, "y": gy, "d": out.reshape(*shape, 3), "dev": np.abs(dev).reshape(*shape, 3), "outliers": (f1.outliers | f2.outliers) & ~mask, "mask": mask}


def _stereo_batch(pair: int, s: dict, z: float) -> pa.RecordBatch:
    ny, nx = s["mask"].shape
    gj, gi = (a.ravel() for a in np.mgrid[1 : nx + 1, 1 : ny + 1])
    flat = lambda a: pa.array(np.ascontiguousarray(a.T).ravel())
    d = np.where(s["mask"][..., None], np.nan, s["d"])
    cols = [pa.array(np.full(gi.size, pair, np.int64)), pa.array(gi.astype(np.int32)), pa.array(gj.astype(np.int32)), flat(s["x"]), flat(s["y"]), pa.array(np.full(gi.size, float(z)))]
    cols += [flat(d[..., k]) for k in range(3)] + [flat(s["dev"][..., k]) for k in range(3)] + [flat(s["outliers"]), flat(s["mask"])]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in STEREO.split(", ")])


def run_piv_stereo_sequence(pairs: DataFrame, d1: geometry.Dewarper, d2: geometry.Dewarper, passes=None, effort: str | None = None, preprocess: tuple | None = None, mask_threshold: float = 0.5, mask: np.ndarray | tuple | None = None) -> DataFrame:
    """STEREO of pairs with pixels_a1, pixels_b1, pixels_a2, pixels_b2 (raw images of the two cameras; ``timing.synchronised`` finds who belongs together).

    ``mask``, on the dewarped grid, one or one for each camera, goes to what the dewarpers leave out.
    """
    p1, p2 = preprocess or (None, None)
    given = either_mask(mask)
    if given is not None and given.shape != d1.mask.shape:
        raise ValueError("the mask is on the dewarped grid")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                raw = [part.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float) for c in range(1, 5)]
                a1, b1, a2, b2 = (d(pre(i.reshape(d.size)) if pre else i.reshape(d.size)) for i, d, pre in zip(raw, (d1, d1, d2, d2), (p1, p1, p2, p2), strict=True))
                left_out = d1.mask | d2.mask if given is None else d1.mask | d2.mask | given
                steps = schedule(passes, effort, a1.shape)
                f1, f2 = (piv.run(a, b, steps, left_out if left_out.any() else None, mask_threshold) for a, b in ((a1, b1), (a2, b2)))
                yield _stereo_batch(part.column(0)[r].as_py(), combine_stereo(f1, f2, d1.camera, d2.camera, d1.grid), d1.grid.z)

    return pairs.select("pair_id", "pixels_a1", "pixels_b1", "pixels_a2", "pixels_b2").mapInArrow(run, STEREO)


def _dewarped(pairs: DataFrame, d: geometry.Dewarper, a: str, b: str) -> DataFrame:
    shape = d.mask.shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                out = [d(part.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float).reshape(d.size)).ravel() for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(r, 1), pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), *[pa.array([x], pa.list_(pa.float64())) for x in out]], names=["pair_id", "n_rows", "n_cols", "pixels_a", "pixels_b"])

    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), a, b).mapInArrow(run, "pair_id long, n_rows int, n_cols int, pixels_a array<double>, pixels_b array<double>")


def run_piv_stereo_ensemble(pairs: DataFrame, d1: geometry.Dewarper, d2: geometry.Dewarper, passes=None, effort: str | None = None) -> dict[str, np.ndarray]:
    """Three components of two ensembles."""
    mask = d1.mask | d2.mask
    fields = [run_piv_ensemble(_dewarped(pairs, d, f"pixels_a{k}", f"pixels_b{k}"), passes, effort, mask if mask.any() else None) for k, d in ((1, d1), (2, d2))]
    return combine_stereo(*fields, d1.camera, d2.camera, d1.grid)


@dataclass
class SelfCalibration:
    """What self-calibration did: a measurement each turn (disparity, plane, n), the last one of the result; whether its
    disparity is below the tolerance; R and t, which take new world coordinates to the old ones."""

    turns: list[dict]
    converged: bool
    R: np.ndarray
    t: np.ndarray


def self_calibrate(frames: DataFrame, d1: geometry.Dewarper, d2: geometry.Dewarper, iterations: int = 3, tol: float = 0.05, limit: float = 0.5, passes=None, mask: np.ndarray | None = None, preprocess: tuple | None = None) -> tuple[geometry.Dewarper, geometry.Dewarper, SelfCalibration]:
    """Dewarpers of cameras moved onto the light sheet by the disparity of simultaneous images (pixels_1, pixels_2).

    After at most ``iterations`` corrections a closing measurement tells what is left. ``mask`` is on the dewarped grid,
    ``preprocess`` a function for each camera's raw images. Each turn is one ensemble job over the frames; only its grid
    comes to the driver.
    """
    turns, converged, R, t = [], False, np.eye(3), np.zeros(3)
    w = min(128, 1 << int(np.log2(max(min(d1.mask.shape) // 2, 8))))
    steps = passes or [PIVParameters((w, w), overlap=(w // 2, w // 2), padding=True, apodization="gauss"), PIVParameters((max(w // 2, 8),) * 2, overlap=(max(w // 4, 4),) * 2, padding=True, apodization="gauss")]
    grid = d1.grid
    sx, sy = float(grid.x[1] - grid.x[0]), float(grid.y[1] - grid.y[0])
    for k in range(iterations + 1):
        out = d1.mask | d2.mask if mask is None else d1.mask | d2.mask | mask
        f = run_piv_ensemble(_simultaneous(frames, d1, d2, preprocess), steps, mask=out if out.any() else None)
        gx, gy = np.meshgrid(grid.x[0] + (f.x - 1) * sx, grid.y[0] + (f.y - 1) * sy)
        ok = ~f.mask & ~f.outliers & np.isfinite(f.u)
        rms = float(np.sqrt((f.u[ok] ** 2 + f.v[ok] ** 2).mean())) if ok.any() else float("nan")
        turns.append({"disparity": rms, "plane": None, "n": 0})
        converged = rms < tol
        if converged or k == iterations:
            break
        world = np.column_stack([gx[ok], gy[ok], np.full(int(ok.sum()), grid.z)])
        points, kept = geometry.triangulate(d1.camera, d2.camera, world, np.column_stack([f.u[ok] * sx, f.v[ok] * sy]), limit)
        turns[-1]["n"] = int(kept.sum())
        if kept.sum() < 3:
            break
        turns[-1]["plane"] = plane = geometry.sheet_plane(points[kept])
        turn, move = geometry.plane_transform(*plane, d1.camera, grid.z, max(abs(sx), abs(sy)))
        R, t = R @ turn, R @ move + t
        d1, d2 = (geometry.Dewarper(geometry.transformed(d.camera, turn, move), grid, d.size) for d in (d1, d2))
    return d1, d2, SelfCalibration(turns, converged, R, t)


def _simultaneous(frames: DataFrame, d1: geometry.Dewarper, d2: geometry.Dewarper, preprocess: tuple | None = None) -> DataFrame:
    shape = d1.mask.shape
    p1, p2 = preprocess or (None, None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                raw = [part.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float).reshape(d.size) for c, d in ((0, d1), (1, d2))]
                out = [d(p(i) if p else i).ravel() for i, d, p in zip(raw, (d1, d2), (p1, p2), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), *[pa.array([x], pa.list_(pa.float64())) for x in out]], names=["n_rows", "n_cols", "pixels_a", "pixels_b"])

    return frames.select("pixels_1", "pixels_2").mapInArrow(run, "n_rows int, n_cols int, pixels_a array<double>, pixels_b array<double>")


def benchmark(a: np.ndarray, b: np.ndarray, configurations: dict[str, list[PIVParameters]], repeats: int = 3) -> list[dict]:
    """Least seconds of each configuration, and its largest and 99th percentile difference from the first."""
    import time

    out, base = [], None
    for name, passes in configurations.items():
        times, f = [], None
        for _ in range(repeats):
            start = time.perf_counter()
            f = piv.run(a, b, passes)
            times.append(time.perf_counter() - start)
        base = base or f
        same = base.u.shape == f.u.shape
        d = np.abs(np.stack([f.u - base.u, f.v - base.v])) if same else np.array([np.nan])
        out.append({"name": name, "seconds": min(times), "max_delta": float(np.nanmax(d)) if same else float("nan"), "p99_delta": float(np.nanquantile(d, 0.99)) if same else float("nan")})
    return out


__all__ = ["run_piv", "run_piv_sequence", "run_piv_ensemble", "run_piv_stereo_sequence", "run_piv_stereo_ensemble", "self_calibrate", "benchmark", "neighbourhood"]


def smooth_fields(vectors: DataFrame, s: float | None = None, robust: bool = False, key: str = "pair_id") -> DataFrame:
    """``vectors`` with u, v smoothed by penalised least squares, a frame at a time; outliers and masked nodes get no weight."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["gi"] - 1, rows["gj"] - 1
        shape = int(rows["gi"].max()), int(rows["gj"].max())
        weight = np.zeros(shape)
        weight[at] = ~(rows["outlier"] | rows["masked"])
        out = rows.copy()
        for c in ("u", "v"):
            f = np.full(shape, np.nan)
            f[at] = rows[c]
            out[c] = neighbourhood.smoothn(f, s, weight, robust)[at]
        return out

    return vectors.groupBy(key).applyInPandas(run, vectors.schema)
