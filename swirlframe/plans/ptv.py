"""Particle detection, matching and tracking over recordings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import particles, piv
from ..operators.fields import with_scale
from ..operators.recordings import with_pixels
from ..params import ROI, PhysicalScale, PTVParameters, effort_schedule
from ..schema import MATCHES, PARTICLES, TRACKS


def detect_particles(frames: DataFrame, params: PTVParameters | None = None, mask: np.ndarray | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """PARTICLES (and keys) of every frame: frames are independent, rows come out brightest first."""
    p = params or PTVParameters()
    rows = frames.select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), "n_rows", "n_cols", "pixels")
    n = len(keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                shape = part.column(n + 1)[r].as_py(), part.column(n + 2)[r].as_py()
                got = particles.detect(part.column(n + 3)[r].values.to_numpy(zero_copy_only=False).reshape(shape), p, mask)
                k = len(got["x"])
                same = [part.column(c).take(pa.array([r] * k, pa.int64())) for c in range(n + 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(1, k + 1, dtype=np.int32)), *[pa.array(got[c].astype(float)) for c in particles.FIELDS]], names=[*keys, "frame_idx", "particle_id", *particles.FIELDS])

    kinds = "".join(f"{k} {dict(frames.dtypes)[k]}, " for k in keys)
    return rows.mapInArrow(run, kinds + PARTICLES)


PREDICTOR = "array<struct<gi:int,gj:int,x:double,y:double,u:double,v:double,masked:boolean>>"


def with_predictors(pairs: DataFrame, fields: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` with predictor: the nodes of the field of the same pair (one grid each, as VECTORS has them); null without one."""
    masked = F.col("masked") if "masked" in fields.columns else F.lit(False)
    node = F.struct(*[F.col(c).cast("int" if c in ("gi", "gj") else "double").alias(c) for c in ("gi", "gj", "x", "y", "u", "v")], masked.alias("masked"))
    own = [*keys, "pair_id"]
    return pairs.join(fields.groupBy(*own).agg(F.collect_list(node).alias("predictor")), own, "left")


def _grid_of(nodes: pa.Array, smoothing: bool) -> tuple[np.ndarray, ...] | None:
    """(x, y, u, v) of a pair's nodes, masked ones filled and all smoothed as between passes, or as they are."""
    if not len(nodes):
        return None
    gi, gj, x, y, u, v, masked = (nodes.field(k).to_numpy(zero_copy_only=False) for k in range(7))
    ny, nx = int(gi.max()), int(gj.max())
    if len(nodes) != nx * ny:
        raise ValueError("a predictor has every node of its grid once")
    put = lambda values, kind=float: _placed(values, gi, gj, (ny, nx), kind)
    gx, gy, fu, fv, bad = put(x)[0], put(y)[:, 0], put(u), put(v), put(masked, bool)
    none = np.full((ny, nx), np.nan)
    f = piv.Field(gx, gy, fu, fv, none, none, none, none, np.zeros((ny, nx), bool), bad)
    return piv.predictor(f, smoothing)


def _placed(values: np.ndarray, gi: np.ndarray, gj: np.ndarray, shape: tuple[int, int], kind: type) -> np.ndarray:
    out = np.zeros(shape, kind)
    out[gi - 1, gj - 1] = values
    return out


def run_ptv_sequence(pairs: DataFrame, frames: DataFrame | None = None, params: PTVParameters | None = None, predictor: str | DataFrame | tuple | None = "piv", passes=None, mask: np.ndarray | None = None, roi: ROI | None = None, scale: PhysicalScale | None = None, smoothing: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """MATCHES of every pair, with a ``scale`` attached if one is given.

    ``predictor`` 'piv' takes a window correlation of the same pair, None no prediction, a DataFrame the field of the same pair (such as
    ``run_piv_sequence`` gives; smoothed as between passes unless told not to), and (x, y, u, v) one grid for all. Between nodes it is
    bilinear, beyond them that of the border. ``roi`` cuts images and mask; positions are of the whole image.
    """
    p = params or PTVParameters()
    if not isinstance(predictor, (DataFrame, tuple)) and predictor not in (None, "piv"):
        raise ValueError("a predictor is 'piv', None, a DataFrame of fields or (x, y, u, v)")
    table = isinstance(predictor, DataFrame)
    rows = pairs if frames is None else with_pixels(pairs, frames, keys=keys)
    rows = with_predictors(rows, predictor, keys) if table else rows
    rows = rows.select(F.col("pair_id").cast("long"), "n_rows", "n_cols", "pixels_a", "pixels_b", *([F.col("predictor").cast(PREDICTOR)] if table else []))
    names = [c.split()[0] for c in MATCHES.split(", ")]
    given = None if not isinstance(predictor, tuple) else tuple(np.asarray(c, float) for c in predictor)
    by_piv = given is None and not table and predictor == "piv"
    top, left = (roi.r0 - 1, roi.c0 - 1) if roi else (0, 0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                nr, nc = part.column(1)[r].as_py(), part.column(2)[r].as_py()
                a, b = (part.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float).reshape(nr, nc) for c in (3, 4))
                m = mask
                if roi is not None:
                    cut = slice(roi.r0 - 1, roi.r1), slice(roi.c0 - 1, roi.c1)
                    a, b, m = a[cut], b[cut], mask if mask is None or mask.shape == a[cut].shape else mask[cut]
                pred = given
                if table:
                    pred = _grid_of(part.column(5)[r].values, smoothing) if part.column(5)[r].is_valid else None
                elif by_piv:
                    pred = piv.predictor(piv.run(a, b, passes or effort_schedule("medium", image_size=a.shape), m))
                if pred is not None and not by_piv:
                    pred = pred[0] - left, pred[1] - top, *pred[2:]
                found = particles.track_pair(particles.detect(a, p, m), particles.detect(b, p, m), p, pred)
                found["x"], found["y"] = found["x"] + left, found["y"] + top
                k = len(found["x"])
                cols = [pa.array(np.full(k, part.column(0)[r].as_py(), np.int64))] + [pa.array(found[n].astype(np.int32) if n.startswith("index") else found[n]) for n in names[1:]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return with_scale(rows.mapInArrow(run, MATCHES), scale) if scale is not None else rows.mapInArrow(run, MATCHES)


def track_particles(found: DataFrame, params: PTVParameters | None = None, min_track_length: int = 3, max_gap: int = 0, initial=None, shape: tuple[int, int] | None = None, recording: str = "recording") -> DataFrame:
    """TRACKS of PARTICLES by recording. Detection is parallel over frames; linking runs in order within a recording.

    Particles stream through sorted by frame: a task holds one frame and the open tracks, and a track leaves it when it ends.
    Tracks are numbered afterwards, by first frame and place. Particles without a frame are in none.
    """
    p = params or PTVParameters()
    rows = found.select(F.col(recording).cast("string").alias("recording"), F.col("frame_idx").cast("long").alias("frame"), "x", "y", "intensity", "diameter", "particle_id")
    rows = rows.filter("frame is not null").repartition("recording").sortWithinPartitions("recording", "frame", "particle_id")
    kind = pa.list_(pa.struct([("frame", pa.int64()), ("x", pa.float64()), ("y", pa.float64())]))
    empty = {n: np.zeros(0) for n in particles.FIELDS}

    def batch(name, ended: list[list]) -> pa.RecordBatch:
        points = [[{"frame": q[0], "x": q[1], "y": q[2]} for q in track] for track in ended]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(ended), pa.string()), pa.array([q[0][0] for q in ended], pa.int64()), pa.array(points, kind)], names=["recording", "start_frame", "points"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, name, frame, held = None, None, 0, []

        def frame_done(following: int | None) -> Iterator[pa.RecordBatch]:
            """Links the frame held, passes the empty ones up to the following, and gives the tracks that ended."""
            values = np.concatenate(held)
            held.clear()
            tracker.add(frame, {n: values[:, k] for k, n in enumerate(particles.FIELDS)})
            for k in range(frame + 1, frame + 1 if following is None else min(following, frame + max_gap + 2)):
                tracker.add(k, empty)
            ended = [t for t in tracker.done + (tracker.live if following is None else []) if len(t) >= min_track_length]
            tracker.done = []
            if ended:
                yield batch(name, ended)

        for part in parts:
            if not part.num_rows:
                continue
            owner, at = part.column(0).dictionary_encode("encode"), part.column(1).to_numpy()
            code = owner.indices.to_numpy()
            values = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(2, 6)])
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(at)]
            for a, b in pairwise(cuts):
                own, now = owner.dictionary[int(code[a])].as_py(), int(at[a])
                if tracker is not None and (own != name or now != frame):
                    yield from frame_done(now if own == name else None)
                if tracker is None or own != name:
                    tracker, name = particles.Tracker(p, max_gap, initial, shape), own
                frame = now
                held.append(values[a:b])
        if tracker is not None:
            yield from frame_done(None)

    order = Window.partitionBy("recording").orderBy("start_frame", F.col("points")[0]["x"], F.col("points")[0]["y"])
    ended = rows.mapInArrow(run, "recording string, start_frame long, " + TRACKS[TRACKS.index("points") :])
    return ended.withColumn("track_id", F.row_number().over(order)).select(*[c.split()[0] for c in TRACKS[: TRACKS.index("points")].split(", ") if c], "points")
