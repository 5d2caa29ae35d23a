"""Calibration points as DataFrames: fits by camera, reprojection review, detected plates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import geometry

POINTS = "camera int, plane int, px double, py double, i int, j int, level int, X double, Y double, Z double"
CAMERAS = "camera int, model string, params array<double>"


def parameters(cam: geometry.Camera) -> list[float]:
    if isinstance(cam, geometry.PinholeCamera):
        return cam.P.ravel().tolist()
    return [*cam.ax, *cam.ay, *cam.center, *cam.scale]


def camera_of(model: str, params: list[float]) -> geometry.Camera:
    p = np.asarray(params, float)
    return geometry.PinholeCamera(p.reshape(3, 4)) if model == "pinhole" else geometry.SoloffCamera(p[:19], p[19:38], p[38:41], p[41:44])


def calibrate_cameras(points: DataFrame, model: str = "pinhole") -> DataFrame:
    """CAMERAS: one fit a camera, on the few thousand points that its plates have."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        cam = geometry.calibrate(rows[["X", "Y", "Z"]].to_numpy(float), rows[["px", "py"]].to_numpy(float), model)
        return pd.DataFrame({"camera": [rows["camera"].iloc[0]], "model": [model], "params": [parameters(cam)]})

    return points.groupBy("camera").applyInPandas(fit, CAMERAS)


def reprojection_errors(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """``points`` with error (pixels); cameras are a row each and go along with every batch."""
    rows = points.join(cameras, "camera")
    names = points.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p = part.to_pandas()
            out = np.full(len(p), np.nan)
            for _, own in p.groupby("camera"):
                cam = camera_of(own["model"].iloc[0], own["params"].iloc[0])
                out[own.index] = geometry.reprojection(cam, own[["X", "Y", "Z"]].to_numpy(float), own[["px", "py"]].to_numpy(float))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(out)], names=[*names, "error"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("error", T.DoubleType())]))


def calibration_quality(errors: DataFrame, *by: str) -> DataFrame:
    """RMS, largest error and number of points, overall or by camera and plane."""
    return errors.groupBy(*by).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"), F.max("error").alias("largest"), F.count("*").alias("n"))


def fit_sheet_plane(points: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, c) of z = a + b x + c y by least squares over points x, y, z: sums in one aggregation, then the same solution."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    s = points.groupBy(*by).agg(*[F.covar_pop(p, q).alias(n) for n, p, q in (("xx", x, x), ("yy", y, y), ("xy", x, y), ("xz", x, z), ("yz", y, z))], F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    t = s.withColumn("b", (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).withColumn("c", (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    return t.select(*by, (F.col("mz") - F.col("b") * F.col("mx") - F.col("c") * F.col("my")).alias("a"), "b", "c")


def detect_plates(frames: DataFrame, spacing: float, **options) -> DataFrame:
    """POINTS of plate images (camera, plane, z, n_rows, n_cols, pixels): one image a call, plates in parallel."""
    rows = frames.select(F.col("camera").cast("int"), F.col("plane").cast("int"), F.col("z").cast("double"), "n_rows", "n_cols", "pixels")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                camera, plane, z, nr, nc = (part.column(c)[r].as_py() for c in range(5))
                g = geometry.detect_grid(part.column(5)[r].values.to_numpy(zero_copy_only=False).reshape(nr, nc), spacing, **options)
                w, px = geometry.grid_points(g, z)
                n = len(px)
                cols = [np.full(n, camera, np.int32), np.full(n, plane, np.int32), px[:, 0], px[:, 1], g["i"].astype(np.int32), g["j"].astype(np.int32), g["level"].astype(np.int32), w[:, 0], w[:, 1], w[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in POINTS.split(", ")])

    return rows.mapInArrow(run, POINTS)
