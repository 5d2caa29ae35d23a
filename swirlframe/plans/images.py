"""Per-frame image operators over recordings: NumPy on one image at a time, frames in parallel, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..kernels import images as kernel
from ..kernels.geometry import Dewarper


def map_images(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], column: str = "pixels") -> DataFrame:
    """``frames`` with ``column``, n_rows and n_cols of ``fn`` of each image; other columns pass through as Arrow."""
    names = frames.columns
    at = {n: names.index(n) for n in ("n_rows", "n_cols", column)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                shape = part.column(at["n_rows"])[r].as_py(), part.column(at["n_cols"])[r].as_py()
                out = np.asarray(fn(part.column(at[column])[r].values.to_numpy(zero_copy_only=False).reshape(shape)), float)
                new = {column: pa.array([np.ascontiguousarray(out).ravel()], pa.list_(pa.float64())), "n_rows": pa.array([out.shape[0]], pa.int32()), "n_cols": pa.array([out.shape[1]], pa.int32())}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(i).slice(r, 1) for i, n in enumerate(names)], names=names)

    kinds = {column: T.ArrayType(T.DoubleType()), "n_rows": T.IntegerType(), "n_cols": T.IntegerType()}
    return frames.mapInArrow(run, T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in frames.schema.fields]))


def preprocess(frames: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """An ordered list of (step, options) on every image."""
    return map_images(frames, kernel.build_preprocess(steps))


def automatic_masks(frames: DataFrame, column: str = "mask", **options) -> DataFrame:
    """``frames`` with ``column``: array<boolean> of masked pixels."""
    base = frames.withColumn(column, frames["pixels"])
    marked = map_images(base, lambda i: kernel.automatic_mask(i, **options), column)
    from pyspark.sql import functions as F

    return marked.withColumn(column, F.transform(column, lambda x: x > 0.5))


def dewarp(frames: DataFrame, dewarper: Dewarper) -> DataFrame:
    """Every image on the dewarper's grid."""
    return map_images(frames, dewarper)
