"""Live recordings: pairs as they come in, ensembles that grow, tracks kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import valid
from .live_table import LiveTable, grow, live_ensemble_table
from .tracks import live_tracks

__all__ = ["LiveTable", "grow", "live_ensemble", "live_ensemble_table", "live_pairs", "live_piv", "live_tracks", "windowed_statistics"]


def live_piv(pairs: DataFrame, path: str, checkpoint: str, passes=None, on_result: Callable[[int, DataFrame], None] | None = None, progress: Callable[[int], None] | None = None, trigger: dict | None = None, **options) -> StreamingQuery:
    """A stream of pairs (with pixels) into an archive, batch by batch.

    ``on_result(batch, rows)`` comes before a batch is written, ``progress(batch)`` after; an exception of either stops
    the query, and what was written stays. A batch written again after a failure replaces itself.
    """
    from ..plans.piv import run_piv_sequence

    def each(batch: DataFrame, number: int) -> None:
        rows = run_piv_sequence(batch, passes=passes, **options)
        if on_result is not None:
            rows = rows.persist()
            on_result(number, rows)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "pair_id").parquet(path)
        rows.unpersist()
        if progress is not None:
            progress(number)

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_pairs(frames: DataFrame, watermark: str = "10 seconds", recording: str = "recording", ts: str = "ts") -> DataFrame:
    """Chained pairs of a stream of frames: a stream-stream join on the next index, late frames bounded by a watermark."""
    a = frames.withWatermark(ts, watermark).select(recording, F.col("frame_idx").alias("idx_a"), F.col(ts).alias("ts_a"), "n_rows", "n_cols", F.col("pixels").alias("pixels_a"))
    b = frames.withWatermark(ts, watermark).select(F.col(recording).alias("_r"), F.col("frame_idx").alias("idx_b"), F.col(ts).alias("ts_b"), F.col("pixels").alias("pixels_b"))
    on = (F.col(recording) == F.col("_r")) & (F.col("idx_b") == F.col("idx_a") + 1) & (F.col("ts_b") >= F.col("ts_a")) & (F.col("ts_b") <= F.col("ts_a") + F.expr(f"INTERVAL {watermark}"))
    return a.join(b, on).select(recording, F.col("idx_a").cast("long").alias("pair_id"), "idx_a", "idx_b", "n_rows", "n_cols", "pixels_a", "pixels_b")


def windowed_statistics(vectors: DataFrame, size: str, slide: str | None = None, watermark: str = "0 seconds", ts: str = "ts", include_invalid: bool = False) -> DataFrame:
    """Mean, RMS and count of each node's valid vectors in windows of event time, tumbling or sliding."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = vectors.withColumns({c: F.lit(False) for c in ("masked", "outlier") if c not in vectors.columns})
    ok = valid(include_invalid=include_invalid)
    of = lambda f, c: f(F.when(ok, F.col(c)))
    return rows.withWatermark(ts, watermark).groupBy(w, "gi", "gj").agg(F.count_if(ok).alias("count"), *[of(f, c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("mean", F.avg), ("rms", F.stddev_pop))])


def live_ensemble(sums: DataFrame) -> DataFrame:
    """Running sums of windows' planes (job, plane array): state holds one plane a window; every update gives the new sum."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = (np.array(state.get[0]), state.get[1]) if state.exists else (None, 0)
        for part in parts:
            for plane in part["plane"]:
                total = np.asarray(plane, float) if total is None else total + np.asarray(plane, float)
                n += 1
        state.update((total.tolist(), n))
        yield pd.DataFrame({"job": [key[0]], "plane": [total.tolist()], "n": [n]})

    return sums.groupBy("job").applyInPandasWithState(step, "job int, plane array<double>, n long", "plane array<double>, n long", "update", GroupStateTimeout.NoTimeout)
