"""Sums of images as arrays, thresholds, and results saved pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swirlframe.operators import recordings
from swirlframe.sources import sinks


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(1)
    pixels = rng.normal(5000, 1, (9, 12 * 7))
    schema = "frame_idx int, recording string, n_rows int, n_cols int, pixels array<double>"
    return pixels, spark.createDataFrame([(k + 1, "ab"[k % 2], 12, 7, p.tolist()) for k, p in enumerate(pixels)], schema).repartition(4)


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_backgrounds(spark, shots, monkeypatch, block):
    monkeypatch.setattr(recordings, "BLOCK", block)
    pixels, frames = shots
    for method, of in (("min", np.min), ("mean", np.mean)):
        got = recordings.compute_background(frames, method).first().pixels
        assert np.allclose(got, of(pixels, axis=0), rtol=1e-14)
        by = {r.recording: r.pixels for r in recordings.compute_background(frames, method, ("recording",)).collect()}
        assert np.allclose(by["a"], of(pixels[::2], axis=0)) and np.allclose(by["b"], of(pixels[1::2], axis=0))
    assert recordings.compute_background(frames.limit(0)).collect() == []
    with pytest.raises(Exception, match="one size"):
        recordings.compute_background(frames.withColumn("pixels", F.when(F.col("frame_idx") == 2, F.array(F.lit(1.0))).otherwise(F.col("pixels")))).collect()


def test_variances_and_thresholds(spark, shots):
    pixels, frames = shots
    image = pixels[3].reshape(12, 7)
    want = [[np.var(image[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3]) for c in range(7)] for r in range(12)]
    got = recordings.local_variance(frames, 2).filter("frame_idx = 4").first()
    assert np.allclose(np.array(got.variance).reshape(12, 7), want, rtol=1e-8) and got.recording == "b"
    single = {r.frame_idx: r.threshold for r in recordings.otsu_thresholds(frames).collect()}
    rows = recordings.pixel_rows(frames, ("frame_idx",))
    grouped = {r.frame_idx: r.threshold for r in recordings.otsu_threshold(rows, "p", ("frame_idx",)).collect()}
    assert single == pytest.approx(grouped) and len(single) == 9
    lost = frames.withColumn("pixels", F.when(F.col("frame_idx") > 1, F.col("pixels")))
    assert {r.frame_idx for r in recordings.otsu_thresholds(lost).filter("threshold IS NULL").collect()} == {1}


def test_pairs_are_saved_whole(spark, tmp_path):
    rows = [(p, i, j, 0.5 * p, f"a{p}.tif") for p in range(6) for i in (1, 2) for j in (1, 2, 3)]
    results = spark.createDataFrame(rows, "pair_id long, gi int, gj int, u double, source_a string").repartition(5)
    out = str(tmp_path / "pairs")
    told = {r.pair_id: r for r in sinks.save_pairs(results, out, ("source_a",)).collect()}
    assert {k: (r.n, r.source_a) for k, r in told.items()} == {p: (6, f"a{p}.tif") for p in range(6)}
    assert all(r.path.endswith(f"pair_id={k}") and len(list((tmp_path / "pairs" / f"pair_id={k}").glob("*.parquet"))) == 1 for k, r in told.items())
    broken = results.filter("pair_id IN (1, 2)").withColumn("u", F.when((F.col("pair_id") == 2) & (F.col("gj") == 3), F.raise_error(F.lit("stop")).cast("double")).otherwise(F.lit(9.0)))
    with pytest.raises(Exception, match="stop"):
        sinks.save_pairs(broken, out)
    assert sinks.load_results(spark, out).filter("u = 9").count() == 0 and sinks.load_results(spark, out).count() == 36
    sinks.save_pairs(results.filter("pair_id = 3").withColumn("u", F.lit(7.0)), out)
    assert {r.pair_id for r in sinks.load_results(spark, out).filter("u = 7").collect()} == {3} and sinks.load_results(spark, out).count() == 36


def test_bright_masks_need_no_shuffle(spark):
    """Against the definition, for images of two sizes, gaps, NaN and none; masks are made where the images lie."""
    rng = np.random.default_rng(3)
    shots = [(k, 5, rng.random(15 if k % 2 else 40).tolist()) for k in range(30)]
    shots[4][2][7], shots[5][2][3], shots[6][2][0] = None, float("nan"), None
    frames = spark.createDataFrame([*shots, (90, 5, None), (91, 5, []), (92, 5, [None] * 5)], "frame_idx long, n_cols int, pixels array<double>")
    want = set()
    for k, w, pixels in shots:
        p = np.array([v for v in pixels if v is not None])
        s = np.sort(p)
        at = (len(s) - 1) * 0.9
        t = s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))
        seeds = [divmod(i, w) for i, v in enumerate(pixels) if v is not None and (v >= t or np.isnan(v))]
        want |= {(k, r + 1, c + 1) for r in range(len(pixels) // w) for c in range(w) if any((r - a) ** 2 + (c - b) ** 2 <= 4 for a, b in seeds)}
    got = recordings.bright_masks(frames, 0.9, 2, ("frame_idx",))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {tuple(r) for r in recordings.bright_masks(frames, 0.9, 2, ("frame_idx",), values=50).collect()} == want
    import swirlframe.queries as Q

    plan = Q.auto_mask_grown(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
