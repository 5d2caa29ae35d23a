"""Predictions for particle matching as tables, regions and scales; correlators of one's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swirlframe.kernels import correlation, particles, synthetic
from swirlframe.kernels import piv as kernel
from swirlframe.operators import recordings
from swirlframe.params import ROI, PhysicalScale, PIVParameters, PTVParameters, multipass_parameters
from swirlframe.plans import piv, ptv
from swirlframe.sources import images

PASSES = multipass_parameters([32, 16])


@pytest.fixture(scope="module")
def shots(spark):
    a, b, *_ = synthetic.image_pair((128, 128), synthetic.linear_flow(5.0, -2.0), 0.02)
    frames = images.frames_of(spark, [a, b, a, b]).persist()
    return a, b, frames, recordings.image_pairs(frames).withColumn("pair_id", F.col("pair_id").cast("long"))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("pair_id", "index_a", "index_b", "x", "y", "u", "v", "match_residual").collect())


def test_a_given_field_predicts_as_the_pairs_own(spark, shots):
    _, _, frames, pairs = shots
    p = PTVParameters(search_radius=3)
    own = ptv.run_ptv_sequence(pairs, frames, p, "piv", PASSES)
    fields = piv.run_piv_sequence(pairs, frames, PASSES)
    assert len(rows_of(own)) > 200 and rows_of(own) == rows_of(ptv.run_ptv_sequence(pairs, frames, p, fields))
    half = ptv.run_ptv_sequence(pairs, frames, p, fields.filter("pair_id = 1"))
    none = ptv.run_ptv_sequence(pairs, frames, p, None)
    assert [r for r in rows_of(half) if r[0] == 1] == [r for r in rows_of(own) if r[0] == 1]
    assert [r for r in rows_of(half) if r[0] == 2] == [r for r in rows_of(none) if r[0] == 2]
    with pytest.raises(Exception, match="every node"):
        ptv.run_ptv_sequence(pairs, frames, p, fields.filter("NOT (gi = 1 AND gj = 1)")).collect()
    with pytest.raises(ValueError):
        ptv.run_ptv_sequence(pairs, frames, p, "guess")


def test_one_grid_for_all_and_a_region(spark, shots):
    a, b, frames, pairs = shots
    p = PTVParameters(search_radius=3, uod_enable=False)
    grid = np.array([1.0, 128.0]), np.array([1.0, 128.0]), np.full((2, 2), 5.0), np.full((2, 2), -2.0)
    want = particles.track_pair(particles.detect(a, p), particles.detect(b, p), p, grid)
    got = ptv.run_ptv_sequence(pairs, frames, p, grid, scale=PhysicalScale(0.5, 0.1, "mm", "s")).filter("pair_id = 1")
    assert [r.index_b for r in got.orderBy("index_a").collect()] == want["index_b"].tolist() and got.first().scale_pixel_size == 0.5
    roi = ROI(17, 112, 33, 128)
    inside = ptv.run_ptv_sequence(pairs, frames, p, grid, roi=roi).filter("pair_id = 1").collect()
    ca, cb = a[16:112, 32:128], b[16:112, 32:128]
    cut = particles.track_pair(particles.detect(ca, p), particles.detect(cb, p), p, (grid[0] - 32, grid[1] - 16, *grid[2:]))
    assert sorted((r.x, r.y) for r in inside) == sorted(zip(cut["x"] + 32, cut["y"] + 16, strict=True)) and len(inside) > 50


def test_registered_correlators(spark, shots):
    a, b, frames, pairs = shots

    def plain(x, y, plan):
        s = np.conj(np.fft.fft2(x, plan.fft)) * np.fft.fft2(y, plan.fft)
        return np.fft.fftshift(np.abs(np.fft.ifft2(s)), axes=(-2, -1))

    correlation.register_correlator("plain", plain)
    for more in ({}, {"padding": True, "apodization": "gauss"}, {"search_area_size": (48, 48)}):
        named, usual = (PIVParameters((32, 32), correlation_method=m, **more) for m in ("plain", "cross"))
        f, g = kernel.run(a, b, [named]), kernel.run(a, b, [usual])
        assert np.allclose(f.u, g.u, atol=1e-5) and np.allclose(f.v, g.v, atol=1e-5)
    got = piv.run_piv_sequence(pairs, frames, PIVParameters((32, 32), correlation_method="plain"))
    want = piv.run_piv_sequence(pairs, frames, PIVParameters((32, 32)))
    u = lambda df: [r.u for r in df.orderBy("pair_id", "gi", "gj").collect()]
    assert np.allclose(u(got), u(want), atol=1e-5)
    with pytest.raises(ValueError):
        PIVParameters((32, 32), correlation_method="unknown")
    with pytest.raises(ValueError):
        correlation.register_correlator("cross", plain)
    with pytest.raises(ValueError, match="planes are"):
        kernel.run(a, b, [PIVParameters((32, 32), correlation_method=lambda x, y, plan: x[:, :3, :3])])
