"""Properties that hold for any input, and Catalyst forms against kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import swirlframe.queries as Q
from swirlframe import functions as C
from swirlframe.kernels import correlation, deformation, images, neighbourhood
from swirlframe.operators import fields, recordings
from swirlframe.params import PhysicalScale
from swirlframe.plans import images as image_plans

pixels = st.lists(st.floats(0, 1, allow_nan=False), min_size=256, max_size=256).map(lambda v: np.reshape(v, (16, 16)))


@settings(max_examples=30, deadline=None)
@given(pixels, st.integers(-5, 5), st.integers(-5, 5))
def test_correlation_shifts_with_its_input(a, dr, dc):
    if np.ptp(a) < 0.1:
        return
    b = np.roll(a, (dr, dc), (0, 1))
    r = correlation.planes(a[None], b[None], correlation.Plan((16, 16), (16, 16)))[0]
    assert r[8 + dr, 8 + dc] == pytest.approx(r.max())


@settings(max_examples=30, deadline=None)
@given(pixels)
def test_spline_and_stretch(a):
    y, x = np.mgrid[0:16, 0:16].astype(float)
    assert np.allclose(deformation.Spline(a)(y, x), a, atol=1e-9)
    s = images.percentile_stretch(a)
    assert s.min() >= 0 and s.max() <= 1
    assert np.allclose(images.invert_image(images.invert_image(a)), a)


@settings(max_examples=20, deadline=None)
@given(st.permutations(range(12)))
def test_dedupe_and_assignment_use_each_once(order):
    from swirlframe.kernels.particles import assign

    i, j = np.array(order) % 4, np.array(order) // 4
    cost = np.abs(i - j) + 0.0
    k = assign(cost, cost, i, j)
    assert len(set(i[k])) == len(k) == len(set(j[k])) and {(int(i[x]), int(j[x])) for x in k} == {(0, 0), (1, 1), (2, 2)}


def grid_frame(spark, u, v, outlier=None):
    rows = [(1, i + 1, j + 1, 16.0 * (j + 1), 16.0 * (i + 1), float(u[i, j]), float(v[i, j]), False, bool(outlier[i, j]) if outlier is not None else False) for i in range(u.shape[0]) for j in range(u.shape[1])]
    return spark.createDataFrame(rows, "frame int, gi int, gj int, x double, y double, u double, v double, masked boolean, outlier boolean")


def as_grid(df, c, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.gi - 1, r.gj - 1] = r[c]
    return out


def test_column_forms_equal_kernels(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(0, 1, (7, 9)), rng.normal(0, 1, (7, 9))
    f = grid_frame(spark, u, v)
    flag = as_grid(fields.outliers(f), "flag", u.shape).astype(bool)
    assert np.array_equal(flag, neighbourhood.outliers(u, v, 2.0, 2))
    assert np.allclose(as_grid(fields.smooth(f), "u", u.shape), neighbourhood.smooth(u))
    got = fields.replace_outliers(grid_frame(spark, u, v, flag))
    assert np.allclose(as_grid(got, "u", u.shape), neighbourhood.replace(u, v, flag)[0])
    s = PhysicalScale(0.1, 0.01)
    once = fields.physical(f, s)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, fields.physical(once, s).collect()))


def test_pairing_rules(spark):
    t = [0.0, 0.1, 0.25, 0.5, 0.9]
    f = spark.createDataFrame([(i, x) for i, x in enumerate(t, 1)], "frame_idx int, ts double")
    got = recordings.image_pairs(f, "chained", 2, 1, (1, 2), ts="ts").orderBy("pair_id").collect()
    assert [(r.idx_a, r.idx_b) for r in got] == [(2, 3), (4, 5), (2, 4)] and got[0].dt == pytest.approx(0.15)
    f = spark.createDataFrame([(i,) for i in range(1, 9)], "frame_idx int")
    assert [(r.idx_a, r.idx_b) for r in recordings.image_pairs(f, "chained", 2, 1, (2,)).orderBy("pair_id").collect()] == [(2, 4), (4, 6), (6, 8)]
    with pytest.raises(ValueError):
        recordings.check_paired(5)
    with pytest.raises(ValueError):
        recordings.image_pairs(f, "other")


def test_image_plans(spark):
    frames = Q.recording(spark, 2, 48)
    got = image_plans.preprocess(frames, [("highpass_filter", {"sigma": 2.0}), ("percentile_stretch", {})]).orderBy("frame_idx").collect()
    a = np.reshape(frames.orderBy("frame_idx").first().pixels, (48, 48))
    assert np.allclose(np.reshape(got[0].pixels, (48, 48)), images.percentile_stretch(images.highpass_filter(a, 2.0)))
    m = image_plans.automatic_masks(frames, grow=1).orderBy("frame_idx").first()
    assert np.array_equal(np.reshape(m["mask"], (48, 48)), images.automatic_mask(a, grow=1))


def test_limits_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 0.0, 2.0, 0.2), (nan, 0.0, nan, nan), (10.0, 0.0, 1.0, 0.9)], "u double, v double, peak_ratio double, correlation_moment double")
    flags = df.select(*[C.fails(s).alias(str(k)) for k, s in enumerate([("peak_ratio", 1.3), ("correlation_moment", 0.5), ("velocity_magnitude", {"min": 0.5, "max": 5})])]).collect()
    assert [tuple(r) for r in flags] == [(False, False, False), (True, True, True), (True, True, True)]
    r = df.select(C.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), C.ratio(F.lit(0.0), F.lit(0.0)).alias("b"), C.above(F.lit(nan), 1.0).alias("c")).first()
    assert r.a == math.inf and math.isnan(r.b) and r.c is False
