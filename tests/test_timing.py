"""Joins along time and frames, masks by span, labels that travel with results, synchronised cameras: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swirlframe.kernels import synthetic
from swirlframe.operators import recordings, timing
from swirlframe.params import PIVParameters
from swirlframe.plans import piv
from swirlframe.sources import images


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_span_join(spark, width):
    rng = random.Random(1)
    rows = [(i % 3, rng.randint(-50, 200)) for i in range(120)]
    spans = [(i % 3, a, a + rng.randint(-2, 40), i) for i in range(60) for a in [rng.randint(-60, 220)]] + [(1, None, 10, 900), (2, 150, None, 901), (0, None, None, 902)]
    got = timing.span_join(spark.createDataFrame(rows, "k int, t int"), spark.createDataFrame(spans, "k int, a int, b int, m int"), "t", "a", "b", ("k",), width, "inner")
    want = sorted((k, t, m) for k, t in rows for g, a, b, m in spans if g == k and (a is None or a <= t) and (b is None or t <= b))
    assert sorted((r.k, r.t, r.m) for r in got.collect()) == want
    none = timing.span_join(spark.createDataFrame(rows, "k int, t int").limit(0), spark.createDataFrame(spans, "k int, a int, b int, m int"), "t", "a", "b", ("k",))
    assert none.count() == 0


@pytest.mark.parametrize("block", [None, 2.0, 1000.0])
def test_nearest_in_time(spark, block):
    rng = random.Random(2)
    a = [(i % 2, round(rng.uniform(-40, 40), 1), i) for i in range(80)] + [(0, None, 500)]
    b = [(i % 2, round(rng.uniform(-40, 40), 1), i) for i in range(90)] + [(0, None, 600), (1, 3.0, 700), (1, 3.0, 701)]
    schema = "k int, ts double, i int"
    got = timing.nearest_in_time(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 1.5, keys=("k",), block=block, how="left")
    want = []
    for k, t, i in a:
        near = sorted((abs(u - t), u, j) for g, u, j in b if g == k and u is not None and t is not None and abs(u - t) <= 1.5)
        want.append((i, near[0][2] if near else None))
    assert sorted((r.i, r.i_b) for r in got.collect()) == sorted(want)
    assert timing.nearest_in_time(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).limit(0), 1.5).count() == 0


def test_synchronised_cameras(spark):
    schema = "rec string, ts double, dt double, frame int"
    one = spark.createDataFrame([("r", i * 1.0, 0.5, i) for i in range(6)] + [("s", i * 2.0, 0.5, i) for i in range(4)], schema)
    two = spark.createDataFrame([("r", i * 1.0 + 0.01, 0.5, i + 10) for i in range(6)] + [("s", i * 2.0 - 0.02, 0.5, i + 10) for i in range(4)], schema)
    got = timing.synchronised(one, two, 0.1, keys=("rec",), dt_tolerance=1e-9)
    assert sorted((r.rec, r.frame, r.frame_b) for r in got.collect()) == [("r", i, i + 10) for i in range(6)] + [("s", i, i + 10) for i in range(4)]
    for bad, said in ((two.filter("frame <> 12"), "no partner|different numbers"), (two.unionAll(spark.createDataFrame([("s", 50.0, 0.5, 99)], schema)), "different numbers"), (two.withColumn("ts", F.col("ts") + 0.5), "no partner"), (two.withColumn("dt", F.lit(0.6)), "different times")):
        with pytest.raises(Exception, match=said):
            timing.synchronised(one, bad, 0.1, keys=("rec",), dt_tolerance=1e-9).collect()
    crowded = one.filter("NOT (rec = 'r' AND frame = 5)").unionAll(spark.createDataFrame([("r", 2.05, 0.5, 77)], schema))
    with pytest.raises(Exception, match="partner of two"):
        timing.synchronised(crowded, two, 0.1, keys=("rec",)).collect()
    assert timing.synchronised(crowded, two.filter("frame <> 13"), 0.1, keys=("rec",), strict=False).count() == 8


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(7)
    p = synthetic.particle_field((64, 64), 0.03, rng)
    return images.frames_of(spark, [synthetic.render(p, (64, 64), lambda z: synthetic.laser_intensity(z, 0, 8), 0.01, rng=rng) for _ in range(4)])


def test_masks_hold_from_a_frame_to_a_frame(spark, frames):
    pairs = recordings.image_pairs(frames, "chained")
    left, top = np.zeros((64, 64), bool), np.zeros((64, 64), bool)
    left[:, :32], top[:32] = True, True
    masks = spark.createDataFrame([(None, 2, left.ravel().tolist()), (2, 3, top.ravel().tolist()), (9, 12, [True] * 4096)], "first_frame int, last_frame int, mask array<boolean>")
    held = {r.pair_id: None if r.mask is None else np.array(r.mask).reshape(64, 64) for r in recordings.with_masks(pairs, masks).collect()}
    assert (held[1] == (left | top)).all() and (held[2] == (left | top)).all() and (held[3] == top).all()
    assert recordings.with_masks(pairs, masks.filter("first_frame = 9")).filter("mask IS NOT NULL").count() == 0
    got = piv.run_piv_sequence(recordings.with_masks(pairs, masks), frames, PIVParameters((16, 16), overlap=(0, 0)))
    by = {k: {(r.gi, r.gj) for r in got.filter(F.col("pair_id") == k).filter("masked").collect()} for k in (1, 3)}
    assert by == {1: {(i, j) for i in (1, 2, 3, 4) for j in (1, 2, 3, 4) if i <= 2 or j <= 2}, 3: {(i, j) for i in (1, 2) for j in (1, 2, 3, 4)}}


def test_mask_function_knows_the_pair_and_labels_travel(spark, frames):
    pairs = recordings.image_pairs(frames, "chained").withColumn("source", F.concat(F.lit("img"), F.col("idx_a").cast("string"))).withColumn("pair_id", F.col("pair_id").cast("long"))
    half = np.zeros((64, 64), bool)
    half[:32] = True

    def mask_of(a, b, pair):
        return (half, None) if pair == 1 else (half, ~half) if pair == 2 else None

    got = piv.run_piv_sequence(pairs, frames, PIVParameters((16, 16), overlap=(0, 0)), pair_mask=mask_of, labels=("source",))
    counts = {(r.pair_id, r.source): r.n for r in got.groupBy("pair_id", "source").agg(F.count_if("masked").alias("n")).collect()}
    assert counts == {(1, "img1"): 8, (2, "img2"): 16, (3, "img3"): 0}
    both = piv.run_piv_sequence(pairs, frames, PIVParameters((16, 16), overlap=(0, 0)), mask=(half, ~half))
    assert both.filter("NOT masked").count() == 0
