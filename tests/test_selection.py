"""Exact order statistics, gap-free numbers and joins of groups, against plain Python."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from swirlframe.operators import fields, recordings, selection
from swirlframe.params import PhysicalScale


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1) * 10 ** rng.randint(-3, 3), float(rng.randint(-3, 3))) for _ in range(1500)]
    rows += [("ties", 1.25, -0.0), ("ties", 1.25, 0.0), ("ties", 1.25, 5e-324)] * 40
    rows += [("odd", v, None) for v in (3.0, -1.0, float("inf"))] + [("even", v, float("nan")) for v in (1e300, -1e300, 2.0, float("-inf"))] + [("none", None, None)]
    rows += [(None, 7.0, 8.0)]
    return rows


@pytest.mark.parametrize("gather", [1, 20, 100_000])
def test_medians(spark, groups, gather):
    df = spark.createDataFrame(groups, "g string, a double, b double").repartition(3)
    got = {r.g: r for r in selection.quantiles(df, ("g",), ("a", "b"), gather=gather).collect()}
    assert "none" not in got
    for g in {r[0] for r in groups} - {"none", None}:
        for k, c in ((1, "a"), (2, "b")):
            own = [r[k] for r in groups if r[0] == g and r[k] is not None and r[k] == r[k]]
            assert got[g][f"n_{c}"] == len(own)
            assert got[g][c] == (pytest.approx(median(own), rel=1e-12, abs=1e-300) if own else None), (g, c)


def test_nearest_ranks_and_a_single_group(spark, groups):
    df = spark.createDataFrame(groups, "g string, a double, b double")
    own = sorted(r[1] for r in groups if r[1] is not None)
    for q in (0.02, 0.5, 0.98, 1.0):
        for gather in (3, 10_000):
            r = selection.quantiles(df, (), ("a",), q, nearest_rank=True, gather=gather).first()
            assert r.a == own[max(0, -int(-q * len(own) // 1) - 1)] and r.n_a == len(own)
    assert selection.quantiles(df.limit(0), ("g",), ("a",)).collect() == []


def test_rows_beside_their_group_without_broadcast(spark, groups, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(groups, "g string, a double, b double")
    table = spark.createDataFrame([("hot", 1), ("ties", 2)], "g string, t int")
    got = selection.beside(df, table, ("g",))
    assert got.count() == len(groups) and got.filter("g = 'hot' AND t = 1").count() == 1500 and got.filter("g = 'odd' AND t IS NULL").count() == 3
    assert selection.beside(df, table, ("g",), "inner").count() == 1620
    assert selection.quantiles(df, ("g",), ("a",), gather=5).count() == 5


def test_numbers_without_gaps(spark):
    rng = random.Random(3)
    rows = [(k, x) for k in "abc" for x in rng.sample(range(1000), {"a": 300, "b": 5, "c": 1}[k])]
    df = spark.createDataFrame(rows, "k string, x int").repartition(5)
    got = {(r.k, r.x): r.n for r in selection.numbered(df, ("x",), "n", ("k",)).collect()}
    assert got == {(k, x): i for k in "abc" for i, x in enumerate(sorted(v for c, v in rows if c == k), 1)}
    assert sorted(r.n for r in selection.numbered(df, ("k", "x"), "n").collect()) == list(range(1, 307))
    assert selection.numbered(df.limit(0), ("x",), "n").collect() == []


def test_pairs_are_numbered_without_gaps_where_frames_are_missing(spark):
    frames = spark.createDataFrame([(i,) for i in (1, 2, 3, 6, 7, 9, 10, 13, 14)], "frame_idx int")
    got = sorted(tuple(r)[:3] for r in recordings.image_pairs(frames).collect())
    assert got == [(1, 1, 2), (2, 9, 10), (3, 13, 14)]
    got = sorted(tuple(r)[:3] for r in recordings.image_pairs(frames, "chained", deltas=(1, 3)).collect())
    want = [(a, a + d) for d in (1, 3) for a in (1, 2, 3, 6, 7, 9, 10, 13, 14) if a + d in (1, 2, 3, 6, 7, 9, 10, 13, 14)]
    assert got == [(i, a, b) for i, (a, b) in enumerate(want, 1)]


def test_temporal_test_of_long_series(spark):
    rng = random.Random(4)
    rows = [(t, i, 1, rng.gauss(0, 1) + 40 * (rng.random() < 0.05), rng.gauss(5, 2), False, False) for t in range(120) for i in (1, 2)]
    f = spark.createDataFrame(rows, "frame int, gi int, gj int, u double, v double, masked boolean, outlier boolean")
    got = {(r.frame, r.gi): r.outlier for r in fields.validate_temporal(f, gather=7).collect()}
    for i in (1, 2):
        own = [r for r in rows if r[1] == i]
        flags = dict.fromkeys((r[0] for r in own), False)
        for c in (3, 4):
            m = median(r[c] for r in own)
            d = median(abs(r[c] - m) for r in own)
            for r in own:
                flags[r[0]] |= abs(r[c] - m) / (d + 0.1) > 3
        assert {t: got[t, i] for t in flags} == flags and any(flags.values())


def test_each_row_goes_by_its_own_scale(spark):
    f = spark.createDataFrame([(1, 1, 1, 1.0, 2.0, 1.0, 3.0)], "frame int, gi int, gj int, x double, y double, u double, v double")
    a, b = PhysicalScale(0.02, 0.005, "mm", "s"), PhysicalScale(0.5, 1.0, "um", "ms")
    both = fields.with_scale(f, a).unionByName(fields.with_scale(f.withColumn("frame", F.lit(2)), b)).unionByName(fields.with_scale(f.withColumn("frame", F.lit(3)), a).withColumn("scale_dt", F.lit(None).cast("double")))
    for done in (fields.physical(both), fields.physical(fields.physical(both))):
        got = {r.frame: (r.x, r.u, r.length_unit, r.velocity_unit) for r in done.collect()}
        assert got == {1: (0.02, 4.0, "mm", "mm/s"), 2: (0.5, 0.5, "um", "um/ms"), 3: (1.0, 1.0, "px", "px/frame")}
    assert {(r.x, r.u) for r in fields.physical(both, b).collect()} == {(0.5, 0.5)}


def test_each_series_goes_by_its_own_time(spark):
    rows = [(rec, t, 1, 1, float(t % 3), 0.0, False, False, dt) for rec, dt in (("a", 0.5), ("b", 0.1), ("c", None)) for t in range(12)]
    f = spark.createDataFrame(rows, "recording string, frame int, gi int, gj int, u double, v double, masked boolean, outlier boolean, scale_dt double")
    top = {r.recording: r.f for r in fields.result_spectrum(f, keys=("recording",)).groupBy("recording").agg(F.max("frequency").alias("f")).collect()}
    assert top == pytest.approx({"a": 1.0, "b": 5.0, "c": 0.5})
    with pytest.raises(Exception, match="several lengths"):
        fields.result_spectrum(f).collect()
