"""Whole analyses, sources, sinks and streams on small synthetic recordings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import swirlframe.queries as Q
from swirlframe.kernels import geometry, particles, piv as kernel, synthetic
from swirlframe.schema import TRACKS
from swirlframe.operators import fields, recordings, tracks
from swirlframe.params import ROI, PhysicalScale, PIVParameters, PTVParameters, multipass_parameters
from swirlframe.plans import piv, ptv
from swirlframe.sources import images, sinks
from swirlframe import streaming
from tests.test_kernels import camera


def pair_rows(spark, pairs):
    rows = [(k, a.shape[0], a.shape[1], a.ravel().tolist(), b.ravel().tolist()) for k, (a, b) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "pair_id long, n_rows int, n_cols int, pixels_a array<double>, pixels_b array<double>")


def test_sequence_equals_the_kernel(spark):
    a, b, *_ = synthetic.image_pair((96, 96), synthetic.linear_flow(1.2, -0.7), 0.05)
    mask = np.zeros((96, 96), bool)
    mask[:40, :40] = True
    passes = multipass_parameters([32, 16], final={"uncertainty": True})
    f = kernel.run(a, b, passes, mask)
    rows = piv.run_piv_sequence(pair_rows(spark, [(a, b), (b, a)]), passes=passes, mask=mask).filter("pair_id = 1").collect()
    assert len(rows) == f.u.size
    for r in rows:
        u = f.u[r.gi - 1, r.gj - 1]
        assert (np.isnan(u) and math.isnan(r.u) and r.masked) or r.u == u
    f = kernel.run(a, b, [PIVParameters((32, 32))], roi=ROI(17, 96, 33, 96))
    assert f.x[0] == 48.5 and f.y[0] == 32.5


def test_ensemble_finds_what_pairs_hide(spark):
    pairs = []
    for seed in range(24):
        a, b, *_ = synthetic.image_pair((96, 96), synthetic.linear_flow(1.5, -2.0), 0.012, seed=seed, noise=0)
        rng = np.random.default_rng(seed)
        pairs.append((a + rng.random(a.shape) * 0.5, b + rng.random(b.shape) * 0.5))
    f = piv.run_piv_ensemble(pair_rows(spark, pairs).repartition(3), [PIVParameters((32, 32), uncertainty=True)])
    assert np.abs(f.u - 1.5).max() < 0.5 and np.abs(f.v + 2).max() < 0.5
    f = piv.run_piv_ensemble(pair_rows(spark, pairs).repartition(3), multipass_parameters([32, 32], final={"uncertainty": True}))
    assert np.median(np.abs(f.u - 1.5)) < 0.15 and np.isfinite(f.uncertainty_u).mean() > 0.8 and np.nanmax(f.uncertainty_u) < 0.5
    total = sum(kernel.job_planes(kernel.grid((96, 96), PIVParameters((32, 32))), a, b, PIVParameters((32, 32)), None, slice(0, 1))[0] for a, b in pairs)
    got = {r.job: np.array(r.plane) for r in piv.ensemble_sums(pair_rows(spark, pairs).repartition(5), PIVParameters((32, 32)), None).collect()}
    assert np.allclose(got[0].reshape(32, 32), total)


def views(spark, cams, size, moves, n=250, z=0.0, tilt=(0.0, 0.0), seed=4):
    """Images of particles on a sheet z + tilt by each camera, before and after a displacement."""
    rng = np.random.default_rng(seed)
    w = np.column_stack([rng.uniform(-40, 40, n), rng.uniform(-40, 40, n), np.zeros(n)])
    w[:, 2] = z + w[:, 0] * tilt[0] + w[:, 1] * tilt[1]
    out = []
    for cam in cams:
        for p in (w, w + np.array(moves)):
            px = cam.world_to_pixel(p)
            out.append(synthetic.render({"x": px[:, 0], "y": px[:, 1], "z": np.zeros(n), "diameter": np.full(n, 6.0), "intensity": np.ones(n)}, (size, size), lambda q: np.ones_like(q), 0))
    return out


def test_stereo(spark):
    cams = [camera(math.radians(-20), f=2000, size=256), camera(math.radians(20), f=2000, size=256)]
    grid = geometry.common_grid(cams, [(256, 256)] * 2)
    d1, d2 = (geometry.Dewarper(c, grid, (256, 256)) for c in cams)
    a1, b1, a2, b2 = views(spark, cams, 256, (0.8, -0.5, 0.6), 900)
    row = [(1, *(i.ravel().tolist() for i in (a1, b1, a2, b2)))]
    df = spark.createDataFrame(row, "pair_id long, pixels_a1 array<double>, pixels_b1 array<double>, pixels_a2 array<double>, pixels_b2 array<double>")
    got = piv.run_piv_stereo_sequence(df, d1, d2, multipass_parameters([64, 32], padding=True, apodization="gauss")).filter("NOT masked AND NOT outlier").agg(*[F.median(c).alias(c) for c in "uvw"]).first()
    assert abs(got.u - 0.8) < 0.05 and abs(got.v + 0.5) < 0.05 and abs(got.w - 0.6) < 0.1
    half = np.zeros(d1.mask.shape, bool)
    half[:, : half.shape[1] // 2] = True
    cut = piv.run_piv_stereo_sequence(df, d1, d2, PIVParameters((64, 64), overlap=(32, 32)), mask=(None, half))
    whole = piv.run_piv_stereo_sequence(df, d1, d2, PIVParameters((64, 64), overlap=(32, 32)))
    last = whole.agg(F.max("gj")).first()[0]
    bad = {r.gj for r in cut.filter("masked").collect()}
    assert set(range(1, last // 2)) <= bad and last not in bad and whole.filter("masked").count() < cut.filter("masked").count()
    with pytest.raises(ValueError):
        piv.run_piv_stereo_sequence(df, d1, d2, mask=np.zeros((3, 3), bool))
    e = piv.run_piv_stereo_ensemble(df, d1, d2, [PIVParameters((64, 64), overlap=(32, 32))])
    assert abs(np.nanmedian(e["d"][..., 2]) - 0.6) < 0.15


def test_self_calibration_moves_the_sheet(spark):
    cams = [camera(math.radians(-20), f=2000, size=256), camera(math.radians(20), f=2000, size=256)]
    grid = geometry.common_grid(cams, [(256, 256)] * 2)
    d1, d2 = (geometry.Dewarper(c, grid, (256, 256)) for c in cams)
    frames = []
    for seed in range(3):
        a1, _, a2, _ = views(spark, cams, 256, (0, 0, 0), 900, z=1.5, seed=seed)
        frames.append((a1.ravel().tolist(), a2.ravel().tolist()))
    df = spark.createDataFrame(frames, "pixels_1 array<double>, pixels_2 array<double>")
    n1, n2, report = piv.self_calibrate(df, d1, d2)
    turns = report.turns
    assert turns[0]["disparity"] > 1 and turns[-1]["disparity"] < 0.3 * turns[0]["disparity"]
    assert abs(turns[0]["plane"][0] - 1.5) < 0.3
    assert turns[-1]["plane"] is None and report.converged == (turns[-1]["disparity"] < 0.05) and n1.grid is grid and n2.size == d2.size
    p = np.array([[3.0, -2.0, 0.0], [0.0, 1.0, 0.5]])  # the whole transform takes new coordinates to old ones
    assert np.allclose(n1.camera.world_to_pixel(p), d1.camera.world_to_pixel(p @ report.R.T + report.t), atol=1e-6)
    same, _, at_once = piv.self_calibrate(df, n1, n2, tol=10)
    assert at_once.converged and len(at_once.turns) == 1 and same is n1


def test_a_sheets_transform_keeps_what_the_first_camera_sees():
    cam = camera(math.radians(-25), f=2000, size=256)
    for z in (0.0, 2.0):
        R, t = geometry.plane_transform(0.7, 0.02, -0.03, cam, z)
        assert np.allclose(R.T @ R, np.eye(3)) and np.linalg.det(R) > 0
        new = np.array([[1.0, 2.0, z], [-4.0, 3.0, z], [0.0, 0.0, z]])
        old = new @ R.T + t
        assert np.allclose(old[:, 2], 0.7 + 0.02 * old[:, 0] - 0.03 * old[:, 1])
        assert np.allclose(geometry.transformed(cam, R, t).world_to_pixel(new[2:]), cam.world_to_pixel(np.array([[0, 0, z]])), atol=0.05)


def test_results_come_out_pair_by_pair_until_cancelled(spark):
    rows = spark.range(60).selectExpr("id % 6 AS pair_id", "id AS u")
    got = []
    assert piv.each_result(rows, lambda k, r: got.append((k, sorted(r["u"])))) == 6
    assert got == [(k, list(range(k, 60, 6))) for k in range(6)]
    some = []
    assert piv.each_result(rows, lambda k, r: some.append(k), cancelled=lambda: len(some) == 2) == 2 and some == [0, 1]


def test_scales_go_along_and_validators_may_be_functions(spark):
    f = Q.gf(spark, "/root/testdata/sf0.001").limit(50).cache()
    s = PhysicalScale(0.5, 0.1, "mm", "s")
    held = fields.with_scale(f, s)
    assert fields.attached_scale(held) == s and fields.with_scale(held, None).columns == f.columns and fields.attached_scale(f) is None
    a, b = (x.select("frame", "gi", "gj", "x", "velocity_unit").orderBy("frame", "gi", "gj").collect() for x in (fields.physical(held), fields.physical(f, s)))
    assert a == b and fields.physical(f).columns == f.columns
    flagged = fields.validate(f, [lambda rows: rows["x"] > 60])
    assert flagged.filter("outlier AND x <= 60").exceptAll(f.filter("outlier AND NOT masked AND x <= 60")).isEmpty() and flagged.filter("x > 60 AND NOT masked AND NOT outlier").isEmpty()
    im = np.random.default_rng(0).random((64, 64))
    own = piv.run_piv(im, im, [PIVParameters((32, 32), uod_enable=False, replace_outliers=False, n_peaks=1, validation=(lambda z: z.x[None, :] + 0 * z.u > 20,))])
    assert (own.outliers == (own.x[None, :] + 0 * own.u > 20)).all()


def test_ptv_and_tracking(spark):
    frames = Q.recording(spark, 6, density=0.004)
    m = ptv.run_ptv_sequence(recordings.image_pairs(frames), frames, PTVParameters()).toPandas()
    assert len(m) > 50 and abs(m.u.median() - 1.5) < 0.05 and abs(m.v.median() + 0.8) < 0.05
    found = ptv.detect_particles(frames, PTVParameters(threshold=0.2), keys=("recording",))
    t = ptv.track_particles(found, PTVParameters(search_radius=2.5), min_track_length=4)
    p = tracks.trajectory_velocities(tracks.exploded(t)).toPandas()
    assert len(p) > 100 and abs(p.u.median() - 1.5) < 0.1 and abs(p.v.median() + 0.8) < 0.1
    assert tracks.trajectory_points(t).count() >= len(p)


def test_gap_bridging_over_frames(spark):
    rows = [("r", k, n, x + k, y + k, 1.0, 3.0) for k in (1, 2, 4) for n, (x, y) in enumerate(((10.0, 10.0), (40.0, 30.0)), 1)]
    found = spark.createDataFrame(rows, "recording string, frame_idx long, particle_id int, x double, y double, intensity double, diameter double")
    got = ptv.track_particles(found, PTVParameters(search_radius=2, uod_enable=False), 3, 1).collect()
    assert [[p.frame for p in t.points] for t in got] == [[1, 2, 4], [1, 2, 4]]
    s = tracks.track_summary(tracks.exploded(spark.createDataFrame(got))).collect()
    assert all(r.gaps == 1 and r.mean_speed == pytest.approx(math.sqrt(2)) for r in s)
    assert ptv.track_particles(found, PTVParameters(search_radius=2, uod_enable=False), 3, 0).count() == 0


def test_tracks_of_recordings_are_numbered_by_start_and_place(spark):
    kind = "recording string, frame_idx long, particle_id int, x double, y double, intensity double, diameter double"
    short = [(r, k, n, x + k, 10.0, 1.0, None) for r in ("a", None) for n, x, frames in ((1, 60.0, (1, 2, 3)), (2, 30.0, (1, 2, 3, 4, 5)), (3, 90.0, (3, 4, 5))) for k in frames]
    found = spark.createDataFrame([*short, ("a", None, 9, 5.0, 5.0, 1.0, 1.0)], kind)
    got = ptv.track_particles(found, PTVParameters(search_radius=2, uod_enable=False), 3)
    assert got.schema.simpleString() == spark.createDataFrame([], TRACKS).schema.simpleString()
    rows = sorted(((r.recording or "", r.track_id, r.start_frame, [(p.frame, p.x) for p in r.points]) for r in got.collect()), key=lambda r: r[:2])
    want = [(1, 1, [(k, 30.0 + k) for k in range(1, 6)]), (2, 1, [(k, 60.0 + k) for k in range(1, 4)]), (3, 3, [(k, 90.0 + k) for k in range(3, 6)])]
    assert rows == [(r, *w) for r in ("", "a") for w in want]
    assert ptv.track_particles(found.limit(0)).count() == 0


def test_linear_field(spark):
    rows = [(1, i, j, float(j), float(i), 2.0 * j + 3 * i, -1.0 * j + 4 * i, False, (i, j) == (2, 3)) for i in range(1, 6) for j in range(1, 5)]
    f = spark.createDataFrame(rows, "frame int, gi int, gj int, x double, y double, u double, v double, masked boolean, outlier boolean")
    d = {(r.gi, r.gj): r for r in fields.derived(fields.flow_derivatives(f, include_invalid=True)).collect()}[(3, 2)]
    assert (d.dudx, d.dudy, d.dvdx, d.dvdy, d.vorticity, d.divergence, d.q_criterion) == (2, 3, -1, 4, -4, 6, -7) and d.swirling_strength == pytest.approx(math.sqrt(2))
    d = {(r.gi, r.gj): r for r in fields.flow_derivatives(f).collect()}
    assert math.isnan(d[(2, 3)].dudx) and d[(2, 2)].dudx == 2 and math.isnan(d[(2, 4)].dudx) and math.isnan(d[(1, 3)].dudy) and d[(3, 3)].dudy == 3
    whole = fields.circulation_contour(f, [(1, 1), (4, 1), (4, 5), (1, 5)], include_invalid=True).first()
    assert whole.circulation == pytest.approx(-4 * 3 * 4)
    assert fields.error_statistics(f, 2 * F.col("x") + 3 * F.col("y") - 0.5, -F.col("x") + 4 * F.col("y") + 0.25).first() == (19, 0.5, 0.5, -0.25, 0.25)


def test_samples_whatever_order_points_come_in(spark):
    """Rows come in another order at each reading, as they do after a shuffle between machines."""
    rows = [(t, i, j, float(j), float(i), t + 2.0 * j + 3 * i, t - 1.0 * j + 4 * i, False, False) for t in (10, 50) for i in range(1, 6) for j in range(1, 5)]
    f = spark.createDataFrame(rows, "frame int, gi int, gj int, x double, y double, u double, v double, masked boolean, outlier boolean").coalesce(1)

    def mixed(parts):
        for p in parts:
            yield p.take(np.random.default_rng().permutation(p.num_rows))

    ask = spark.range(400).coalesce(1).selectExpr("id", "CAST(id % 2 * 40 + 10 AS INT) AS frame", "1 + id % 37 / 12.5D AS x", "1 + id % 41 / 10.25D AS y")
    got = fields.sample(f, ask.mapInArrow(mixed, ask.schema)).collect()
    assert len(got) == 400 and all(r.u == pytest.approx(r.frame + 2 * r.x + 3 * r.y) and r.v == pytest.approx(r.frame - r.x + 4 * r.y) for r in got)
    one = spark.createDataFrame([(10, 1.0, 1.0), (10, 1.0, 1.0), (10, 4.0, 5.0), (10, 4.1, 2.0), (10, None, 2.0)], "frame int, x double, y double")
    held = fields.sample(f, one).collect()
    assert sorted(r.u for r in held if not math.isnan(r.u)) == [15.0, 15.0, 33.0] and len(held) == 5


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    shots = [np.round(rng.random((12, 17)) * 65535) / 65535 for _ in range(3)]
    for k, a in enumerate(shots):
        (tmp_path / f"img_{k:03d}.png").write_bytes(images.encode_png(a))
    df = images.load_frames(spark, str(tmp_path), glob="*.png")
    got = {r.frame_idx: np.reshape(r.pixels, (r.n_rows, r.n_cols)) for r in df.collect()}
    assert all(np.allclose(got[k], a) for k, a in enumerate(shots, 1))
    (tmp_path / "img_001a.tif").write_bytes(images.encode_tiff(shots[:2]))
    for bound in (100, 0):  # numbers broadcast, or joined
        mixed = sorted(images.load_frames(spark, str(tmp_path), glob="img*", broadcast_files=bound).collect(), key=lambda r: r.frame_idx)
        assert [(r.frame_idx, r.label) for r in mixed] == [(1, "img_000.png"), (2, "img_001.png"), (3, "img_001a.tif"), (4, "img_001a.tif"), (5, "img_002.png")]
        assert all(np.allclose(np.reshape(r.pixels, (12, 17)), shots[k]) for r, k in zip(mixed, (0, 1, 0, 1, 2), strict=True))
    (tmp_path / "stack.tif").write_bytes(images.encode_tiff(shots))
    spark.dataSource.register(images.TiffStack)
    pages = spark.read.format("tiff_stack").load(str(tmp_path / "stack.tif")).orderBy("frame_idx").collect()
    assert all(np.allclose(np.reshape(r.pixels, (12, 17)), a) for r, a in zip(pages, shots, strict=True))
    assert np.allclose(images.decode((tmp_path / "stack.tif").read_bytes(), 2), shots[2])
    lazy = images.frame_source(spark, 3, lambda i: shots[i - 1], timestamps=[0.0, 0.1, 0.25])
    assert [round(r.dt, 3) for r in recordings.image_pairs(lazy, "chained", ts="ts").orderBy("pair_id").collect()] == [0.1, 0.15]
    with pytest.raises(ValueError):
        images.frame_source(spark, 3, lambda i: shots[0], labels=["a"])


def test_filtered_png_rows():
    import struct
    import zlib

    a = (np.arange(48).reshape(6, 8) * 5 % 256).astype(np.uint8)
    lines, before = b"", np.zeros(8, int)
    for r in range(6):
        x, left, kind = a[r].astype(int), np.r_[0, a[r][:-1].astype(int)], r % 5
        corner = np.r_[0, before[:-1]]
        p = left + before - corner
        pa, pb, pc = abs(p - left), abs(p - before), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, before, corner))
        base = [0 * x, left, before, (left + before) // 2, paeth][kind]
        lines += bytes([kind]) + ((x - base) % 256).astype(np.uint8).tobytes()
        before = x
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0" * 4
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.allclose(images.decode_png(png) * 255, a)


def test_archive_tables_and_vtk(spark, tmp_path):
    a, b, *_ = synthetic.image_pair((64, 64), synthetic.linear_flow(1.0, 0.5), 0.05)
    v = piv.run_piv_sequence(pair_rows(spark, [(a, b), (b, a)]), passes=[PIVParameters((32, 32))]).persist()
    sinks.save_results(v, str(tmp_path / "archive"))
    back = sinks.load_results(spark, str(tmp_path / "archive"))
    assert sorted(map(repr, back.select(v.columns).collect())) == sorted(map(repr, v.collect()))
    t = sinks.export_table(v, scale=PhysicalScale(0.01, 0.001, "mm", "s"), source_a='a "1".tif')
    assert t.columns[:6] == ["schema_version", "result_type", "frame_id", "source_a", "source_b", "point_id"] and len(t.columns) == 27
    sinks.write_csv(t, str(tmp_path / "csv"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert '"a ""1"".tif"' in text and ",false," in text and '"mm/s"' in text and text.count("\n") == 18
    one = v.filter("pair_id = 1")
    lines = [r.value for r in sinks.vtk_text(one).collect()]
    assert lines[4] == "DIMENSIONS 3 3 1" and lines[5] == "POINTS 9 double" and lines[6].startswith("16.5 16.5") and lines[7].startswith("32.5 16.5") and "POINT_DATA 9" in lines
    with pytest.raises(ValueError):
        sinks.export_table(v, "other")


def test_live_recordings(spark, tmp_path):
    frames = Q.recording(spark, 4, 64).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1000))
    frames.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = streaming.live_piv(streaming.live_pairs(stream), str(tmp_path / "out"), str(tmp_path / "ck"), passes=[PIVParameters((32, 32))], on_result=lambda n, rows: seen.append(("result", rows.count())), progress=lambda n: seen.append(("done", n)))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("pair_id").distinct().count() == 3 and abs(got.agg(F.median("u")).first()[0] - 1.5) < 0.3
    assert [k for k, _ in seen][:2] == ["result", "done"]


def test_live_tracks_and_ensemble(spark, tmp_path):
    rows = [("r", k, 1, 10.0 + k, 10.0 + k, 1.0, 3.0) for k in (1, 2, 4)] + [("r", k, 1, 50.0, 50.0, 1.0, 3.0) for k in (8, 9)]
    kind = "recording string, frame_idx long, particle_id int, x double, y double, intensity double, diameter double"
    spark.createDataFrame(rows, kind).repartition(1).write.parquet(str(tmp_path / "p"))
    out = streaming.live_tracks(spark.readStream.schema(kind).parquet(str(tmp_path / "p")), PTVParameters(search_radius=2, uod_enable=False), max_gap=1)
    q = out.writeStream.format("memory").queryName("live_tracks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert [r.frame for r in spark.sql("SELECT frame FROM live_tracks ORDER BY frame").collect()] == [1, 2, 4]
    spark.createDataFrame([(j, [1.0 * j, 2.0]) for j in (1, 2) for _ in range(3)], "job int, plane array<double>").repartition(1).write.parquet(str(tmp_path / "e"))
    out = streaming.live_ensemble(spark.readStream.schema("job int, plane array<double>").parquet(str(tmp_path / "e")))
    q = out.writeStream.format("memory").queryName("live_planes").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {r.job: (r.plane, r.n) for r in spark.sql("SELECT * FROM live_planes").collect()} == {1: ([3.0, 6.0], 3), 2: ([6.0, 6.0], 3)}


def test_live_tracks_equal_those_of_the_recording(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for rec in ("r", "s"):
        for k in range(1, 25):
            for i in range(6):
                if rng.random() < 0.9 and not (rec == "s" and 10 <= k <= 13):
                    rows.append((rec, k, i + 1, 10.0 + 12 * i + 0.8 * k + rng.normal(0, 0.05), 20.0 + 3 * (i % 2) * k / 10, 1.0, 3.0))
    kind = "recording string, frame_idx long, particle_id int, x double, y double, intensity double, diameter double"
    found = spark.createDataFrame(rows, kind)
    p = PTVParameters(search_radius=2, uod_enable=False)
    want = {tuple((q.frame, q.x, q.y) for q in r.points) for r in ptv.track_particles(found, p, max_gap=1).collect()}
    for n, (lo, hi) in enumerate(((1, 3), (4, 4), (5, 15), (16, 24))):  # a batch of the stream each
        found.filter(F.col("frame_idx").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streaming.live_tracks(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), p, max_gap=1)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if n == 0:
            assert spark.read.parquet(str(tmp_path / "out")).count() > 0  # points come before their tracks end
    by = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect():
        by.setdefault((r.recording, r.track_id), []).append((r.frame, r.x, r.y))
    assert {tuple(v) for v in by.values()} == want and len(by) == len(want) > 8


def test_state_of_a_track_does_not_grow(spark, tmp_path):
    kind = "recording string, frame_idx long, particle_id int, x double, y double, intensity double, diameter double"
    sizes = []
    for lo, hi in ((1, 5), (6, 400)):
        spark.createDataFrame([("r", k, 1, 10.0 + 0.5 * k, 10.0, 1.0, 3.0) for k in range(lo, hi + 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streaming.live_tracks(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), PTVParameters(search_radius=2, uod_enable=False))
        q = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "heads").option("flattenCollectionTypes", "true").load().selectExpr("length(to_json(struct(*))) AS n").collect()
        sizes.append([r.n for r in state])
    assert len(sizes[0]) == len(sizes[1]) == 1 and sizes[1][0] <= sizes[0][0] + 16, sizes  # a digit more here and there


def test_live_table(spark, tmp_path):
    from swirlframe.streaming import LiveTable

    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    t = LiveTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], buckets=8)
    assert t.read().collect() == [] and t.versions() == []
    assert t.upsert(make([(i, "a") for i in range(40)]), 0) and t.upsert(make([(3, "b"), (100, "b")]), 1)
    see = lambda version=None: {r.k: r.v for r in t.read(version).collect()}
    first = dict.fromkeys(range(40), "a")
    assert see(0) == first and see() == first | {3: "b", 100: "b"}
    assert t.upsert(make([(5, "never")]), 1) is False and see() == first | {3: "b", 100: "b"} and t.versions() == [0, 1]
    written_ = sorted(p.name for p in (tmp_path / "t/data/batch-000000000001").glob("b=*"))
    assert 1 <= len(written_) <= 2  # changed buckets only
    with pytest.raises(Exception):
        t.upsert(make([(7, "half")]), 2, merge=lambda old, new: new.withColumn("v", F.raise_error(F.lit("stop")).cast("string")))
    assert see() == first | {3: "b", 100: "b"} and t.versions() == [0, 1]
    held = t.read()  # a reader that opened a version goes on with it
    assert t.upsert(make([(7, "c")]), 2) and {r.k: r.v for r in held.collect()} == first | {3: "b", 100: "b"}
    assert t.upsert(make([]), 3) and see(3) == see(2)
    t.vacuum(keep=1)
    assert t.versions() == [3] and see() == first | {3: "b", 100: "b", 7: "c"}
    with pytest.raises(ValueError):
        t.read(0)


def test_ensembles_grow_in_a_live_table(spark, tmp_path):
    table = streaming.live_ensemble_table(spark, str(tmp_path / "t"), buckets=4)
    schema = "job int, plane array<double>"
    for n, jobs in enumerate(((1, 2, 2), (2, 3), (1,))):
        spark.createDataFrame([(j, [1.0 * j, float(n)]) for j in jobs], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.grow(table, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
    see = lambda version: {r.job: (r.plane, r.n) for r in table.read(version).collect()}
    last = {1: ([2.0, 2.0], 2), 2: ([6.0, 1.0], 3), 3: ([3.0, 1.0], 1)}
    assert len(table.versions()) == 3 and see(None) == last and see(table.versions()[0]) == {1: ([1.0, 0.0], 1), 2: ([4.0, 0.0], 2)}


def test_tracker_state_round_trips():
    t = particles.Tracker(PTVParameters(uod_enable=False), 0)
    t.add(1, {"x": np.array([5.0]), "y": np.array([5.0]), "intensity": np.ones(1), "diameter": np.array([3.0])})
    assert len(t.live) == 1 and t.tracks(1)[0][0][:3] == (1, 5.0, 5.0)


def test_calibration_of_plates(spark):
    from swirlframe.operators import calibration

    cam = camera(0.1, f=2500, size=384)
    shots = [(1, k, z, 384, 384, synthetic.calibration_target(cam, (384, 384), 6.0, z=z, nodes=5).ravel().tolist()) for k, z in enumerate((-3.0, 0.0, 3.0))]
    plates = spark.createDataFrame(shots, "camera int, plane int, z double, n_rows int, n_cols int, pixels array<double>")
    points = calibration.detect_plates(plates, 6.0).persist()
    assert points.count() > 200
    for model, most in (("pinhole", 0.3), ("soloff", 0.3)):
        fitted = calibration.calibrate_cameras(points, model)
        q = calibration.calibration_quality(calibration.reprojection_errors(points, fitted), "camera").first()
        assert q.rms < most and q.n == points.count()
    shots = [(1, k, z, 384, 384, synthetic.calibration_target(cam, (384, 384), 6.0, z=z, nodes=5, level_separation=2.0, square=(-6.0, -3.0)).ravel().tolist()) for k, z in enumerate((-3.0, 0.0, 3.0))]
    two = calibration.detect_plates(spark.createDataFrame(shots, plates.schema), 6.0, two_level=True, level_separation=2.0, origin_offset=(6.0, 3.0)).persist()
    assert two.filter("level = 1").count() > 100 and two.filter("level <> abs(i) % 2 or level <> abs(j) % 2").count() == 0
    q = calibration.calibration_quality(calibration.reprojection_errors(two, calibration.calibrate_cameras(two, "soloff")), "camera").first()
    assert q.rms < 0.1 and q.n == two.count()


def test_smoothing_by_frame(spark):
    a, b, *_ = synthetic.image_pair((96, 96), synthetic.linear_flow(1.0, 0.5), 0.05)
    v = piv.run_piv_sequence(pair_rows(spark, [(a, b), (b, a)]), passes=[PIVParameters((32, 32))])
    got = piv.smooth_fields(v).groupBy("pair_id").agg(F.avg("u").alias("u")).orderBy("pair_id").collect()
    assert abs(got[0].u - 1) < 0.1 and abs(got[1].u + 1) < 0.1


def test_scale_and_names(spark):
    from swirlframe import functions as C

    assert C.scale_from_points((0, 0), (3, 4), 10.0, 0.1).pixel_size == 2.0
    df = spark.createDataFrame([("x/img_0001.tif", "x/img_0002.tif"), ("run10_A.png", "run20_A.png"), ("f_099.png", "f_100.png"), ("cam1_5", "cam1_6")], "a string, b string")
    assert [tuple(r.s) for r in df.select(C.index_strings("a", "b").alias("s")).collect()] == [("0001", "0002"), ("10", "20"), ("099", "100"), ("5", "6")]
    with pytest.raises(ValueError):
        C.frame_index_strings("a/x.png", "b/x.tif")
