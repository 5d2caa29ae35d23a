"""Kernels against analytic truth and synthetic images."""

import math

import numpy as np
import pytest

from swirlframe.kernels import correlation, deformation, geometry, images, neighbourhood, particles, piv, synthetic, uncertainty
from swirlframe.params import PIVParameters, PTVParameters, effort_schedule, multipass_parameters, parse_validator


def spot(shape, r, c, s=1.5, a=1.0):
    y, x = np.mgrid[1 : shape[0] + 1, 1 : shape[1] + 1]
    return a * np.exp(-((y - r) ** 2 + (x - c) ** 2) / (2 * s * s))


@pytest.mark.parametrize("move", [(2.2, 1.3), (-3.4, 2.6), (0.0, 0.0)])
@pytest.mark.parametrize("method", ["cross", "phase"])
def test_single_particle(move, method):
    a, b = spot((64, 64), 32, 32), spot((64, 64), 32 + move[0], 32 + move[1])
    du, dv, _ = correlation.correlate(a, b, correlation.Plan((64, 64), (64, 64), method=method))
    assert du == pytest.approx(move[1], abs=0.1) and dv == pytest.approx(move[0], abs=0.1)


def test_padded_apodised_and_iterated():
    a, b = spot((64, 64), 32, 32), spot((64, 64), 34.2, 33.3)
    for padding, apod in ((True, "none"), (True, "gauss"), (False, "gauss")):
        du, dv, plane = correlation.correlate(a, b, correlation.Plan((64, 64), (64, 64), padding, apod))
        assert plane.shape == ((128, 128) if padding else (64, 64))
        assert abs(du - 1.3) < 0.1 and abs(dv - 2.2) < 0.1
    u, v = correlation.correlate_deformable(a, spot((64, 64), 32 + 3.6, 32 - 2.3), iterations=4)
    assert abs(u + 2.3) < 0.05 and abs(v - 3.6) < 0.05


def test_rounding_and_two_dimensional_fit():
    a, b = spot((64, 64), 32, 32), spot((64, 64), 34.7, 30.6)
    assert correlation.correlate(a, b, subpixel_method="none")[:2] == (-1.0, 3.0)
    for method, tol in (("gauss3", 0.1), ("gauss2d", 0.15), ("gauss9", 0.1)):
        du, dv, _ = correlation.correlate(a, b, subpixel_method=method)
        assert abs(du + 1.4) < tol and abs(dv - 2.7) < tol


def test_rotated_gaussian():
    i, j = np.mgrid[1:34, 1:34]
    di, dj = i - 17.3, j - 15.6
    r = np.exp(-(0.20 * di**2 + 0.16 * di * dj + 0.10 * dj**2))[None]
    at = np.unravel_index(r[0].argmax(), r[0].shape)
    fine = [np.hypot(*(np.array(correlation.subpixel(r, np.array([at[0]]), np.array([at[1]]), m))[:, 0] - (16.3, 14.6))) for m in ("gauss9", "gauss3")]
    assert fine[0] < 1e-8 < fine[1]


def test_peaks():
    r = (spot((32, 32), 16, 16) + spot((32, 32), 8, 24, a=0.6) + spot((32, 32), 26, 6, a=0.3))[None]
    v, i, j = correlation.find_peaks(r, 3)
    assert list(zip(i[0] + 1, j[0] + 1, strict=True)) == [(16, 16), (8, 24), (26, 6)]
    near = np.zeros((1, 16, 16))
    near[0, 7, 7], near[0, 7, 8], near[0, 7, 9] = 1, 0.1, 0.8
    v, _, _ = correlation.find_peaks(near, 2, "regionalmax")
    assert v[0].tolist() == [1, 0.8] and correlation.peak_ratio(v)[0] == pytest.approx(1.25)
    v, _, _ = correlation.find_peaks(near, 2, "exclusion")
    assert np.isnan(v[0, 1]) and correlation.peak_ratio(v)[0] == np.inf
    flat = np.ones((1, 5, 5))
    m = correlation.local_maxima(flat)[0]
    assert m.sum() == 1 and m[4, 4]


def test_enlarged_search_area():
    a, b, *_ = synthetic.image_pair((128, 128), synthetic.linear_flow(11.0, -9.0), 0.05)
    small = piv.run(a, b, [PIVParameters((32, 32))])
    large = piv.run(a, b, [PIVParameters((32, 32), (64, 64))])
    assert abs(np.median(large.u) - 11) < 0.1 and abs(np.median(large.v) + 9) < 0.1
    assert large.u.shape < small.u.shape


def test_uniform_flow():
    a, b, *_ = synthetic.image_pair((128, 128), synthetic.linear_flow(2.0, 3.0), 0.015)
    f = piv.run(a, b, [PIVParameters((32, 32))])
    assert abs(np.median(f.u) - 2) < 0.25 and abs(np.median(f.v) - 3) < 0.25
    f = piv.run(a, b, [PIVParameters((32, 32), padding=True, apodization="gauss")])
    assert abs(np.median(f.u) - 2) < 0.05 and np.abs(f.u - 2).max() < 0.2
    assert f.x[0] == 16.5 and f.x[1] - f.x[0] == 16


def test_shear_and_iteration():
    a, b, *_ = synthetic.image_pair((128, 128), synthetic.shear_flow(1 / 16, 64), 0.06)
    passes = multipass_parameters([64, 32, 16, 16], padding=True, apodization="gauss")
    f = piv.run(a, b, passes)
    err = f.u - ((f.y - 64) / 16)[:, None]
    one = piv.run(a, b, [passes[-1]])
    assert np.sqrt((err**2).mean()) < 0.12 and np.sqrt((f.v**2).mean()) < 0.08
    assert np.sqrt((err**2).mean()) < np.sqrt(((one.u - ((one.y - 64) / 16)[:, None]) ** 2).mean())
    again = piv.run(a, b, [PIVParameters((32, 32), max_iterations=3, convergence_tol=0)])
    three = piv.run(a, b, [PIVParameters((32, 32))] * 3)
    assert np.array_equal(again.u, three.u) and np.array_equal(again.outliers, three.outliers)
    assert piv.run(a, b, [PIVParameters((32, 32), max_iterations=5, convergence_tol=1e9)]).passes == 2


def test_masked_region():
    rng = np.random.default_rng(3)
    a, b, *_ = synthetic.image_pair((128, 128), synthetic.linear_flow(1.0, 2.0), 0.05)
    mask = np.zeros(a.shape, bool)
    mask[48:80, 48:80] = True
    a[mask], b[mask] = rng.random(mask.sum()), rng.random(mask.sum())
    f = piv.run(a, b, [PIVParameters((32, 32))], mask)
    g = piv.run(a, b, [PIVParameters((32, 32))], mask, mask_threshold=1.0)
    assert np.array_equal(np.isnan(f.u), f.mask) and not (f.mask & f.outliers).any() and g.mask.sum() < f.mask.sum() > 0
    assert np.nanmedian(np.abs(f.u - 1)) < 0.1


def test_uncertainty_follows_noise():
    got = []
    for noise in (0.02, 0.05, 0.1, 0.2):
        a, b, *_ = synthetic.image_pair((160, 160), synthetic.linear_flow(0.3, 0.6), 0.02, noise=noise)
        f = piv.run(a, b, multipass_parameters([32, 32], padding=True, apodization="gauss", final={"uncertainty": True}))
        rms = np.sqrt(((f.u - 0.3) ** 2).mean())
        got.append((np.nanmedian(f.uncertainty_u), rms))
    s = [x for x, _ in got]
    assert s == sorted(s) and s[-1] > 4 * s[0]
    assert all(0.3 < x / r < 2.5 for x, r in got)


def test_uncertainty_sums_add_up():
    rng = np.random.default_rng(0)
    a, b = rng.random((6, 16, 16)), rng.random((6, 16, 16))
    whole, part = uncertainty.sums(a, b)[0], np.concatenate([uncertainty.sums(a[:2], b[:2])[0], uncertainty.sums(a[2:], b[2:])[0]])
    assert np.allclose(whole, part) and whole.shape == (6, 44) and len(uncertainty.OFFSETS) == 40


def test_spline_interpolates():
    rng = np.random.default_rng(1)
    f = rng.random((9, 12))
    r, c = np.mgrid[0:9, 0:12].astype(float)
    s = deformation.Spline(f)
    assert np.allclose(s(r, c), f) and (s(r + 100, c) == 0).all()
    y, x = np.mgrid[0:9, 0:12].astype(float)
    plane = deformation.Spline(2 * x - y)
    assert np.allclose(plane(r[:-1] + 0.3, c[:-1]), (2 * x - y)[:-1] - 0.3)


def test_median_test_replacement_smoothing():
    u, v = np.tile(np.arange(1.0, 7), (6, 1)), np.zeros((6, 6))
    u[2, 3] = 99
    flag = neighbourhood.outliers(u, v, 2.0, 2)
    assert flag[2, 3]
    u2, _ = neighbourhood.replace(u, v, np.isclose(u, 99))
    assert u2[2, 3] == 4.0
    lone = np.full((3, 3), 5.0)
    bad = np.ones((3, 3), bool)
    bad[0, 0] = False
    assert np.array_equal(neighbourhood.replace(lone, lone, bad)[0], lone)
    assert np.allclose(neighbourhood.smooth(np.full((5, 4), 3.0)), 3)
    i, j = np.mgrid[0:6, 0:6]
    assert np.allclose(neighbourhood.smooth((i + 2.0 * j))[1:-1, 1:-1], (i + 2 * j)[1:-1, 1:-1])
    nan = np.full((8, 8), 3.0) + np.random.default_rng(0).normal(0, 0.05, (8, 8))
    ex = np.zeros((8, 8), bool)
    ex[3:5, 3:5] = True
    nan[ex] = np.nan
    assert not neighbourhood.outliers(nan, nan, 6.0, 2, exclude=ex).any()


def test_smoothn():
    rng = np.random.default_rng(0)
    i, j = np.mgrid[0:24, 0:30] / 8
    clean = np.sin(i) + np.cos(j)
    noisy = clean + rng.normal(0, 0.2, clean.shape)
    z = neighbourhood.smoothn(noisy)
    assert np.sqrt(((z - clean) ** 2).mean()) < 0.5 * np.sqrt(((noisy - clean) ** 2).mean())
    spiked = noisy.copy()
    spiked[5, 5] = 50
    assert abs(neighbourhood.smoothn(spiked, robust=True)[5, 5] - clean[5, 5]) < 0.5
    hole = noisy.copy()
    hole[8:11, 8:11] = np.nan
    assert np.abs(neighbourhood.smoothn(hole) - clean).max() < 1


def test_scattered_outliers_and_cells():
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 100, 300), rng.uniform(0, 100, 300)
    u, v = 3 + rng.normal(0, 0.05, 300), 2 + rng.normal(0, 0.05, 300)
    u[:5] += 12
    v[:5] -= 10
    assert np.flatnonzero(neighbourhood.scattered_outliers(x, y, u, v)).tolist() == [0, 1, 2, 3, 4]
    assert not neighbourhood.scattered_outliers(x[:2], y[:2], u[:2], v[:2]).any()
    near = neighbourhood.Cells(x, y).nearest(x, y, 5, skip=np.arange(300))
    d = np.hypot(x[:, None] - x, y[:, None] - y) + np.diag(np.full(300, np.inf))
    assert np.array_equal(near, np.argsort(d, axis=1, kind="stable")[:, :5])
    assert np.array_equal(neighbourhood.Cells(x, y, 7.0).within(50, 50, 12.5), np.flatnonzero((x - 50) ** 2 + (y - 50) ** 2 <= 12.5**2))


def test_images_and_masks():
    assert images.invert_image(np.array([[1, 2], [3, 4]])).tolist() == [[4, 3], [2, 1]]
    s = images.percentile_stretch(np.arange(1.0, 101).reshape(10, 10))
    assert s.min() == 0 and s.max() == 1 and (images.percentile_stretch(np.ones((3, 3))) == 0.5).all() and (images.clahe(np.ones((16, 16))) == 0.5).all()
    seed = np.zeros((9, 9), bool)
    seed[4, 4] = True
    assert images.grow_mask(seed, 2).sum() == 13 and np.array_equal(images.shrink_mask(images.grow_mask(seed, 2), 2), seed)
    tri = images.polygon_mask((10, 10), [(2, 2), (8, 2), (8, 8), (2, 8)])
    assert tri[1:7, 1:8].all() and tri.sum() == 42
    f = np.random.default_rng(0).random((7, 9))
    v = images.local_variance(f, 2)
    assert v[0, 0] == pytest.approx(f[:3, :3].var()) and v[3, 4] == pytest.approx(f[1:6, 2:7].var())
    assert images.gaussian_blur(np.full((8, 8), 2.0), 1.5) == pytest.approx(2.0)
    run = images.build_preprocess([("invert_image", {}), ("clahe", {"enabled": False}), ("percentile_stretch", {"low": 0, "high": 100})])
    assert run(f).max() == 1
    c = images.clahe(f, (2, 2))
    assert c.min() >= 0 and c.max() <= 1
    assert images.automatic_mask(f).mean() == pytest.approx(0.05, abs=0.03)
    assert 0.1 < images.otsu_threshold(np.r_[np.linspace(0, 0.2, 50), np.linspace(0.8, 1, 50)]) < 0.8


def test_detection_and_matching():
    rng = np.random.default_rng(5)
    gy, gx = (g.ravel() * 16.0 + 10 for g in np.mgrid[0:15, 0:15])
    truth = {"x": gx + rng.uniform(-3, 3, 225), "y": gy + rng.uniform(-3, 3, 225), "z": np.zeros(225), "intensity": np.ones(225), "diameter": rng.uniform(2.5, 4, 225)}
    img = synthetic.render(truth, (256, 256), noise=0, sheet=lambda z: np.ones_like(z))
    got = particles.detect(img, PTVParameters(threshold=0.1))
    d = np.hypot(truth["x"][:, None] - got["x"], truth["y"][:, None] - got["y"])
    assert len(got["x"]) == 225 and d.min(axis=1).max() < 0.02
    moved = {k: v.copy() for k, v in truth.items()}
    moved["x"] += 1.5
    moved["y"] -= 1.0
    b = particles.detect(synthetic.render(moved, (256, 256), noise=0, sheet=lambda z: np.ones_like(z)), PTVParameters(threshold=0.1))
    m = particles.track_pair(got, b, PTVParameters())
    assert len(m["u"]) >= 220 and np.abs(m["u"] - 1.5).max() < 0.05 and not m["outlier"].any()


def test_gap_is_bridged():
    t = particles.Tracker(PTVParameters(search_radius=2, uod_enable=False), max_gap=1)
    at = lambda k: {"x": np.array([10.0 + k, 40 + k]), "y": np.array([10.0 + k, 30 + k]), "intensity": np.ones(2), "diameter": np.full(2, 3.0)}
    for k in (1, 2, 3, 4):
        t.add(k, {n: np.zeros(0) for n in particles.FIELDS} if k == 3 else at(k))
    got = t.tracks(3)
    assert [[q[0] for q in x] for x in got] == [[1, 2, 4], [1, 2, 4]]


def camera(yaw, f=3500.0, size=512):
    c, s = math.cos(yaw), math.sin(yaw)
    R = np.diag([1, -1, -1.0]) @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])
    K = np.array([[f, 0, size / 2], [0, f, size / 2], [0, 0, 1.0]])
    return geometry.PinholeCamera(K @ np.column_stack([R, [0, 0, 700.0]]))


def test_cameras():
    cam = camera(0.3)
    g = np.array([(x, y, z) for x in (-20, -10, 0, 10, 20) for y in (-20, -10, 0, 10, 20) for z in (-2, 0, 2)], float)
    px = cam.world_to_pixel(g)
    assert np.allclose(cam.pixel_to_world(px[g[:, 2] == 2], 2.0), g[g[:, 2] == 2])
    assert geometry.reprojection(geometry.fit_pinhole(g, px), g, px).max() < 1e-6
    sol = geometry.fit_soloff(g, px)
    assert geometry.reprojection(sol, g, px).max() < 0.05
    assert np.allclose(sol.pixel_to_world(sol.world_to_pixel(g[:5]), -2.0)[:, :2][g[:5, 2] == -2], g[:5][g[:5, 2] == -2][:, :2], atol=1e-6)
    with pytest.raises(ValueError):
        geometry.fit_pinhole(g[g[:, 2] == 0], px[g[:, 2] == 0])
    R, t = geometry.plane_transform(0.5, 0.01, -0.02)
    assert np.allclose(geometry.transformed(cam, R, t).world_to_pixel(g), geometry.TransformedCamera(cam, R, t).world_to_pixel(g))
    flat = np.column_stack([g[:, :2], np.zeros(len(g))]) @ R.T + t
    assert np.allclose(geometry.sheet_plane(flat), (0.5, 0.01, -0.02))


def test_stereo_algebra():
    c1, c2 = camera(math.radians(-18)), camera(math.radians(27))
    w, d = np.array([[3.0, 2.0, 0.0]]), np.array([0.31, -0.22, 0.17])
    t1, t2 = geometry.ray_slopes(c1, w, 1e-3), geometry.ray_slopes(c2, w, 1e-3)
    uv = [(d[0] - t[0] * d[2], d[1] - t[1] * d[2]) for t in (t1, t2)]
    got, _ = geometry.reconstruct(t1, t2, uv[0][0], uv[0][1], uv[1][0], uv[1][1], 1.0, 1.0)
    assert np.allclose(got[0], d, atol=1e-9)


MARKED = {"square": (-10.0, -2.5), "triangle": (-5.0, -2.5)}


def test_plate_is_detected():
    cam = camera(0.2, size=512)
    img = synthetic.calibration_target(cam, (512, 512), 5.0, nodes=6, **MARKED)
    g = geometry.detect_grid(img, 5.0, origin_offset=(10.0, 2.5))
    world, px = geometry.grid_points(g)
    assert len(px) > 80 and np.hypot(*(cam.world_to_pixel(world) - px).T).max() < 0.15
    assert not (g["i"] % 2).any() and not (g["j"] % 2).any() and not g["level"].any()
    noisy = np.clip(img + 0.02 * np.random.default_rng(9).standard_normal(img.shape), 0, 1)
    world, px = geometry.grid_points(geometry.detect_grid(noisy, 5.0, origin_offset=(10.0, 2.5)))
    assert len(px) > 80 and np.hypot(*(cam.world_to_pixel(world) - px).T).max() < 0.25


def test_plate_by_fiducials_is_the_same_however_rolled():
    img = synthetic.calibration_target(camera(0.1, size=512), (512, 512), 5.0, nodes=6, **MARKED)
    a = geometry.detect_grid(img, 5.0, origin_offset=(10.0, 2.5), orientation="fiducials")
    for turn in (1, 2, 3):
        b = geometry.detect_grid(np.rot90(img, turn), 5.0, origin_offset=(10.0, 2.5), orientation="fiducials")
        assert set(zip(a["i"], a["j"], strict=True)) == set(zip(b["i"], b["j"], strict=True))
    rolled = geometry.detect_grid(img[::-1, ::-1], 5.0, origin_offset=(10.0, 2.5), orientation="fiducials")
    assert np.allclose(513 - rolled["px"], a["px"]) and (rolled["i"] == a["i"]).all() and (rolled["j"] == a["j"]).all()


def test_two_level_plate():
    for yaw in (0.0, math.radians(25)):
        cam = camera(yaw, size=512)
        for z in (-3.0, 0.0, 3.0):
            img = synthetic.calibration_target(cam, (512, 512), 5.0, z=z, nodes=6, radius=0.13, level_separation=1.0, **MARKED)
            g = geometry.detect_grid(img, 5.0, two_level=True, level_separation=1.0, origin_offset=(10.0, 2.5))
            world, px = geometry.grid_points(g, z)
            assert len(px) > 80 and 0.3 < g["level"].mean() < 0.7 and (g["level"] == g["i"] % 2).all() and (g["level"] == g["j"] % 2).all()
            assert np.hypot(*(cam.world_to_pixel(world) - px).T).max() < 0.15
    back = geometry.detect_grid(img, 5.0, two_level=True, level_separation=1.0, origin_offset=(10.0, 2.5), origin_level="back")
    assert (back["level"] == 1 - g["level"]).all()


def test_plates_without_markers_and_wrong_requests():
    plain = synthetic.calibration_target(camera(0.0, size=512), (512, 512), 5.0, nodes=6)
    g = geometry.detect_grid(plain, 5.0)
    assert g["square"] is None and g["triangle"] is None and ((g["i"] == 0) & (g["j"] == 0)).sum() == 1
    for bad in ({"orientation": "fiducials"}, {"origin_offset": (10.0, 2.5)}, {"spacing": -1.0}, {"two_level": True}, {"origin_level": "middle"}):
        with pytest.raises(ValueError):
            geometry.detect_grid(plain, **({"spacing": 5.0} | bad))
    with pytest.raises(ValueError):
        geometry.detect_grid(np.zeros((64, 64)), 5.0)


def test_planar_calibration_and_registration():
    t = geometry.planar_calibration((1, 2), (1, 12), 10.0)
    assert np.allclose(t.point((1, 2)), 0) and np.allclose(t.point((1, 12)), (10, 0)) and np.allclose(t.inverse().point(t.point((4, 7))), (4, 7))
    src = np.array([(0, 0), (10, 0), (0, 10), (7, 3)], float)
    m, o = np.array([[1.1, 0.2], [-0.1, 0.9]]), np.array([3, -2.0])
    got = deformation.registration(src, src @ m.T + o)
    assert np.allclose(got[0], m) and np.allclose(got[1], o)


def test_parameters():
    assert [p.window_size[0] for p in effort_schedule("high")] == [128, 64, 32] and effort_schedule("high")[-1].max_iterations == 2 and effort_schedule("high")[-1].uncertainty
    assert [p.window_size[0] for p in effort_schedule("high", ensemble=True)] == [128, 64, 32, 32]
    assert [p.window_size[0] for p in effort_schedule("medium", window_size=16, image_size=(48, 48))] == [32, 16]
    for bad in ({"window_size": (2, 2)}, {"overlap": (32, 0)}, {"search_area_size": (33, 33)}, {"subpixel_method": "x"}, {"uod_threshold": 0}):
        with pytest.raises(ValueError):
            PIVParameters(**bad)
    assert parse_validator(("velocity_magnitude", {"min": 1, "max": 2})).max == 2
    with pytest.raises(ValueError):
        parse_validator(("peak_ratio", {"max": 1}))
