"""Spectra of every node, against NumPy's transform."""

from collections import defaultdict

import numpy as np

import swirlframe.queries as Q

SF = "/root/testdata/sf0.001"


def test_every_node_has_its_spectrum(spark):
    series = defaultdict(list)
    for r in Q.gf(spark, SF).select("gi", "gj", "frame", "u").orderBy("frame").collect():
        series[r.gi, r.gj].append(np.nan if r.u is None else r.u)
    got = {(r.gi, r.gj, r.k): r.psd for r in Q.power_spectrum(spark, SF).collect()}
    n_rows = 0
    for (gi, gj), u in series.items():
        x, n = np.array(u), len(u)
        n_rows += n // 2 + 1
        if np.isnan(x).all():
            assert all(got[gi, gj, k] is None for k in range(n // 2 + 1))
            continue
        x = np.where(np.isnan(x), np.nanmean(x), x)
        w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)))
        psd = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 * 2 / (w**2).sum()
        psd[0] /= 2
        if n % 2 == 0:
            psd[-1] /= 2
        assert np.allclose([got[gi, gj, k] for k in range(n // 2 + 1)], psd, atol=1e-5)
    assert len(got) == n_rows and {gj for _, gj, _ in got} == set(range(1, 9))
