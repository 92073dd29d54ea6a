import math

import numpy as np
import pytest

from seriesloom.functions import kernels
from seriesloom.functions import kernels as k
from seriesloom.functions import special as s


def test_special_functions_at_known_points():
    assert math.isclose(s.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(s.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(s.t_ppf(0.975, 10), 2.2281388519649385, rel_tol=1e-9)
    assert math.isclose(s.f_sf(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(s.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)


def test_detrended_has_no_line_left():
    x = k.detrended(3 + 2 * np.arange(50.0))
    assert np.abs(x).max() < 1e-9


def test_smoother_keeps_parabolas():
    t = np.arange(40.0)
    y = 1 + t - 0.1 * t * t
    assert np.allclose(k.smooth(y, 11), y)


def test_peaks_count_plateaus_once():
    assert k.peaks(np.array([0, 1, 0, 2, 2, 2, 0, 3.0])).tolist() == [1, 4]
    assert k.peaks(np.array([1.0, 2.0])).tolist() == []


def test_pacf_of_an_autoregression_cuts_off():
    rng = np.random.default_rng(1)
    x = np.zeros(4000)
    for i in range(1, 4000):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    p = k.partial_autocorrelation(k.autocorrelation(x, 5))
    assert abs(p[1] - 0.7) < 0.05 and np.abs(p[2:]).max() < 0.06


def test_unit_root_tests_tell_noise_from_a_walk():
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=400), rng.normal(size=400).cumsum()
    assert k.adf(noise)[1] < 0.05 < k.adf(walk)[1]
    assert k.kpss(noise)[1] > 0.05 > k.kpss(walk)[1]
    assert k.phillips_perron(noise)[1] < 0.05 < k.phillips_perron(walk)[1]
    with pytest.raises(ValueError):
        k.adf(noise[:8], maxlag=7)


def test_splits_equal_brute_force():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=60), rng.normal(size=50) + 5, rng.normal(size=40) - 3])
    found, penalty = k.splits(x)
    assert [abs(a - b) <= 2 for a, b in zip(found, [60, 110], strict=True)] == [True, True]
    gains = [((x - x.mean()) ** 2).sum() - ((x[:t] - x[:t].mean()) ** 2).sum() - ((x[t:] - x[t:].mean()) ** 2).sum() for t in range(10, 141)]
    assert int(np.argmax(gains)) + 10 in found and max(gains) > penalty


def test_gesd_finds_planted_spikes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    x[[10, 50]] = 9, -8
    assert set(k.gesd(x, 10).tolist()) == {10, 50}


def test_cusum_signals_a_shift():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=150), rng.normal(size=150) + 5])
    assert k.cusum(x)[2].any()
    assert not k.cusum(np.ones(50))[2].any()


def test_entropies_against_loops():
    x = np.sin(np.arange(60) / 3) + np.random.default_rng(6).normal(size=60) / 20
    tol = 0.2 * x.std(ddof=1)

    def count(m, strict, rows):
        w = [x[i : i + m] for i in range(rows)]
        near = (lambda d: d < tol) if strict else (lambda d: d <= tol)
        return [sum(near(np.abs(a - b).max()) for j, b in enumerate(w) if not strict or i != j) for i, a in enumerate(w)]

    b, a = sum(count(2, True, 58)), sum(count(3, True, 58))
    assert math.isclose(k.sample_entropy(x), -math.log(a / b))
    phi = [np.mean(np.log(np.array(count(m, False, 61 - m)) / (61 - m))) for m in (2, 3)]
    assert math.isclose(k.approximate_entropy(x), abs(phi[0] - phi[1]), rel_tol=1e-9)


def test_spline_fill_is_exact_on_cubics():
    t = np.arange(20.0)
    y = 1 + t - 0.5 * t**2 + 0.02 * t**3
    x = y.copy()
    x[[0, 3, 4, 9, 19]] = np.nan
    out = k.cubic_fill(x)
    assert np.allclose(out[1:19], y[1:19]) and np.isnan(out[[0, 19]]).all()


def test_stl_parts_sum_and_find_the_season():
    t = np.arange(120)
    y = 50 + 0.1 * t + 8 * np.sin(2 * np.pi * t / 12)
    trend, seasonal, rest = k.stl_like(y, 12)
    assert np.allclose(trend + seasonal + rest, y)
    assert abs(seasonal[:12].sum()) < 1e-9 and seasonal.max() > 6


def test_loess_against_weighted_fits_one_by_one():
    rng = np.random.default_rng(5)
    for n, width, degree in ((30, 7, 1), (30, 7, 0), (12, 25, 1), (5, 7, 1), (40, 39, 1)):
        y, extra = rng.normal(size=n), rng.random(n) + 0.1
        for at in (*range(n), -1, n):
            some = min(width, n)
            begin = min(max(at - some // 2, 0), n - some)
            t = np.arange(begin, begin + some)
            reach = max(at - begin, begin + some - 1 - at) + max(0, width - n) // 2
            w = np.where(np.abs(t - at) <= 0.999 * reach, (1 - (np.abs(t - at) / reach) ** 3) ** 3, 0) * extra[t]
            want = np.polyval(np.polyfit(t, y[t], degree, w=np.sqrt(w)), at)
            assert np.isclose(kernels.loess(y, width, degree, np.array([float(at)]), extra)[0], want)


def test_stl_of_an_exact_season_and_line():
    t = np.arange(96)
    season = np.tile(np.array([3.0, -1, 0, 2, -4, 0, 1, -1]), 12)
    for robust in (False, True):
        trend, seasonal, rest = kernels.stl(2 + 0.5 * t + season, 8, robust)
        assert np.abs(rest).max() < 0.05 and np.abs(seasonal - season).max() < 0.1 and np.abs(trend - 2 - 0.5 * t).max() < 0.1


def test_spline_against_a_dense_solve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=60).cumsum()
    x[rng.choice(np.arange(1, 59), 25, replace=False)] = np.nan
    at = np.flatnonzero(x == x)
    n, h = len(at), np.diff(at).astype(float)
    slope = np.diff(x[at]) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    got = kernels.cubic_fill(x)
    for j in np.flatnonzero(x != x):
        k = np.searchsorted(at, j) - 1
        t = j - at[k]
        want = x[at[k]] + t * (slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + t**2 * m[k] / 2 + t**3 * (m[k + 1] - m[k]) / (6 * h[k])
        assert np.isclose(got[j], want)


def test_long_series_take_seconds():
    import time

    x = np.random.default_rng(2).normal(size=100_000).cumsum()
    x[1::3] = np.nan
    begun = time.perf_counter()
    assert not np.isnan(kernels.cubic_fill(x)[:-1]).any()
    assert kernels.anchored_runs(x, 0.5)[-1] > 1000
    assert time.perf_counter() - begun < 10
    four = np.array([0.0, np.nan, 8, np.nan, 64, np.nan, 216])
    assert np.allclose(kernels.cubic_fill(four), np.arange(7.0) ** 3)
