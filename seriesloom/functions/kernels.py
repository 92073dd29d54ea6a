"""NumPy kernels for one series: what no window or aggregate can express."""

from __future__ import annotations

import math

import numpy as np

from seriesloom.functions.special import t_ppf

# Asymptotic critical values of the unit-root tests.
ADF_CRITICAL = {"nc": (-2.5658, -1.9393, -1.6156), "c": (-3.4336, -2.8621, -2.5671), "ct": (-3.9638, -3.4126, -3.1279)}
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def fill_by_position(x: np.ndarray) -> np.ndarray:
    """Linear fill over positions; the ends take the nearest value."""
    gone = np.isnan(x)
    if not gone.any() or gone.all():
        return x
    at = np.arange(len(x))
    return np.where(gone, np.interp(at, at[~gone], x[~gone]), x)


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    slope = (t @ x) / (t @ t) if len(x) > 1 else 0.0
    return x - x.mean() - slope * t


def least_squares(y: np.ndarray, design: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    inverse = np.linalg.pinv(design)
    beta = inverse @ y
    rest = y - design @ beta
    return beta, rest, float(rest @ rest) / max(len(y) - design.shape[1], 1)


def _design(level: np.ndarray, regression: str, lagged: list[np.ndarray]) -> np.ndarray:
    columns = [level]
    if regression != "nc":
        columns.append(np.ones(len(level)))
    if regression == "ct":
        columns.append(np.arange(len(level), dtype=float))
    return np.column_stack(columns + lagged)


def bounded_p(stat: float, points: tuple, levels: tuple) -> float:
    """Interpolated p-value; 0.005 and 0.15 beyond the table's ends."""
    if stat < points[0]:
        return 0.005 if levels[0] < levels[-1] else 0.15
    if stat > points[-1]:
        return 0.15 if levels[0] < levels[-1] else 0.005
    return float(np.interp(stat, points, levels))


def adf(x: np.ndarray, regression: str = "c", maxlag: int | None = None) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller: statistic, p-value, lags chosen by AIC on one sample."""
    most = int(12 * (len(x) / 100) ** 0.25) if maxlag is None else maxlag
    change = np.diff(x)
    rows = len(change) - most - 1
    if rows <= 1:
        raise ValueError("too few observations for the lags")
    y, level = change[most + 1 :], x[most : len(change) - 1]
    lagged = [change[most + 1 - k : len(change) - k] for k in range(1, most + 1)]
    level = level[:rows]
    fits = []
    for lag in range(most + 1):
        design = _design(level, regression, lagged[:lag])
        _, _, s2 = least_squares(y, design)
        fits.append(rows * math.log(s2 + 1e-15) + 2 * design.shape[1])
    lag = int(np.argmin(fits))
    design = _design(level, regression, lagged[:lag])
    beta, _, s2 = least_squares(y, design)
    error = math.sqrt(max(0.0, np.linalg.pinv(design.T @ design)[0, 0] * s2))
    stat = float(beta[0]) / error if error > 0 else float("nan")
    points = ADF_CRITICAL[regression]
    p = 0.005 if stat == points[0] else 0.15 if stat == points[-1] else bounded_p(stat, points, (0.01, 0.05, 0.10))
    return stat, p, lag


def kpss(x: np.ndarray, regression: str = "c") -> tuple[float, float, int]:
    """KPSS: statistic, p-value and Bartlett bandwidth."""
    n = len(x)
    rest = x - x.mean() if regression == "c" else detrended(x)
    width = max(1, int(4 * (n / 100) ** 0.25))
    long_run = rest @ rest / n + sum(2 * (1 - j / (width + 1)) * (rest[j:] @ rest[:-j]) / n for j in range(1, width + 1))
    stat = float((np.cumsum(rest) ** 2).sum() / (n * n * long_run)) if long_run > 0 else float("nan")
    return stat, bounded_p(stat, KPSS_CRITICAL[regression], (0.10, 0.05, 0.025, 0.01)), width


def phillips_perron(x: np.ndarray, regression: str = "c") -> tuple[float, float, int]:
    """Phillips-Perron Z(t) with a Bartlett long-run variance."""
    y = np.diff(x)
    n = len(y)
    design = _design(x[:-1], regression, [])
    beta, rest, s2 = least_squares(y, design)
    width = max(1, int(4 * (n / 100) ** 0.25))
    short = rest @ rest / n
    long_run = short + sum(2 * (1 - j / (width + 1)) * (rest[j:] @ rest[:-j]) / n for j in range(1, width + 1))
    error = math.sqrt(np.linalg.pinv(design.T @ design)[0, 0] * s2)
    stat = math.sqrt(short / long_run) * beta[0] / error - 0.5 * (long_run - short) / math.sqrt(long_run) * n * error / math.sqrt(s2)
    return float(stat), bounded_p(stat, ADF_CRITICAL[regression], (0.01, 0.05, 0.10)), width


def smooth(y: np.ndarray, window: int, degree: int = 2) -> np.ndarray:
    """Savitzky-Golay smoother; the ends take the outer windows' polynomials."""
    half = window // 2
    t = np.arange(-half, half + 1)
    hat = np.vander(t, degree + 1) @ np.linalg.pinv(np.vander(t, degree + 1))
    out = np.convolve(y, hat[half][::-1], mode="same")
    out[:half] = hat[:half] @ y[:window]
    out[len(y) - half :] = hat[half + 1 :] @ y[-window:]
    return out


def trend_window(n: int, wanted: int) -> int:
    return max(3, min(wanted | 1, n if n % 2 else n - 1))


def phase_means(y: np.ndarray, period: int) -> np.ndarray:
    phase = np.arange(len(y)) % period
    good = ~np.isnan(y)
    sums = np.bincount(phase[good], y[good], period)
    return sums / np.maximum(np.bincount(phase[good], minlength=period), 1)


def stl_like(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal, remainder: two passes of smoother and centred phase means."""
    seasonal = np.zeros(len(y))
    for _ in range(2):
        trend = smooth(fill_by_position(y - seasonal), trend_window(len(y), int(1.5 * period)))
        means = phase_means(y - trend, period)
        seasonal = (means - means.mean())[np.arange(len(y)) % period]
    return trend, seasonal, y - trend - seasonal


def loess(y: np.ndarray, width: int, degree: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Local regression on equally spaced points: at each place the ``width`` nearest
    points count with tricube weights (times ``weights``) and a polynomial of degree
    0 or 1 is fitted. Wider than the series: the distances stretch accordingly."""
    n = len(y)
    some = min(width, n)
    begin = np.clip(np.round(at).astype(np.int64) - some // 2, 0, n - some)
    points = begin[:, None] + np.arange(some)
    reach = np.maximum(at - begin, begin + some - 1 - at) + (max(0, width - n) // 2)
    far = np.abs(points - at[:, None])
    w = np.where(far <= 0.999 * reach[:, None], np.where(far <= 0.001 * reach[:, None], 1.0, (1 - (far / np.maximum(reach, 1e-300)[:, None]) ** 3) ** 3), 0.0)
    if weights is not None:
        w = w * weights[points]
    total = w.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        w = w / total[:, None]
        if degree:
            mean = (w * points).sum(axis=1)
            spread = (w * (points - mean[:, None]) ** 2).sum(axis=1)
            tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - mean) / spread, 0.0)
            w = w * (1 + tilt[:, None] * (points - mean[:, None]))
        return np.where(total > 0, (w * y[points]).sum(axis=1), np.nan)


def _moving_mean(y: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], y]))
    return (total[width:] - total[:-width]) / width


def stl(y: np.ndarray, period: int, robust: bool = True, seasonal_degree: int = 1, trend_degree: int = 1, seasonal_width: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by local regression (Cleveland et al., 1990):
    trend, seasonal, remainder of a series without missing values.

    Each inner pass smooths the values of every phase over the cycles, takes the
    slow part out of the result, and smooths what is left without season. Robust:
    two passes, fifteen times, between which large remainders lose weight; else five.
    """
    n, place = len(y), np.arange(len(y), dtype=float)
    trend_width = math.ceil(1.5 * period / (1 - 1.5 / seasonal_width))
    trend_width += 1 - trend_width % 2
    low_width = period + 1 + period % 2
    trend, seasonal, weights = np.zeros(n), np.zeros(n), None
    for turn in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                part = (y - trend)[phase::period]
                own = None if weights is None else weights[phase::period]
                at = np.arange(-1, len(part) + 1, dtype=float)
                fit = loess(part, seasonal_width, seasonal_degree, at, own)
                inner = np.concatenate([[part[0]], part, [part[-1]]])
                cycle[phase::period][: len(at)] = np.where(np.isnan(fit), inner, fit)
            slow = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
            seasonal = cycle[period : period + n] - loess(slow, low_width, 1, place)
            fit = loess(y - seasonal, trend_width, trend_degree, place, weights)
            trend = np.where(np.isnan(fit), y - seasonal, fit)
        if robust:
            rest = np.abs(y - trend - seasonal)
            scale = 6 * float(np.median(rest))
            # Remainders of rounding's size are none: weights by them would be noise.
            share = np.clip(rest / scale, 0, None) if scale > 1e-12 * float(np.abs(y).max()) else np.zeros(n)
            weights = np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - share**2) ** 2, 0.0))
    return trend, seasonal, y - trend - seasonal


def peaks(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts once, at its middle; no ends."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    level = x[begins]
    ends = np.append(begins[1:], len(x)) - 1
    k = np.arange(1, len(begins) - 1)
    k = k[(level[k] > level[k - 1]) & (level[k] > level[k + 1])]
    return (begins[k] + ends[k]) // 2


def power_spectrum(x: np.ndarray) -> np.ndarray:
    """Power of the Hann-windowed series at each frequency but zero."""
    return np.abs(np.fft.rfft(x * np.hanning(len(x))))[1:] ** 2


def fisher_g(power: np.ndarray) -> tuple[float, float]:
    if not len(power) or power.sum() == 0:
        return 0.0, 1.0
    g, m = float(power.max() / power.sum()), len(power)
    return g, float(min(1.0, 1 - (1 - math.exp(-g * m)) ** m))


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    c = x - x.mean()
    total = c @ c
    if total == 0:
        return np.zeros(lags + 1)
    return np.array([1.0] + [float(c[k:] @ c[:-k]) / total for k in range(1, lags + 1)])


def partial_autocorrelation(rho: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(rho)):
        below = 1 - phi @ rho[1:k]
        last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / below if below != 0 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return np.array(out)


def spaced(at: np.ndarray, height: np.ndarray, least: int) -> np.ndarray:
    """Peaks at least ``least`` apart; the higher of two that are closer stays."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            keep[(np.abs(at - at[k]) < least) & (np.arange(len(at)) != k)] = False
    return at[keep]


def gesd(x: np.ndarray, most: int, alpha: float = 0.05) -> np.ndarray:
    """Positions of generalized ESD outliers; ties go to the first position."""
    left, taken, last = np.ones(len(x), bool), [], 0
    n = len(x)
    for i in range(1, most + 1):
        rest = x[left]
        spread = rest.std(ddof=1)
        if not spread > 0:
            break
        far = np.where(left, np.abs(x - rest.mean()), -1)
        at = int(far.argmax())
        df = n - i - 1
        t = t_ppf(1 - alpha / (2 * (n - i + 1)), df)
        if far[at] / spread > (n - i) * t / math.sqrt((df + t * t) * (n - i + 1)):
            last = i
        taken.append(at)
        left[at] = False
    return np.array(taken[:last], np.int64)


def cusum(x: np.ndarray, threshold: float = 5.0, drift: float = 0.5, target: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower sums, reset after each signal; and the signals."""
    mean = x.mean() if target is None else target
    sigma = np.diff(x).std(ddof=1) / math.sqrt(2) or 1.0
    up, down, hit = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
    high = low = 0.0
    for i in range(1, len(x)):
        high = max(0.0, high + x[i] - mean - drift * sigma)
        low = max(0.0, low - x[i] + mean - drift * sigma)
        up[i], down[i] = high, low
        if max(high, low) > threshold * sigma:
            hit[i] = True
            high = low = 0.0
    return up, down, hit


def splits(x: np.ndarray, least: int = 10, penalty: float | None = None) -> tuple[list[int], float]:
    """Binary segmentation by mean shifts, with prefix sums; and the penalty."""
    penalty = len(x) * float(np.diff(x).var()) / 2 if penalty is None else penalty
    total = np.concatenate([[0], np.cumsum(x - x.mean())])
    found, work = [], [(0, len(x))]
    while work:
        a, b = work.pop()
        if b - a < 2 * least:
            continue
        t = np.arange(a + least, b - least + 1)
        gain = (total[t] - total[a]) ** 2 / (t - a) + (total[b] - total[t]) ** 2 / (b - t) - (total[b] - total[a]) ** 2 / (b - a)
        best = int(gain.argmax())
        if gain[best] > penalty:
            found.append(int(t[best]))
            work += [(a, int(t[best])), (int(t[best]), b)]
    return sorted(found), penalty


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    tolerance = r * x.std(ddof=1)

    def phi(size: int) -> float:
        windows = np.lib.stride_tricks.sliding_window_view(x, size)
        near = np.ones((len(windows), len(windows)), bool)
        for k in range(size):
            near &= np.abs(windows[:, None, k] - windows[None, :, k]) <= tolerance
        return float(np.log(near.mean(axis=1)).mean())

    return abs(phi(m) - phi(m + 1))


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    tolerance, rows = r * x.std(ddof=1), len(x) - m

    def matches(size: int) -> int:
        windows = np.lib.stride_tricks.sliding_window_view(x, size)[:rows]
        far = np.zeros((len(windows), len(windows)))
        for k in range(size):
            far = np.maximum(far, np.abs(windows[:, None, k] - windows[None, :, k]))
        return int((far < tolerance).sum()) - int((np.diag(far) < tolerance).sum())

    b, a = matches(m), matches(m + 1)
    return 0.0 if b == 0 else float("nan") if a == 0 else -math.log(a / b)


def anchored_runs(x: np.ndarray, tolerance: float) -> np.ndarray:
    """A run's number for each value: a run goes on while values stay within the
    tolerance of its first; a missing value ends it."""
    out, run, anchor = np.zeros(len(x), np.int64), 0, math.nan
    for i, v in enumerate(x.tolist()):
        if not abs(v - anchor) <= tolerance:
            run += 1
            anchor = v
        out[i] = run
    return out


def _tridiagonal(low: np.ndarray, mid: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Elimination along three diagonals: time and space in proportion to n."""
    n = len(mid)
    low, mid, high, right = low.tolist(), mid.tolist(), high.tolist(), right.tolist()
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        right[i] -= f * right[i - 1]
    out = [0.0] * n
    out[-1] = right[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (right[i] - high[i] * out[i + 1]) / mid[i]
    return np.array(out)


def cubic_fill(x: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline over positions, between observations only."""
    at = np.flatnonzero(~np.isnan(x))
    n = len(at)
    if n < 2 or n == len(x):
        return x
    inside = np.flatnonzero(np.isnan(x) & (np.arange(len(x)) > at[0]) & (np.arange(len(x)) < at[-1]))
    out, y = x.copy(), x[at]
    if n < 4:
        out[inside] = np.polyval(np.polyfit(at - at[0], y, n - 1), inside - at[0])
        return out
    h = np.diff(at).astype(float)
    slope = np.diff(y) / h
    # Inner knots have three unknowns each; not-a-knot says what the end ones are, so
    # the first and last equations take them in.
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    right = 6 * np.diff(slope)
    left, last = h[0] / h[1], h[-1] / h[-2]
    mid[0] += low[0] * (1 + left)
    high[0] -= low[0] * left
    mid[-1] += h[-1] * (1 + last)
    low[-1] -= h[-1] * last
    inner = _tridiagonal(low, mid, high, right)
    m = np.concatenate([[(1 + left) * inner[0] - left * inner[1]], inner, [(1 + last) * inner[-1] - last * inner[-2]]])
    k = np.clip(np.searchsorted(at, inside) - 1, 0, n - 2)
    t = inside - at[k]
    out[inside] = y[k] + t * (slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + t**2 * m[k] / 2 + t**3 * (m[k + 1] - m[k]) / (6 * h[k])
    return out
