"""Decomposition into trend, seasonal and remainder; seasonality detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.functions.special import norm_ppf
from seriesloom.sources.frame import by, positioned

# The usual period of a frequency.
PERIODS = {"s": 60, "min": 60, "h": 24, "D": 7, "B": 5, "W": 52, "M": 12, "MS": 12, "ME": 12, "Q": 4, "QS": 4, "QE": 4}


def default_period(freq: str | None) -> int | None:
    """The period of a frequency; anchors such as -SUN do not matter."""
    return PERIODS.get((freq or "").split("-")[0])


def classical(df: DataFrame, period: int, model: str = "additive") -> DataFrame:
    """Observed, trend, seasonal and residual by centred averages and phase means.

    Series shorter than two periods give no rows; so do, for the multiplicative
    model, those whose trend is not positive throughout.
    """
    if period < 2 or model not in ("additive", "multiplicative"):
        raise ValueError("period is 2 or more, the model additive or multiplicative")
    rows = positioned(df).withColumn("n", F.count("*").over(by())).where(F.col("n") >= 2 * period)
    ordered, half, v = by().orderBy("pos"), period // 2, F.col("value")

    def whole(a: int, b: int):
        over = ordered.rowsBetween(a, b)
        return F.when(F.count(v).over(over) == b - a + 1, F.avg(v).over(over))

    trend = whole(-half, half) if period % 2 else (whole(-half, half - 1) + whole(1 - half, half)) / 2
    rows = rows.withColumn("trend", trend).withColumn("phase", F.col("pos") % period)
    add = model == "additive"
    if not add:
        rows = rows.withColumn("low", F.min("trend").over(by())).where("low > 0")
    rows = rows.withColumn("rest", v - F.col("trend") if add else F.try_divide(v, "trend"))
    means = rows.groupBy("series_id", "phase").agg(F.avg("rest").alias("mean"))
    centre = F.avg("mean").over(by())
    means = means.select("series_id", "phase", (F.col("mean") - centre if add else F.try_divide("mean", centre)).alias("seasonal"))
    out = rows.join(means, ["series_id", "phase"])
    rest = v - F.col("trend") - F.col("seasonal") if add else F.try_divide(v, F.col("trend") * F.col("seasonal"))
    return out.select("series_id", "ts", "pos", v.alias("observed"), "trend", "seasonal", rest.alias("residual"))


def strengths(parts: DataFrame, model: str = "additive") -> DataFrame:
    """Strength of trend and season: 1 - Var(R) / Var(T + R), Var(S + R); not below 0."""
    t, s, r = (F.col(c) if model == "additive" else F.ln(c) for c in ("trend", "seasonal", "residual"))

    def one(c):
        both = F.when(F.col("residual").isNotNull() & F.col("trend").isNotNull(), c + r)
        return F.round(F.when(F.count(both) >= 2, F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop(F.when(both.isNotNull(), r)), F.var_pop(both))), F.lit(0.0))).otherwise(0.0), 6)

    return parts.groupBy("series_id").agg(F.count("residual").alias("n_obs_used"), one(t).alias("strength_trend"), one(s).alias("strength_seasonal"))


def stl(df: DataFrame, period: int, method: str = "loess", robust: bool = True, seasonal_degree: int = 1, trend_degree: int = 1) -> DataFrame:
    """Trend, seasonal and remainder, one task a series.

    loess: seasonal-trend decomposition by local regression; missing values stand
    for the one before (at the start, after) and are missing in every part. savgol:
    a Savitzky-Golay smoother and centred phase means, twice. Series shorter than
    two periods or without a value give no rows.
    """
    if period < 2 or method not in ("loess", "savgol") or not {seasonal_degree, trend_degree} <= {0, 1}:
        raise ValueError("period is 2 or more, the method loess or savgol, degrees 0 or 1")

    def run(pdf):
        pdf = pdf.sort_values("ts")
        y = pdf["value"].to_numpy(dtype=float)
        gone = np.isnan(y)
        if len(y) < max(3, 2 * period) or gone.all():
            return pdf.iloc[:0].assign(pos=0, observed=0.0, trend=0.0, seasonal=0.0, residual=0.0).drop(columns="value")
        if method == "loess":
            parts = kernels.stl(pd.Series(y).ffill().bfill().to_numpy(), period, robust, seasonal_degree, trend_degree)
            t, s, r = (np.where(gone, np.nan, x) for x in parts)
        else:
            t, s, r = kernels.stl_like(y, period)
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "ts": pdf["ts"].to_numpy(), "pos": np.arange(len(y)), "observed": y, "trend": t, "seasonal": s, "residual": r})

    return df.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, pos long, observed double, trend double, seasonal double, residual double")


def summary(parts: DataFrame, period: int, method: str, model: str = "additive") -> DataFrame:
    """``(series_id, summary)``: a decomposition in words, one text a series."""
    rows = strengths(parts, model)
    lines = [("method", F.lit(method)), ("model", F.lit(model)), ("period", F.lit(period)), ("n_obs_used", F.col("n_obs_used")), ("strength_trend", F.format_string("%.4f", "strength_trend")), ("strength_seasonal", F.format_string("%.4f", "strength_seasonal"))]
    return rows.select("series_id", _described("Decomposition", lines).alias("summary"))


def _described(title: str, lines: list) -> Column:
    """A title and one line a field."""
    return F.concat_ws("\n", F.lit(title), F.lit("-" * 40), *[F.concat(F.lit(f"  {name:<18}: "), F.coalesce(c.cast("string"), F.lit("-"))) for name, c in lines])


def periodogram(df: DataFrame) -> DataFrame:
    """``(series_id, k, period, power)`` of the detrended, Hann-windowed series."""

    def run(pdf):
        x = pdf.sort_values("ts")["value"].dropna().to_numpy(dtype=float)
        if len(x) < 8:
            return pd.DataFrame({"series_id": [], "k": [], "period": [], "power": []})
        p = kernels.power_spectrum(kernels.detrended(x))
        k = np.arange(1, len(p) + 1)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "k": k, "period": len(x) / k, "power": p})

    return df.groupBy("series_id").applyInPandas(run, "series_id string, k long, period double, power double")


def find_periods(x: np.ndarray, method: str = "combined", top_k: int = 5, alpha: float = 0.05, min_period: int = 2, max_period: int | None = None) -> dict:
    """Candidate periods of one clean series with scores, and the verdict."""
    n = len(x)
    most = max(min_period, min(max_period or n // 2, n // 2))
    x = kernels.detrended(x)
    by_power: dict[int, float] = {}
    g, p = 0.0, 1.0
    if method != "acf":
        power = kernels.power_spectrum(x)
        g, p = kernels.fisher_g(power)
        for k in kernels.peaks(power):
            for period in (n // (k + 1), -(-n // (k + 1))):
                if min_period <= period <= most:
                    by_power[int(period)] = max(by_power.get(int(period), 0.0), float(power[k]))
        best = sorted(by_power.items(), key=lambda c: -c[1])[:top_k]
        by_power = {q: w / best[0][1] for q, w in best} if best else {}
    by_acf: dict[int, float] = {}
    if method != "periodogram" and most >= 2:
        rho = kernels.autocorrelation(x, most)[1:]
        at = kernels.peaks(rho)
        at = at[rho[at] >= norm_ppf(1 - alpha / 2) / np.sqrt(n)]
        at = kernels.spaced(at, rho[at], 2)
        best = sorted(((int(k) + 1, float(rho[k])) for k in at), key=lambda c: -c[1])[:top_k]
        by_acf = {q: w / best[0][1] for q, w in best} if best else {}
    scores = by_power if method == "periodogram" else by_acf
    if method == "combined":
        scores = {q: min(1.0, 0.6 * (by_power[q] + by_acf[q])) if q in by_power and q in by_acf and by_power[q] > 0 else 0.9 * max(by_power.get(q, 0.0), by_acf.get(q, 0.0)) for q in sorted({*by_power, *by_acf})}
    ranked = sorted(scores.items(), key=lambda c: -c[1])
    significant = (p < alpha and method != "acf") or bool(by_acf)
    seasonal = bool(ranked) and significant and ranked[0][1] > 0.05
    return {"ranked": ranked, "by_power": by_power, "by_acf": by_acf, "g": g, "p": p, "seasonal": seasonal, "period": ranked[0][0] if seasonal else None}


_FOUND = "n_obs long, dominant_period long, is_seasonal boolean, fisher_g_stat double, fisher_p_value double, candidates array<struct<period:long,score:double>>"


def _searched(df: DataFrame, methods: tuple[str, ...], top_k: int, alpha: float, min_period: int, max_period: int | None) -> DataFrame:
    """What each method finds, one row a series and method, from one pass."""

    def run(pdf):
        x = pdf.sort_values("ts")["value"].dropna().to_numpy(dtype=float)
        rows = []
        for method in methods if len(x) >= 8 else ():
            f = find_periods(x, method, top_k, alpha, min_period, max_period)
            rows.append([pdf["series_id"].iloc[0], method, len(x), f["period"], f["seasonal"], f["g"], f["p"], [{"period": q, "score": s} for q, s in f["ranked"]]])
        out = pd.DataFrame(rows, columns=["series_id", "method", "n_obs", "dominant_period", "is_seasonal", "fisher_g_stat", "fisher_p_value", "candidates"])
        out["dominant_period"] = out["dominant_period"].astype("Int64")
        return out

    return df.groupBy("series_id").applyInPandas(run, f"series_id string, method string, {_FOUND}")


def seasonality(df: DataFrame, method: str = "combined", top_k: int = 5, alpha: float = 0.05, min_period: int = 2, max_period: int | None = None) -> DataFrame:
    """One row a series: candidates with scores, dominant period, Fisher's test.
    Fewer than eight values give no row."""
    if method not in ("periodogram", "acf", "combined") or not 0 < alpha < 1 or min_period < 2:
        raise ValueError("unknown method, alpha outside (0, 1), or min_period below 2")
    return _searched(df, (method,), top_k, alpha, min_period, max_period).drop("method")


def seasonality_summary(found: DataFrame, method: str = "combined", alpha: float = 0.05) -> DataFrame:
    """``(series_id, summary)``: what ``seasonality`` found in words."""
    top = F.concat_ws("; ", F.transform(F.slice("candidates", 1, 5), lambda c: F.format_string("period=%d score=%.4f", c["period"], c["score"])))
    fisher = F.format_string("stat=%.4f p=%.4f", "fisher_g_stat", "fisher_p_value")
    lines = [("method", F.lit(method)), ("n_obs", F.col("n_obs")), ("is_seasonal", F.concat(F.col("is_seasonal").cast("string"), F.lit(f" (alpha={alpha})"))), ("dominant_period", F.col("dominant_period")), ("Fisher G", fisher), ("top candidates", top)]
    return found.select("series_id", _described("Seasonality", lines).alias("summary"))


def test_period(df: DataFrame, period: int, alpha: float = 0.05) -> DataFrame:
    """Whether one period is among each series' candidates, by either method."""
    rows = _searched(df, ("periodogram", "acf", "combined"), 20, alpha, 2, None)
    at = F.filter("candidates", lambda x: x["period"] == period)
    one = lambda m, c: F.max(F.when(F.col("method") == m, c))
    both = rows.groupBy("series_id").agg(one("periodogram", F.size(at) > 0).alias("p"), one("acf", F.size(at) > 0).alias("a"), one("combined", F.get(at["score"], F.lit(0))).alias("s"), one("periodogram", F.col("fisher_p_value")).alias("fisher_p_value"))
    return both.select("series_id", F.lit(period).alias("period"), (F.col("p") | F.col("a")).alias("detected"), F.col("p").alias("periodogram_detected"), F.col("a").alias("acf_detected"), F.coalesce("s", F.lit(0.0)).alias("strength"), "fisher_p_value")
