"""Forecastability scores and feature leakage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.operators.quality import bounds
from seriesloom.operators.stats import autocorrelation, tested
from seriesloom.operators.structure import find_periods
from seriesloom.sources.frame import along, properties, seconds

# Weights of the sub-scores.
WEIGHTS = {"data_quality": 0.20, "stationarity": 0.15, "signal_to_noise": 0.20, "autocorrelation": 0.15, "sample_size": 0.15, "regularity": 0.15}


def _strengths(x: np.ndarray, period: int) -> tuple[float, float]:
    n = len(x)
    spread = lambda y: max(float(np.var(y)), 1e-15)
    if n >= 2 * period:
        trend = kernels.smooth(x, kernels.trend_window(n, 2 * period + 1))
        season = kernels.phase_means(x - trend, period)[np.arange(n) % period]
        rest = np.var(x - trend - season)
        t, s = 1 - rest / spread(x - season), 1 - rest / spread(x - trend)
    else:
        t, s = 1 - np.var(np.diff(x)) / spread(x), 0.0
    return float(np.clip(t, 0, 1)), float(np.clip(s, 0, 1))


def signals(df: DataFrame, period: int | None = None, alpha: float = 0.05) -> DataFrame:
    """``(series_id, adf, kpss, found, strength_trend, strength_seasonal)``: what only
    Python can tell of a series, in one pass: whether the tests call it stationary
    (null where undefined), its period, and the strengths of trend and season for that
    period, or for twelve."""

    def run(pdf):
        x = pdf.sort_values("ts")["value"].dropna().to_numpy(dtype=float)
        adf, kpss = (tested(name, x, "c", alpha).get("is_stationary") for name in ("ADF", "KPSS"))
        found = period or (find_periods(x, alpha=alpha)["period"] if len(x) >= 8 else None)
        trend, season = _strengths(x, found or 12) if len(x) else (None, None)
        row = [[pdf["series_id"].iloc[0], adf, kpss, found, trend, season]]
        out = pd.DataFrame(row, columns=["series_id", "adf", "kpss", "found", "strength_trend", "strength_seasonal"])
        return out.astype({"adf": "boolean", "kpss": "boolean", "found": "Int64", "strength_trend": float, "strength_seasonal": float})

    return df.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, adf boolean, kpss boolean, found long, strength_trend double, strength_seasonal double")


def forecastability(df: DataFrame, period: int | None = None, alpha: float = 0.05) -> DataFrame:
    """One row a series: score from 0 to 100, sub-scores and a kind of model.

    Summaries of one row a series are joined; only tests, spectra and smoothers
    run in Python, in one pass. Series below four rows give no row.
    """
    if period is not None and period < 2:
        raise ValueError(f"period is 2 or more, not {period}")
    base = properties(df).where("n >= 4").select("series_id", "n", (F.col("n") - F.col("n_nan")).alias("n_clean"), "is_regular")
    fence = bounds(df)
    out = df.join(fence, "series_id").groupBy("series_id").agg(F.count_if((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))).alias("n_out"))
    gaps = df.select("series_id", (seconds() - F.lag(seconds()).over(along())).alias("gap")).groupBy("series_id").agg((F.max("gap") > 3 * F.median("gap")).alias("large_gap"))
    found = F.col("found")
    told = signals(df, period, alpha).withColumn("adf", F.coalesce("adf", F.lit(True))).withColumn("kpss", F.coalesce("kpss", F.lit(True)))
    acf = autocorrelation(df, 40, alpha).where((F.col("lag") > 0) & (F.col("lag") <= F.col("n") / 2 - 1) & (F.abs("acf") > F.col("conf_upper"))).groupBy("series_id").agg(F.max(F.abs("acf")).alias("top_acf"))
    all_ = base
    for part in (out, gaps, told, acf):
        all_ = all_.join(part, "series_id", "left")
    all_ = all_.withColumn("period", F.coalesce(found, F.lit(12)))
    cut = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 2)
    pct_nan = 100.0 * (F.col("n") - F.col("n_clean")) / F.col("n")
    pct_out = 100.0 * F.coalesce(F.try_divide("n_out", "n_clean"), F.lit(0.0))
    parts = {
        "data_quality": cut(100 - pct_nan - pct_out),
        "stationarity": F.when(F.col("adf") & F.col("kpss"), 100.0).when(F.col("adf"), 75.0).when(F.col("kpss"), 50.0).otherwise(0.0),
        "signal_to_noise": cut((F.col("strength_trend") + F.col("strength_seasonal")) * 50),
        "autocorrelation": cut(100 * F.coalesce("top_acf", F.lit(0.0))),
        "sample_size": cut(F.col("n_clean") / (2.0 * F.col("period")) * 20),
        "regularity": 50.0 * F.col("is_regular").cast("int") + 50.0 * (~F.coalesce("large_gap", F.lit(False))).cast("int"),
    }
    for k, c in parts.items():
        all_ = all_.withColumn(k, c)
    all_ = all_.withColumn("score", F.round(sum(w * F.col(k) for k, w in WEIGHTS.items()), 2))
    seasonal = found.isNotNull()
    model = F.when(F.col("score") < 25, "ML").when(seasonal & F.col("adf"), "SARIMA").when(seasonal, "ETS").when(F.col("adf"), "ARIMA").when(F.col("n_clean") >= 100, "Prophet").otherwise("ARIMA")
    return all_.select(
        "series_id", "score", *parts, model.alias("recommended_model"), F.when(F.col("adf"), 0).otherwise(1).alias("recommended_diff"), found.alias("recommended_period"), F.col("n").alias("n_obs"),
        F.round(pct_nan, 4).alias("pct_missing"), F.round(pct_out, 4).alias("pct_outlier"), F.col("adf").alias("is_stationary"),
    )


def lagged_correlations(df: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """``(series_id, feature, lag, r)``: correlation of each feature with the value
    ``lag`` rows later. ``df`` has the features as columns beside value. Fewer than
    three pairs or no spread count as 0."""
    lags = range(-horizon, horizon + 1)
    x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    y = [(F.lead("value", k).over(along()) if k >= 0 else F.lag("value", -k).over(along())).alias(f"y{k + horizon}") for k in lags]
    rows = df.select("series_id", *x, *y)

    def r(i: int, j: int):
        both = F.col(f"x{i}").isNotNull() & F.col(f"y{j}").isNotNull()
        a, b = F.when(both, F.col(f"x{i}")), F.when(both, F.col(f"y{j}"))
        good = (F.count(a) >= 3) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
        # Sums stay defined without spread, where corr would divide by zero.
        return F.when(good, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).otherwise(0.0)

    # One column for each feature and lag: rows are added up where they lie.
    sums = rows.groupBy("series_id").agg(*[r(i, j).alias(f"r{i}_{j}") for i in range(len(features)) for j in range(len(lags))])
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"r{i}_{j}").alias("r")) for i, f in enumerate(features) for j, k in enumerate(lags)]
    return sums.select("series_id", F.inline(F.array(*cells)))


def leakage(df: DataFrame, features: list[str], horizon: int, threshold: float = 0.95) -> DataFrame:
    """One row for each series and feature: target and temporal leakage."""
    if horizon < 1 or not 0 < threshold <= 1:
        raise ValueError("horizon is positive and threshold in (0, 1]")
    n = df.groupBy("series_id").agg(F.count("*").alias("n"))
    r = lagged_correlations(df, features, horizon).join(n, "series_id").where(F.abs("lag") <= F.col("n") / 4)
    peak = F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 12), -F.col("lag")))
    out = r.groupBy("series_id", "feature").agg(F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("corr_lag0"), peak.alias("peak"))
    temporal = (F.col("peak.lag") > 0) & (F.abs("peak.r") > F.abs("corr_lag0") + 0.05)
    return out.select("series_id", "feature", "corr_lag0", F.col("peak.lag").alias("peak_lag"), (F.abs("corr_lag0") >= threshold).alias("target_leak"), temporal.alias("temporal_leak"))
