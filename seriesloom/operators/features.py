"""Calendar, statistical and spectral features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.operators.stats import median_deviation, shape, trimmed_mean
from seriesloom.sources.frame import along, by, positioned, seconds


def temporal(df: DataFrame, cyclic: bool = True, time_index: bool = True) -> DataFrame:
    """Calendar features of each time, their cycles, and the time since the start."""
    t = F.col("ts")
    out = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "hour": F.hour(t), "quarter": F.quarter(t), "weekofyear": F.weekofyear(t),
        "is_weekend": (F.weekday(t) >= 5).cast("double"), "is_month_start": (F.dayofmonth(t) == 1).cast("double"), "is_month_end": (F.to_date(t) == F.last_day(t)).cast("double"),
    }
    if cyclic:
        for name, value, period in (("month", F.month(t) - 1, 12), ("dow", F.weekday(t), 7), ("hour", F.hour(t), 24)):
            angle = value * (2 * math.pi) / period
            out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    if time_index:
        days = (seconds() - F.min(seconds()).over(by())) / 86400
        span = (F.max(seconds()).over(by()) - F.min(seconds()).over(by())) / 86400
        out |= {"days_since_start": days, "time_norm": F.when(span > 0, days / span).otherwise(0.0)}
    return df.select("series_id", "ts", *[c.alias(k) for k, c in out.items()])


def statistical(df: DataFrame) -> DataFrame:
    """One row a series: distribution, complexity, linear structure; not entropies.
    Fewer than four values give no row."""
    rows = positioned(df.where("value IS NOT NULL"))
    v = F.col("value")
    d, e = v - F.lag(v).over(along()), F.lead(v).over(along()) - v
    c = v - F.avg(v).over(by())
    rows = rows.select("series_id", "pos", "value", d.alias("d"), e.alias("e"), c.alias("c"), F.count(v).over(by()).alias("n")).withColumn("c1", F.lag("c").over(by().orderBy("pos")))
    skew, kurt = shape()
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    n, spread = F.first("n"), F.var_pop(v) > 0
    base = rows.groupBy("series_id").agg(
        n.alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"), F.coalesce(skew, F.lit(0.0)).alias("skewness"), F.coalesce(kurt, F.lit(0.0)).alias("kurtosis"),
        F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"),
        (F.count_if(F.signum("d") != F.signum("e")) / F.greatest(n - 2, F.lit(1))).alias("turning_points_ratio"),
        (F.count_if(F.col("c") * F.col("c1") < 0) / F.greatest(n - 1, F.lit(1))).alias("mean_crossing_rate"),
        (F.count_if(F.col("d") == 0) / F.greatest(n - 1, F.lit(1))).alias("flatness_ratio"),
        F.coalesce(F.try_divide(F.sum(F.col("c") * F.col("c1")), F.sum(F.col("c") * F.col("c"))), F.lit(0.0)).alias("lag1_acf"),
        F.when(spread, F.regr_slope(v, F.col("pos"))).otherwise(0.0).alias("linear_slope"), F.when(spread, F.regr_r2(v, F.col("pos"))).otherwise(0.0).alias("linear_r2"),
        F.count_if((F.col("d") > 0) & (F.col("e") < 0)).cast("double").alias("n_peaks"), F.count_if((F.col("d") < 0) & (F.col("e") > 0)).cast("double").alias("n_troughs"),
    ).where("n >= 4")
    out = base.join(trimmed_mean(df, least=1), "series_id", "left").join(median_deviation(df), "series_id", "left")
    at = lambda i: F.col("q")[i]
    return out.select(
        "series_id", "mean", "std", "var", "skewness", "kurtosis", "min", "max", (F.col("max") - F.col("min")).alias("range"), at(2).alias("median"), (at(3) - at(1)).alias("iqr"), "mad",
        F.try_divide("std", F.abs("mean")).alias("cv"), "trimmed_mean", at(0).alias("q05"), at(1).alias("q25"), at(3).alias("q75"), at(4).alias("q95"),
        "turning_points_ratio", "mean_crossing_rate", "flatness_ratio", "lag1_acf", "linear_slope", "linear_r2", "n_peaks", "n_troughs",
    )


def entropies(df: DataFrame, approx_limit: int = 2000, sample_limit: int = 500) -> DataFrame:
    """Approximate and sample entropy; null for series beyond the limits, as
    both take time by the square."""

    def run(pdf):
        x = pdf.sort_values("ts")["value"].dropna().to_numpy(dtype=float)
        n = len(x)
        flat = n < 4 or x.std(ddof=1) == 0
        a = None if flat or n > approx_limit else kernels.approximate_entropy(x)
        s = None if flat or n > sample_limit else kernels.sample_entropy(x)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "approx_entropy": [a], "sample_entropy": [s]}).astype({"approx_entropy": float, "sample_entropy": float})

    return df.groupBy("series_id").applyInPandas(run, "series_id string, approx_entropy double, sample_entropy double")


def spectral(df: DataFrame, n_bands: int = 3) -> DataFrame:
    """One row a series of spectral features; fewer than eight values give none."""
    if n_bands < 1:
        raise ValueError("n_bands is 1 or more")
    names = ["total_power", *[f"band_power_{i}" for i in range(n_bands)], "spectral_centroid", "spectral_bandwidth", "spectral_rolloff_50", "spectral_rolloff_85", "spectral_entropy", "spectral_flatness", "dominant_freq", "dominant_period", "n_spectral_peaks"]

    def run(pdf):
        raw = pdf.sort_values("ts")["value"].to_numpy(dtype=float)
        if (raw == raw).sum() < 8:
            return pd.DataFrame(columns=["series_id", *names])
        p = kernels.power_spectrum(kernels.detrended(kernels.fill_by_position(raw)))
        f = np.arange(1, len(p) + 1) / len(raw)
        total = float(p.sum()) or 1e-12
        share, run_sum = np.where(p > 0, p / total, 1e-12), np.cumsum(p)
        centre = float(f @ p / total)
        edges = np.linspace(0, len(p), n_bands + 1, dtype=int)
        top = int(p.argmax())
        roll = [float(f[min(len(f) - 1, np.searchsorted(run_sum, level * total))]) for level in (0.5, 0.85)]
        values = [total, *[float(p[a:b].sum()) for a, b in zip(edges, edges[1:], strict=False)], centre, math.sqrt(((f - centre) ** 2) @ p / total), *roll]
        values += [float(-(share * np.log(share)).sum() / np.log(len(p))), float(np.exp(np.log(p + 1e-12).mean()) / p.mean()) if p.mean() > 0 else 0.0, float(f[top]), float(1 / f[top]), float(len(kernels.peaks(p)))]
        return pd.DataFrame([[pdf["series_id"].iloc[0], *values]], columns=["series_id", *names])

    return df.groupBy("series_id").applyInPandas(run, "series_id string, " + ", ".join(f"{n} double" for n in names))
