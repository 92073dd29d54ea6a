"""Descriptive statistics, autocorrelation and stationarity tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.functions.special import chi2_sf, norm_ppf
from seriesloom.sources.frame import by, positioned

#: Levels of the reported quantiles.
QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def trimmed_mean(df: DataFrame, trim: float = 0.05, least: int = 0) -> DataFrame:
    """Mean without the floor(trim n) lowest and highest values, ``least`` at least."""
    ranked = df.where("value IS NOT NULL").select("series_id", "value", F.row_number().over(by().orderBy("value")).alias("r"), F.count("*").over(by()).alias("n"))
    k = F.greatest(F.lit(least), F.floor(F.col("n") * trim))
    return ranked.where((F.col("r") > k) & (F.col("r") <= F.col("n") - k)).groupBy("series_id").agg(F.avg("value").alias("trimmed_mean"))


def shape(v: str = "value"):
    """Bias-corrected skewness and excess kurtosis; null without spread."""
    n, spread = F.count(v), F.var_pop(v) > 0
    skew = F.when((n >= 3) & spread, F.skewness(v) * F.sqrt(n * (n - 1.0)) / (n - 2))
    g2 = F.kurtosis(v)
    return skew, F.when((n >= 4) & spread, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6))


def median_deviation(df: DataFrame) -> DataFrame:
    m = df.groupBy("series_id").agg(F.median("value").alias("m"))
    return df.join(m, "series_id").groupBy("series_id").agg(F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"))


def descriptive(df: DataFrame) -> DataFrame:
    """One row of summary statistics for each series."""
    v = F.col("value")
    skew, kurt = shape()
    base = df.groupBy("series_id").agg(
        F.count("*").alias("n_total"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.min_by(v, F.when(v.isNotNull(), F.col("ts"))).alias("first"), F.max_by(v, F.when(v.isNotNull(), F.col("ts"))).alias("last"),
        skew.alias("skewness"), kurt.alias("kurtosis"), F.percentile(v, F.array(*[F.lit(q) for q in QUANTILES])).alias("q"),
        F.count_if(v == 0).alias("n_zeros"), F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"),
    ).where("n_valid > 0")
    out = base.join(trimmed_mean(df), "series_id", "left").join(median_deviation(df), "series_id", "left")
    named = [F.col("q")[i].alias(f"q{round(100 * q):02d}") for i, q in enumerate(QUANTILES)]
    return out.select(
        "series_id", "n_total", "n_valid", (F.col("n_total") - F.col("n_valid")).alias("n_nan"), F.round(100.0 * (F.col("n_total") - F.col("n_valid")) / F.col("n_total"), 4).alias("pct_nan"),
        "mean", "median", "trimmed_mean", "std", "var", "mad", F.try_divide("std", F.abs("mean")).alias("cv"), "min", "max", (F.col("max") - F.col("min")).alias("range"),
        "first", "last", "skewness", "kurtosis", *named, "n_zeros", "n_positive", "n_negative",
    )


def autocorrelation(df: DataFrame, lags: int = 40, alpha: float = 0.05) -> DataFrame:
    """One row for each lag from 0: acf, its band, and the Ljung-Box statistic.

    Missing values are dropped and the gaps close up. A constant series has 0 at
    every lag. All lags are sums over one window pass.
    """
    rows = positioned(df.where("value IS NOT NULL")).withColumn("c", F.col("value") - F.avg("value").over(by()))
    ordered = by().orderBy("pos")
    products = rows.select("series_id", *[(F.col("c") * (F.lag("c", k).over(ordered) if k else F.col("c"))).alias(f"p{k}") for k in range(lags + 1)])
    sums = products.groupBy("series_id").agg(F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(lags + 1)]).where("n >= 4")
    acf = sums.select("series_id", "n", F.posexplode(F.array(*[F.when(F.col("p0") > 0, F.coalesce(F.col(f"p{k}") / F.col("p0"), F.lit(0.0))).otherwise(0.0) for k in range(lags + 1)])).alias("lag", "acf"))
    acf = acf.where(F.col("lag") <= F.col("n") / 2)
    term = F.when(F.col("lag") > 0, F.pow("acf", F.lit(2.0)) / (F.col("n") - F.col("lag"))).otherwise(0.0)
    q = F.col("n") * (F.col("n") + 2.0) * F.sum(term).over(by().orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    band = F.when(F.col("lag") == 0, 1.0).otherwise(norm_ppf(1 - alpha / 2) / F.sqrt("n"))
    return acf.select("series_id", "n", "lag", "acf", (-band).alias("conf_lower"), band.alias("conf_upper"), q.alias("lb_statistic"))


def _chi2_sf(x: str, df: str) -> Column:
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(a, b) if b > 0 else 1.0 for a, b in zip(x, df, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(x, df)


def _pacf(rho: Column) -> Column:
    def run(rho: pd.Series) -> pd.Series:
        return rho.map(lambda r: kernels.partial_autocorrelation(np.asarray(r, float)).tolist())

    return F.pandas_udf(run, "array<double>")(rho)


def correlogram(df: DataFrame, lags: int = 40, alpha: float = 0.05) -> DataFrame:
    """``autocorrelation`` with pacf and Ljung-Box p-values; only short arrays of
    one value a lag go through Python."""
    acf = autocorrelation(df, lags, alpha).withColumn("lb_pvalue", _chi2_sf("lb_statistic", "lag"))
    arrays = acf.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("a")).select("series_id", F.posexplode(_pacf(F.col("a.acf"))).alias("lag", "pacf"))
    return acf.join(arrays, ["series_id", "lag"])


def white_noise(df: DataFrame, lags: int = 40, alpha: float = 0.05) -> DataFrame:
    """Whether each series looks like white noise, by Ljung-Box at lag 20 or the last."""
    acf = autocorrelation(df, lags, alpha)
    at = acf.where(F.col("lag") <= 20).groupBy("series_id").agg(F.max("n").alias("n_obs"), F.max("lag").alias("lag"), F.max_by("lb_statistic", "lag").alias("q"))
    return at.select("series_id", "n_obs", "lag", "q", (_chi2_sf("q", "lag") > alpha).alias("is_white_noise"))


def significant_lags(acf: DataFrame, which: str = "acf") -> DataFrame:
    return acf.where((F.col("lag") > 0) & (F.abs(which) > F.col("conf_upper")))


def kpss_statistic(df: DataFrame) -> DataFrame:
    """KPSS about a level, by cumulative sums and lag products in window passes."""
    rows = positioned(df.where("value IS NOT NULL"))
    ordered = by().orderBy("pos")
    rows = rows.withColumn("n", F.count("*").over(by())).withColumn("e", F.col("value") - F.avg("value").over(by()))
    rows = rows.withColumn("s", F.sum("e").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    longest = rows.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    most = max(1, int(4 * (longest / 100) ** 0.25) + 1)  # no series has a wider band
    width = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int"))
    sums = rows.withColumn("w", width).select("series_id", "n", "w", F.pow("s", F.lit(2.0)).alias("ss"), F.pow("e", F.lit(2.0)).alias("ee"), *[(F.col("e") * F.lag("e", j).over(ordered)).alias(f"e{j}") for j in range(1, most + 1)])
    lrv = F.sum("ee") + sum(F.when(F.first("w") >= j, 2 * (1 - j / (F.first("w") + 1.0)) * F.coalesce(F.sum(f"e{j}"), F.lit(0.0))).otherwise(0.0) for j in range(1, most + 1))
    return sums.groupBy("series_id").agg(F.first("n").alias("n_obs"), F.first("w").alias("n_lags"), F.try_divide(F.sum("ss"), F.first("n") * lrv).alias("statistic")).where("n_obs >= 10")


def _summary(name: str, stat: float, p: float, lags: int, regression: str, alpha: float) -> dict:
    table = kernels.KPSS_CRITICAL if name == "KPSS" else kernels.ADF_CRITICAL
    levels = ("10%", "5%", "2.5%", "1%") if name == "KPSS" else ("1%", "5%", "10%")
    stationary = p > alpha if name == "KPSS" else p < alpha
    return {"test_name": name, "statistic": stat, "p_value": p, "critical_values": dict(zip(levels, table[regression], strict=True)), "n_lags": lags, "regression": regression, "is_stationary": stationary}


_TESTS = {"ADF": kernels.adf, "KPSS": kernels.kpss, "PP": kernels.phillips_perron}


def tested(name: str, x: np.ndarray, regression: str = "c", alpha: float = 0.05) -> dict:
    """One test of one series without missing values; empty where it is undefined."""
    try:
        if len(x) < 10:
            return {}
        stat, p, lags = _TESTS[name](x, regression)
    except (ValueError, ZeroDivisionError, FloatingPointError):
        return {}
    return {} if math.isnan(stat) else _summary(name, stat, p, lags, regression, alpha)


def stationarity(df: DataFrame, tests: tuple[str, ...] = ("ADF", "KPSS", "PP"), regression: str = "c", alpha: float = 0.05) -> DataFrame:
    """One row for each series and test. Fewer than ten values, or a test that is
    undefined, give a row with null statistics and is_stationary null."""

    def run(pdf):
        x = pdf.sort_values("ts")["value"].dropna().to_numpy(dtype=float)
        rows = [{"test_name": name, "regression": regression} | tested(name, x, regression, alpha) for name in tests]
        columns = ["test_name", "statistic", "p_value", "critical_values", "n_lags", "regression", "is_stationary"]
        # Objects, so that what a test leaves undefined is None in every column.
        out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})
        out = out.astype({"statistic": float, "p_value": float, "n_lags": "Int64", "is_stationary": "boolean"})
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        return out

    schema = "series_id string, test_name string, statistic double, p_value double, critical_values map<string,double>, n_lags long, regression string, is_stationary boolean"
    return df.groupBy("series_id").applyInPandas(run, schema)


def verdict(df: DataFrame, regression: str = "c", alpha: float = 0.05) -> DataFrame:
    """What ADF and KPSS say together."""
    flags = stationarity(df, ("ADF", "KPSS"), regression, alpha).groupBy("series_id").agg(
        F.max(F.when(F.col("test_name") == "ADF", F.col("is_stationary"))).alias("adf"), F.max(F.when(F.col("test_name") == "KPSS", F.col("is_stationary"))).alias("kpss")
    )
    text = F.when(F.col("adf") & F.col("kpss"), "stationary").when(~F.col("adf") & ~F.col("kpss"), "unit root").when(F.col("adf") & ~F.col("kpss"), "difference stationary").when(~F.col("adf") & F.col("kpss"), "trend stationary")
    return flags.select("series_id", "adf", "kpss", text.alias("verdict"))
