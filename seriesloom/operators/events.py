"""Contextual anomalies and changepoints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.functions.special import f_sf
from seriesloom.operators.structure import stl
from seriesloom.operators.transforms import frame
from seriesloom.sources.frame import along, by, positioned

_EPS = 1e-10


def _report(df: DataFrame, excess: Column, scale: Column) -> DataFrame:
    """Rows with mask and a score in [0, 1] from how far beyond the fence they lie."""
    mask = F.coalesce(excess > 0, F.lit(False))
    return df.select("series_id", "ts", "pos", "value", mask.alias("mask"), F.when(mask, F.least(F.lit(1.0), excess / scale)).otherwise(0.0).alias("score"))


def rolling_iqr(df: DataFrame, window: int = 30, k: float = 2.5, center: bool = True, min_periods: int | None = None) -> DataFrame:
    """Beyond k interquartile ranges from the quartiles of the window around."""
    over, v = frame(window, center), F.col("value")
    enough = F.count(v).over(over) >= (window // 2 if min_periods is None else min_periods)
    q = F.when(enough, F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).over(over))
    rows = positioned(df).withColumn("q", q)
    lo, hi = F.col("q")[0], F.col("q")[1]
    low, high = lo - k * (hi - lo), hi + k * (hi - lo)
    return _report(rows, F.greatest(low - v, v - high), high - low + _EPS)


def rolling_z(df: DataFrame, window: int = 30, threshold: float = 3.0, center: bool = True, min_periods: int | None = None) -> DataFrame:
    """More than threshold deviations of the window around; none without spread."""
    over, v = frame(window, center), F.col("value")
    enough = F.count(v).over(over) >= (window // 2 if min_periods is None else min_periods)
    rows = positioned(df).withColumn("z", F.when(enough, F.abs(F.try_divide(v - F.avg(v).over(over), F.stddev_samp(v).over(over)))))
    return _report(rows, F.col("z") - threshold, F.lit(threshold))


def stl_residual(df: DataFrame, period: int, method: str = "iqr", k: float = 3.0, by_method: str = "loess", robust: bool = True) -> DataFrame:
    """Outlying remainders of the decomposition, by fence, MAD or deviation."""
    parts = stl(df, period, by_method, robust)
    r = F.when(~F.isnan("residual"), F.col("residual"))
    rows = parts.select("series_id", "ts", "pos", F.when(~F.isnan("observed"), F.col("observed")).alias("value"), r.alias("r"))
    if method == "iqr":
        q = rows.groupBy("series_id").agg(F.percentile("r", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        lo, hi = F.col("q")[0], F.col("q")[1]
        return _report(rows.join(q, "series_id"), F.greatest(lo - k * (hi - lo) - F.col("r"), F.col("r") - hi - k * (hi - lo)), hi - lo + _EPS)
    if method == "mad":
        m = rows.groupBy("series_id").agg(F.median("r").alias("m"))
        d = rows.join(m, "series_id").groupBy("series_id", "m").agg(F.greatest(F.median(F.abs(F.col("r") - F.col("m"))), F.lit(_EPS)).alias("d"))
        return _report(rows.join(d, "series_id"), 0.6745 * F.abs(F.col("r") - F.col("m")) / F.col("d") - k, F.lit(k + _EPS))
    if method == "z":
        s = rows.groupBy("series_id").agg(F.avg("r").alias("m"), F.greatest(F.stddev_samp("r"), F.lit(_EPS)).alias("s"))
        return _report(rows.join(s, "series_id"), F.abs(F.col("r") - F.col("m")) / F.col("s") - k, F.lit(k + _EPS))
    raise ValueError(f"unknown method {method!r}")


def gesd(df: DataFrame, alpha: float = 0.05, max_outliers: int = 10) -> DataFrame:
    """Generalized ESD outliers, scored by |z| against the series' largest."""
    from seriesloom.operators.quality import outliers

    rows = positioned(outliers(df, "gesd", alpha=alpha, max_outliers=max_outliers).select("series_id", "ts", "value", "mask"))
    z = F.abs(F.try_divide(F.col("value") - F.avg("value").over(by()), F.stddev_samp("value").over(by())))
    rows = rows.withColumn("z", z)
    return rows.select("series_id", "ts", "pos", "value", "mask", F.when(F.col("mask"), F.try_divide("z", F.max("z").over(by()))).otherwise(0.0).alias("score"))


def remove(found: DataFrame) -> DataFrame:
    return found.select("series_id", "ts", F.when(~F.col("mask"), F.col("value")).alias("value"))


def label(found: DataFrame) -> DataFrame:
    """0/1 label series, named after their series."""
    return found.select(F.concat("series_id", F.lit("_anomaly_label")).alias("series_id"), "ts", F.col("mask").cast("double").alias("value"))


def _filled(pdf) -> np.ndarray:
    return kernels.fill_by_position(pdf["value"].to_numpy(dtype=float))


def _per_series(df: DataFrame, function, least: int = 10) -> DataFrame:
    """Rows (pos, score, is_cp) from a kernel on each series' filled values."""

    def run(pdf):
        pdf = pdf.sort_values("ts")
        x = _filled(pdf)
        n = len(x)
        score, hit = function(x) if pdf["value"].notna().sum() >= least else (np.zeros(n), np.zeros(n, bool))
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "ts": pdf["ts"].to_numpy(), "pos": np.arange(n), "value": pdf["value"].to_numpy(), "score": score, "is_cp": hit})

    return df.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, pos long, value double, score double, is_cp boolean")


def cusum(df: DataFrame, threshold: float = 5.0, drift: float = 0.5, target: float | None = None) -> DataFrame:
    """Two-sided cumulative sums that start again after each signal."""
    if threshold <= 0 or drift < 0:
        raise ValueError("threshold is positive, drift not negative")

    def kernel(x):
        up, down, hit = kernels.cusum(x, threshold, drift, target)
        top = np.maximum(up, down)
        return top / (top.max() or 1.0), hit

    return _per_series(df, kernel)


def cusum_without_reset(df: DataFrame, drift: float = 0.5) -> DataFrame:
    """Both sums without reset: a cumulative sum less its running minimum."""
    past = along().rowsBetween(Window.unboundedPreceding, 0)
    rows = positioned(df.where("value IS NOT NULL"))
    rows = rows.withColumn("d", F.col("value") - F.lag("value").over(along()))
    rows = rows.withColumn("sigma", F.stddev_samp("d").over(by()) / F.sqrt(F.lit(2.0))).withColumn("c", F.col("value") - F.avg("value").over(by()))
    first = F.col("pos") == 0
    rows = rows.withColumn("u", F.sum(F.when(first, 0.0).otherwise(F.col("c") - drift * F.col("sigma"))).over(past)).withColumn("w", F.sum(F.when(first, 0.0).otherwise(-F.col("c") - drift * F.col("sigma"))).over(past))
    low = lambda c: F.least(F.lit(0.0), F.min(c).over(past))
    return rows.select("series_id", "ts", "pos", "value", (F.col("u") - low("u")).alias("s_up"), (F.col("w") - low("w")).alias("s_down"))


def split_gains(df: DataFrame, min_size: int = 10) -> DataFrame:
    """For each allowed position, the gain of cutting the whole series there, over
    its total squares; by prefix sums in one window pass."""
    past = along().rowsBetween(Window.unboundedPreceding, -1)
    rows = positioned(df.where("value IS NOT NULL")).withColumn("n", F.count("*").over(by())).withColumn("c", F.col("value") - F.avg("value").over(by()))
    rows = rows.withColumn("left", F.sum("c").over(past)).withColumn("total", F.sum(F.col("c") * F.col("c")).over(by()))
    rows = rows.where((F.col("pos") >= min_size) & (F.col("pos") <= F.col("n") - min_size))
    gain = F.col("left") * F.col("left") / F.col("pos") + F.col("left") * F.col("left") / (F.col("n") - F.col("pos"))
    return rows.select("series_id", "ts", "pos", gain.alias("gain"), F.try_divide(gain, "total").alias("score"))


def binary_segmentation(df: DataFrame, min_size: int = 10, penalty: float | None = None) -> DataFrame:
    """Mean shifts by recursive splits; each scored by the whole series' gain there."""

    def kernel(x):
        found, _ = kernels.splits(x, min_size, penalty)
        hit = np.zeros(len(x), bool)
        hit[found] = True
        left = np.concatenate([[0], np.cumsum(x - x.mean())])[:-1]
        t, total = np.arange(len(x)), ((x - x.mean()) ** 2).sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left**2 / t + left**2 / (len(x) - t)
        return np.where(hit, np.nan_to_num(gain / total if total else gain * 0), 0.0), hit

    return _per_series(df, kernel)


def variance_ratio_statistic(df: DataFrame, window: int = 30) -> DataFrame:
    """F ratio of the variances of the windows before and from each position."""
    if window < 3:
        raise ValueError("window is 3 or more")
    rows = positioned(df).withColumn("n", F.count("*").over(by()))
    a = F.greatest(F.var_samp("value").over(along().rowsBetween(-window, -1)), F.lit(1e-12))
    b = F.greatest(F.var_samp("value").over(along().rowsBetween(0, window - 1)), F.lit(1e-12))
    rows = rows.withColumn("a", a).withColumn("b", b)
    inside = (F.col("pos") >= window) & (F.col("pos") < F.col("n") - window)
    return rows.select("series_id", "ts", "pos", "value", F.when(inside, F.greatest("a", "b") / F.least("a", "b")).alias("f_ratio"))


def variance_ratio(df: DataFrame, window: int = 30, alpha: float = 0.05) -> DataFrame:
    """Variance shifts: each significant stretch keeps its first maximum."""

    @F.pandas_udf("double")
    def p_value(f: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * f_sf(x, window - 1, window - 1)) if x == x else 1.0 for x in f])

    rows = variance_ratio_statistic(df, window).withColumn("score", 1 - p_value(F.coalesce("f_ratio", F.lit(1.0)))).withColumn("hit", F.col("score") > 1 - alpha)
    ordered = Window.partitionBy("series_id", "hit").orderBy("pos")
    rows = rows.withColumn("run", F.when(F.col("hit"), F.col("pos") - F.row_number().over(ordered)))
    best = F.row_number().over(Window.partitionBy("series_id", "run").orderBy(F.desc("score"), "pos")) == 1
    return rows.select("series_id", "ts", "pos", "value", "score", (F.col("hit") & best).alias("is_cp"))


def segmented(found: DataFrame) -> DataFrame:
    """With the number of the segment each row is in."""
    return found.withColumn("segment", F.sum((F.col("is_cp") & (F.col("pos") > 0)).cast("int")).over(by().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def segments(found: DataFrame) -> DataFrame:
    """One row a segment; n_obs counts missing rows, the statistics do not."""
    v = F.col("value")
    return segmented(found).groupBy("series_id", "segment").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_obs"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
