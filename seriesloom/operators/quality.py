"""Missing values, flat runs and global outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.operators.transforms import steps
from seriesloom.sources.frame import along, by, positioned, seconds


def _past():
    return along().rowsBetween(Window.unboundedPreceding, 0)


def _next():
    return along().rowsBetween(0, Window.unboundedFollowing)



def runs(df: DataFrame, flag: str) -> DataFrame:
    """With ``run``: a number for each stretch of rows where ``flag`` is true, by
    gaps and islands; needs ``pos``."""
    ordered = Window.partitionBy("series_id", flag).orderBy("pos")
    return df.withColumn("run", F.when(F.col(flag), F.col("pos") - F.row_number().over(ordered)))


def missing_report(df: DataFrame) -> DataFrame:
    """One row a series on its missing values and their runs."""
    rows = runs(positioned(df).withColumn("gone", F.col("value").isNull()), "gone")
    base = rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if("gone").alias("n_nan"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("pos")))).alias("nan_positions"), F.max("pos").alias("last")
    )
    lengths = rows.where("gone").groupBy("series_id", "run").agg(F.count("*").alias("size")).groupBy("series_id").agg(F.sort_array(F.collect_list("size")).alias("nan_run_lengths"), F.max("size").alias("longest_nan_run"))
    return base.join(lengths, "series_id", "left").select(
        "series_id",
        "n",
        "n_nan",
        F.round(100.0 * F.col("n_nan") / F.col("n"), 4).alias("pct_nan"),
        F.coalesce("longest_nan_run", F.lit(0)).alias("longest_nan_run"),
        F.coalesce("nan_run_lengths", F.array().cast("array<bigint>")).alias("nan_run_lengths"),
        "nan_positions",
        (F.array_contains("nan_positions", 0) | F.array_contains("nan_positions", F.col("last"))).alias("is_monotone_missing"),
    )


def index_gaps(df: DataFrame, step: str) -> DataFrame:
    """Every time that a step through each series' range has and the series not."""
    return steps(df, step).join(df, ["series_id", "ts"], "left_anti")


def interpolate(df: DataFrame, method: str = "linear", limit: int | None = None, fill_value: float | None = None) -> DataFrame:
    """Missing values filled; with was_filled. limit counts from a run's start.

    linear weighs by time and, without a limit, holds the ends; nearest and
    spline leave the ends; zero and constant know no limit.
    """
    v, t = F.col("value"), seconds()
    if method in ("zero", "constant"):
        if method == "constant" and fill_value is None:
            raise ValueError("constant needs a fill_value")
        out = F.coalesce(v, F.lit(0.0 if method == "zero" else float(fill_value)))
        return df.select("series_id", "ts", out.alias("value"), v.isNull().alias("was_filled"))
    if method == "spline":

        def run(pdf):
            pdf = pdf.sort_values("ts")
            x = pdf["value"].to_numpy(dtype=float)
            y = kernels.cubic_fill(x)
            return pdf.assign(value=y, was_filled=(x != x) & (y == y))

        return df.groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, value double, was_filled boolean")
    seen = F.when(v.isNotNull(), F.struct(t.alias("t"), v.alias("v"), F.row_number().over(along()).alias("i")))
    rows = df.withColumn("seen", seen).withColumn("i", F.row_number().over(along()))
    rows = rows.withColumn("p", F.last("seen", True).over(_past())).withColumn("q", F.first("seen", True).over(_next()))
    age = F.col("i") - F.coalesce("p.i", F.lit(0))
    ahead = F.col("q.i") - F.col("i")
    within = F.lit(True) if limit is None else age <= limit
    if method == "forward":
        out = F.when(within, F.col("p.v"))
    elif method == "backward":
        out = F.when(F.lit(True) if limit is None else ahead <= limit, F.col("q.v"))
    elif method == "nearest":
        closer = F.when(t - F.col("p.t") <= F.col("q.t") - t, F.col("p.v")).otherwise(F.col("q.v"))
        out = F.when(within & F.col("p").isNotNull() & F.col("q").isNotNull(), closer)
    elif method == "linear":
        inner = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * F.try_divide(t - F.col("p.t"), F.col("q.t") - F.col("p.t"))
        ends = F.coalesce("p.v", "q.v") if limit is None else F.col("p.v")
        out = F.when(within, F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), inner).otherwise(ends))
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.select("series_id", "ts", F.coalesce(v, out).alias("value"), (v.isNull() & out.isNotNull()).alias("was_filled"))


def flatlines(df: DataFrame, min_run: int = 3, atol: float = 0.0) -> DataFrame:
    """Runs of at least min_run values within atol of the run's first value."""
    if min_run < 2 or atol < 0:
        raise ValueError("min_run is 2 or more and atol not negative")
    rows = positioned(df)
    if atol == 0:
        new = F.coalesce((F.col("value") != F.lag("value").over(along())) | F.lag("value").over(along()).isNull(), F.lit(True))
        rows = rows.withColumn("run", F.sum(new.cast("int")).over(_past())).where("value IS NOT NULL")
    else:  # each value is held against its run's first, which no window can tell

        def run(pdf):
            pdf = pdf.sort_values("ts")
            x = pdf["value"].to_numpy(dtype=float)
            return pdf.assign(pos=range(len(x)), run=kernels.anchored_runs(x, atol))

        rows = df.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, value double, pos long, run long").where("value IS NOT NULL")
    out = rows.groupBy("series_id", "run").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.min_by("value", "pos").alias("value"), F.count("*").alias("size"))
    return out.where(F.col("size") >= min_run).select("series_id", "start_pos", "end_pos", "value", "size")


def near_zero(df: DataFrame, min_run: int = 3, threshold: float = 1e-8) -> DataFrame:
    """Runs of values no farther than threshold from zero."""
    if threshold < 0:
        raise ValueError("threshold is not negative")
    rows = runs(positioned(df).withColumn("small", F.coalesce(F.abs("value") <= threshold, F.lit(False))), "small").where("small")
    out = rows.groupBy("series_id", "run").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.min_by("value", "pos").alias("value"), F.count("*").alias("size"))
    return out.where(F.col("size") >= min_run).select("series_id", "start_pos", "end_pos", "value", "size")


def remove_runs(df: DataFrame, found: DataFrame, keep_first: bool = True) -> DataFrame:
    """Values inside the found runs to null, all or all but each run's first."""
    gone = found.select("series_id", F.explode(F.sequence(F.col("start_pos") + int(keep_first), F.col("end_pos"))).alias("pos"), F.lit(True).alias("gone"))
    return positioned(df).join(gone, ["series_id", "pos"], "left").select("series_id", "ts", F.when(F.col("gone").isNull(), F.col("value")).alias("value"))


def bounds(df: DataFrame, method: str = "iqr", k: float | None = None) -> DataFrame:
    """Lower and upper bound of each series; null where a method is undefined
    (fewer than four values, no spread)."""
    v = F.col("value")
    enough = F.count("value") >= 4
    if method == "iqr":
        k = 1.5 if k is None else k
        q = df.groupBy("series_id").agg(F.when(enough, F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))).alias("q"))
        lo, hi = F.col("q")[0], F.col("q")[1]
        return q.select("series_id", (lo - k * (hi - lo)).alias("lower_bound"), (hi + k * (hi - lo)).alias("upper_bound"))
    if method == "zscore":
        k = 3.0 if k is None else k
        s = df.groupBy("series_id").agg(F.avg(v).alias("m"), F.when(enough & (F.stddev_samp(v) > 0), F.stddev_samp(v)).alias("s"))
        return s.select("series_id", (F.col("m") - k * F.col("s")).alias("lower_bound"), (F.col("m") + k * F.col("s")).alias("upper_bound"))
    if method == "mad":
        k = 3.5 if k is None else k
        m = df.groupBy("series_id").agg(F.median(v).alias("m"))
        d = df.join(m, "series_id").groupBy("series_id", "m").agg(F.when(enough, F.median(F.abs(v - F.col("m")))).alias("d")).withColumn("d", F.when(F.col("d") > 0, F.col("d")))
        return d.select("series_id", (F.col("m") - k / 0.6745 * F.col("d")).alias("lower_bound"), (F.col("m") + k / 0.6745 * F.col("d")).alias("upper_bound"))
    raise ValueError(f"unknown method {method!r}")


def outliers(df: DataFrame, method: str = "iqr", k: float | None = None, alpha: float = 0.05, max_outliers: int = 10) -> DataFrame:
    """Each observation with its mask, and its series' bounds (none for gesd)."""
    if method == "gesd":

        def run(pdf):
            pdf = pdf.sort_values("ts")
            x = pdf["value"].to_numpy(dtype=float)
            good = x == x
            most = min(max_outliers, len(x) // 2 - 1)
            hit = (good & False) if good.sum() < 4 or most < 1 else good.copy()
            if hit.any():
                hit[:] = False
                hit[good.nonzero()[0][kernels.gesd(x[good], most, alpha)]] = True
            return pdf.assign(mask=hit, lower_bound=None, upper_bound=None)

        return df.groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, value double, mask boolean, lower_bound double, upper_bound double")
    mask = F.coalesce((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")), F.lit(False))
    return df.join(bounds(df, method, k), "series_id").select("series_id", "ts", "value", mask.alias("mask"), "lower_bound", "upper_bound")


def remove_flagged(found: DataFrame) -> DataFrame:
    return found.select("series_id", "ts", F.when(~F.col("mask"), F.col("value")).alias("value"))


def clip(found: DataFrame) -> DataFrame:
    """Values clipped to their bounds; missing ones stay missing."""
    v = F.col("value")
    return found.select("series_id", "ts", F.when(v.isNotNull(), F.greatest("lower_bound", F.least("upper_bound", v))).alias("value"))

