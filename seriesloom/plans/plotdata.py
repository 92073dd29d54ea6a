"""What each plot shows, as rows: aggregated in Spark before anything is drawn."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.special import norm_ppf
from seriesloom.operators import events as ev
from seriesloom.operators.transforms import frame
from seriesloom.sources.frame import along, by, positioned


def series_line(df: DataFrame, rolling_window: int = 7) -> DataFrame:
    """Values with their rolling mean (null until the window is full)."""
    over = frame(rolling_window)
    full = F.when(F.count("value").over(over) == rolling_window, F.avg("value").over(over))
    return df.select("series_id", "ts", "value", full.alias("rolling_mean"))


def seasonal_subseries(df: DataFrame, period: int) -> DataFrame:
    """Each value by phase and cycle, with its phase's mean."""
    rows = positioned(df).withColumn("phase", F.col("pos") % period).withColumn("cycle", F.floor(F.col("pos") / period))
    return rows.select("series_id", "phase", "cycle", "value", F.avg("value").over(Window.partitionBy("series_id", "phase")).alias("phase_mean"))


def lag_pairs(df: DataFrame, lags: tuple[int, ...] = (1, 2, 7)) -> DataFrame:
    """Pairs of a value and the one ``lag`` rows before."""
    pick = df.withColumn("p", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(along()).alias("x")) for k in lags]))
    return pick.select("series_id", "ts", F.col("value").alias("y"), F.explode("p").alias("p")).select("series_id", "ts", "p.lag", "p.x", "y").where("x IS NOT NULL AND y IS NOT NULL")


def calendar_heatmap(df: DataFrame) -> DataFrame:
    """Mean by year, ISO week and day of the week."""
    return df.groupBy("series_id", F.year("ts").alias("year"), F.weekofyear("ts").alias("week"), F.weekday("ts").alias("dow")).agg(F.avg("value").alias("mean"))


def boxplots(df: DataFrame, by_column=None) -> DataFrame:
    """Five-number summary for each month (or another group)."""
    group = F.month("ts") if by_column is None else by_column
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = df.where("value IS NOT NULL").groupBy("series_id", group.alias("box")).agg(F.count("*").alias("n"), q.alias("q"))
    return out.select("series_id", "box", "n", *[F.col("q")[i].alias(k) for i, k in enumerate(("min", "q25", "median", "q75", "max"))])


def density(df: DataFrame, group=None, points: int = 300) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth for each series and group of
    three values or more, on one grid a series between its minimum and maximum. A
    value meets the grid's points, a fixed number, and is added up where it lies."""
    rows = df.where("value IS NOT NULL").select("series_id", "value", (F.lit(0) if group is None else group).alias("box"))
    ends = rows.groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    stats = rows.groupBy("series_id", "box").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("s")).where("n >= 3 AND s > 0")
    stats = stats.withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2))).join(ends, "series_id")
    cells = rows.join(stats, ["series_id", "box"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    bump = F.exp(-0.5 * F.pow((x - F.col("value")) / F.col("h"), F.lit(2.0)))
    sums = cells.groupBy("series_id", "box", "i", "n", "h", "lo", "hi").agg(F.sum(bump).alias("sum"))
    return sums.select("series_id", "box", "i", x.alias("x"), (F.col("sum") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def distribution_curves(df: DataFrame, points: int = 300) -> DataFrame:
    """Beside the histogram: the kernel density and the normal curve of each series'
    mean and deviation, on the same grid."""
    fit = df.where("value IS NOT NULL").groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s")).where("s > 0")
    normal = F.exp(-0.5 * F.pow((F.col("x") - F.col("mean")) / F.col("s"), F.lit(2.0))) / (F.col("s") * math.sqrt(2 * math.pi))
    return density(df, None, points).join(fit, "series_id").select("series_id", "i", "x", "density", normal.alias("normal"))


def histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Counts in equal bins between minimum and maximum."""
    lo, hi = F.min("value").over(by()), F.max("value").over(by())
    rows = df.where("value IS NOT NULL").select("series_id", "value", lo.alias("lo"), hi.alias("hi"))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0)))
    return rows.groupBy("series_id", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n")).select("series_id", "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("left"), "n")


def qq(df: DataFrame) -> DataFrame:
    """Ordered values against normal quantiles (Filliben's positions)."""

    def run(p: pd.Series) -> pd.Series:
        return p.map(norm_ppf)

    r, n = F.row_number().over(by().orderBy("value", "ts")), F.count("value").over(by())
    rows = df.where("value IS NOT NULL").select("series_id", F.col("value").alias("sample"), r.alias("r"), n.alias("n"))
    half = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("r") == F.col("n"), half).when(F.col("r") == 1, 1 - half).otherwise((F.col("r") - 0.3175) / (F.col("n") + 0.365))
    return rows.where("n > 1").select("series_id", "r", "sample", F.pandas_udf(run, "double")(p).alias("theoretical"))


def rolling_stats(df: DataFrame, window: int) -> DataFrame:
    over = frame(window)
    full = F.count("value").over(over) == window
    return df.select("series_id", "ts", "value", F.when(full, F.avg("value").over(over)).alias("rolling_mean"), F.when(full, F.stddev_samp("value").over(over)).alias("rolling_std"))


def acf_heatmap(df: DataFrame, max_lag: int = 40, windows: int = 50) -> DataFrame:
    """ACF inside overlapping windows along each series: of a fifth of its rows
    (``2 * max_lag + 4`` at least, all rows at most), about ``windows`` steps of
    equal length. Missing values are dropped inside a window and the gap closes up;
    a window of too few values or a constant one has no row, like a series of less
    than ``max_lag + 4``. Each row goes to the few windows it is in."""
    rows = positioned(df).withColumn("n", F.count("*").over(by()))
    rows = rows.withColumn("size", F.least("n", F.greatest(F.lit(2 * max_lag + 4), F.floor(F.col("n") / 5)))).where(F.col("size") >= max_lag + 4)
    rows = rows.withColumn("step", F.greatest(F.lit(1), F.floor((F.col("n") - F.col("size")) / windows))).where("value IS NOT NULL")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("size") + 1) / F.col("step"))).cast("long")
    last = F.least(F.floor(F.col("pos") / F.col("step")), F.floor((F.col("n") - F.col("size")) / F.col("step"))).cast("long")
    cut = rows.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    cap = F.least(F.lit(max_lag), F.floor(F.col("size") / 2) - 1).alias("cap")
    over = Window.partitionBy("series_id", "window")
    cut = cut.select("series_id", "window", "pos", cap, (F.col("value") - F.avg("value").over(over)).alias("c"), F.min("value").over(over).alias("lo"), F.max("value").over(over).alias("hi"))
    ordered = over.orderBy("pos")
    products = cut.where("lo < hi").select("series_id", "window", "cap", *[(F.col("c") * (F.lag("c", k).over(ordered) if k else F.col("c"))).alias(f"p{k}") for k in range(max_lag + 1)])
    sums = products.groupBy("series_id", "window", "cap").agg(F.count("*").alias("m"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(max_lag + 1)]).where("m >= cap + 4 AND p0 > 0")
    acf = sums.select("series_id", "window", "cap", F.posexplode(F.array(*[F.col(f"p{k}") / F.col("p0") for k in range(max_lag + 1)])).alias("lag", "acf"))
    return acf.where("lag <= cap").select("series_id", "window", "lag", "acf")


def strength_radar(parts: DataFrame) -> DataFrame:
    """Shares of variance in a decomposition: signal and smoothness."""
    good = parts.where("residual IS NOT NULL AND trend IS NOT NULL")
    v = F.var_pop("observed")
    return good.groupBy("series_id").agg((1 - F.try_divide(F.var_pop("residual"), v)).alias("signal"), F.try_divide(F.var_pop("trend"), v).alias("smoothness"), F.try_divide(F.var_pop("seasonal"), v).alias("seasonal_share"))


def residuals(parts: DataFrame) -> DataFrame:
    """A decomposition's remainders as series, for their histogram and ACF."""
    return parts.select("series_id", "ts", F.col("residual").alias("value")).where("value IS NOT NULL")


def polar(df: DataFrame, period: int) -> DataFrame:
    """Angle of each phase and its mean, scaled to [0, 1] over the phases."""
    means = positioned(df).groupBy("series_id", (F.col("pos") % period).alias("phase")).agg(F.avg("value").alias("mean"))
    lo, hi = F.min("mean").over(by()), F.max("mean").over(by())
    return means.select("series_id", "phase", (F.col("phase") * (2 * math.pi / period)).alias("angle"), "mean", F.try_divide(F.col("mean") - lo, hi - lo).alias("radius"))


def season_heatmap(df: DataFrame, period: int) -> DataFrame:
    rows = positioned(df)
    return rows.groupBy("series_id", F.floor(F.col("pos") / period).alias("cycle"), (F.col("pos") % period).alias("phase")).agg(F.avg("value").alias("mean"))


def agreement(reports: dict[str, DataFrame]) -> DataFrame:
    """Which methods flag each observation, one column a method."""
    out = None
    for name, found in reports.items():
        part = found.select("series_id", "ts", F.col("mask").cast("int").alias(name))
        out = part if out is None else out.join(part, ["series_id", "ts"], "full")
    return out


def segment_means(found: DataFrame) -> DataFrame:
    """Each observation with its segment's mean."""
    rows = ev.segmented(found)
    return rows.select("series_id", "ts", "value", "segment", F.avg("value").over(Window.partitionBy("series_id", "segment")).alias("segment_mean"))


def missing_map(df: DataFrame, chunks: int = 200) -> DataFrame:
    """Whether anything is missing in each of about ``chunks`` stretches."""
    rows = positioned(df).withColumn("n", F.count("*").over(by()))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / chunks))
    return rows.groupBy("series_id", F.floor(F.col("pos") / size).alias("chunk")).agg(F.min("ts").alias("ts"), F.max(F.col("value").isNull().cast("int")).alias("missing"))


def svg_line(points: list[tuple[float, float | None]], width: int = 640, height: int = 160, marks: list[tuple[float, float]] = ()) -> str:
    """A line with marks as inline SVG; breaks where a value is missing."""
    good = [(x, y) for x, y in points if y is not None]
    if not good:
        return "<svg/>"
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*good, strict=True))
    at = lambda x, y: f"{(x - x0) / ((x1 - x0) or 1) * width:.1f},{height - (y - y0) / ((y1 - y0) or 1) * height:.1f}"
    runs, now = [], []
    for x, y in points:
        if y is None:
            runs.append(now)
            now = []
        else:
            now.append(at(x, y))
    lines = "".join(f'<polyline fill="none" stroke="#36c" points="{" ".join(r)}"/>' for r in [*runs, now] if r)
    dots = "".join(f'<circle r="3" fill="#c33" cx="{at(x, y).split(",")[0]}" cy="{at(x, y).split(",")[1]}"/>' for x, y in marks)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}">{lines}{dots}</svg>'
