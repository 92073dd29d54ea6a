"""Pointwise and window transforms, resampling and rolling windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.sources.frame import along, by, positioned
from seriesloom.sources.frequency import Frequency

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5)), "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
    "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True),
}

# How a time may be written, and the span each way covers.
_SPANS = (
    (r"\d{4}", "{}-01-01", "1 year"),
    (r"\d{4}-\d{2}", "{}-01", "1 month"),
    (r"\d{4}-\d{2}-\d{2}", "{}", "1 day"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}", "{}:00:00", "1 hour"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", "{}:00", "1 minute"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", "{}", "1 second"),
)


def _span(at) -> tuple[str, str | None]:
    """The first instant that a time as text names, and how long it lasts; a time
    with a fraction, or one that is no text, is an instant."""
    text = at if isinstance(at, str) else str(at)
    for form, first, length in _SPANS if isinstance(at, str) else ():
        if re.fullmatch(form, text.strip()):
            return first.format(text.strip()), length
    return text, None


def slice_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Observations from start to end, both included; a year, month, day, hour or
    minute as end is the whole of it."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(_span(start)[0]).cast("timestamp_ntz"))
    if end is not None:
        last, length = _span(end)
        last = F.lit(last).cast("timestamp_ntz")
        df = df.where(F.col("ts") < last + F.expr(f"interval {length}")) if length else df.where(F.col("ts") <= last)
    return df


def at_positions(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions [start, stop) of each series; negative ones count from the end."""
    df = positioned(df).withColumn("n", F.count("*").over(by()))
    where = [F.col("pos") >= (F.lit(start) if start >= 0 else F.col("n") + start), F.col("pos") < (F.lit(stop) if stop >= 0 else F.col("n") + stop)]
    return df.where(where[0] & where[1]).drop("n")


def contains(df: DataFrame, ts: str) -> DataFrame:
    """One row a series: whether it has an observation at ts."""
    return df.groupBy("series_id").agg(F.max(F.col("ts") == F.lit(ts).cast("timestamp_ntz")).alias("found"))


def difference(df: DataFrame, periods: int = 1, method: str = "simple") -> DataFrame:
    """Differences over ``periods`` observations; nulls are dropped. log and
    percent of a series with a value of zero or less are undefined: no rows."""
    v = F.col("value")
    if method == "simple":
        out = v - F.lag(v, periods).over(along())
    elif method in ("log", "percent"):
        df = df.withColumn("low", F.min(v).over(by())).where("low > 0")
        if method == "log":
            out = F.ln(v) - F.lag(F.ln(v), periods).over(along())
        else:  # a missing value stands for the one before it
            df = df.withColumn("value", F.last("value", True).over(along().rowsBetween(Window.unboundedPreceding, 0)))
            out = F.try_divide(v, F.lag(v, periods).over(along())) - 1
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.select("series_id", "ts", out.alias("value")).where("value IS NOT NULL")


def log(df: DataFrame) -> DataFrame:
    """Natural logarithm; a series with a value of zero or less gives no rows."""
    return df.withColumn("low", F.min("value").over(by())).where("low > 0").select("series_id", "ts", F.ln("value").alias("value"))


def standardize(df: DataFrame) -> DataFrame:
    """(v - mean) / sample deviation; null for a constant series."""
    v = F.col("value")
    return df.select("series_id", "ts", F.try_divide(v - F.avg(v).over(by()), F.stddev_samp(v).over(by())).alias("value"))


def normalize(df: DataFrame, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Scaled to [lower, upper]; null for a constant series."""
    if lower >= upper:
        raise ValueError("lower must be below upper")
    v, low = F.col("value"), F.min("value").over(by())
    return df.select("series_id", "ts", (F.try_divide(v - low, F.max(v).over(by()) - low) * (upper - lower) + lower).alias("value"))


def apply(df: DataFrame, function: Callable) -> DataFrame:
    """An array function on each series' values in time order; same length out."""

    def run(pdf):
        pdf = pdf.sort_values("ts")
        out = function(pdf["value"].to_numpy(dtype=float))
        if len(out) != len(pdf):
            raise ValueError(f"the function made {len(out)} values of {len(pdf)}")
        return pdf.assign(value=out)

    return df.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, value double")


def resample(df: DataFrame, freq: str, how: str = "mean") -> DataFrame:
    """One value for each bin of any frequency; empty bins inside the range are 0
    for sum and count and absent for the others. Aggregates before any shuffle;
    bins counted from a series' own first time need that first, one row a series.

    An unknown frequency is a ValueError, an unknown aggregate an AttributeError.
    """
    every = Frequency.of(freq)
    if how not in AGGREGATES:
        raise AttributeError(f"unknown aggregate {how!r}; there are {sorted(AGGREGATES)}")
    keys, first = ["series_id"], None
    if every.floating:
        df = df.join(df.groupBy("series_id").agg(F.min("ts").alias("first")), "series_id")
        keys, first = ["series_id", "first"], F.col("first")
    bins = df.withColumn("k", every.index(F.col("ts"), first))
    if how in ("first", "last"):
        pick = (F.min_by if how == "first" else F.max_by)("value", "ts")
        out = bins.where("value IS NOT NULL").groupBy(*keys, "k").agg(pick.alias("value"))
    else:
        out = bins.groupBy(*keys, "k").agg(AGGREGATES[how](F.col("value")).cast("double").alias("value"))
    if how in ("sum", "count"):
        ends = out.groupBy(*keys).agg(F.min("k").alias("a"), F.max("k").alias("b"))
        out = numbers(ends, "k").join(out.drop("first"), ["series_id", "k"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return out.where("value IS NOT NULL").select("series_id", every.label(F.col("k"), first).alias("ts"), "value")


#: Steps that one row makes at once; a long range takes two rounds.
_BLOCK = 10_000


def numbers(ends: DataFrame, name: str) -> DataFrame:
    """``ends`` with every whole number from a to b, in blocks, so that no row holds
    a series' whole range."""
    blocks = ends.withColumn("from", F.explode(F.sequence("a", "b", F.lit(_BLOCK))))
    return blocks.withColumn(name, F.explode(F.sequence("from", F.least(F.col("b"), F.col("from") + (_BLOCK - 1))))).drop("a", "b", "from")


def steps(df: DataFrame, step: str) -> DataFrame:
    """``(series_id, ts)``: every step from each series' first time to its last."""
    ends = df.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    blocks = ends.select("series_id", "b", F.explode(F.expr(f"sequence(a, b, interval {step} * {_BLOCK})")).alias("from"))
    return blocks.select("series_id", F.explode(F.expr(f"sequence(from, least(b, from + interval {step} * {_BLOCK - 1}), interval {step})")).alias("ts"))


def spine(df: DataFrame, step: str) -> DataFrame:
    """Every step from each series' first time to its last; null where there was
    no observation."""
    return steps(df, step).join(df.select("series_id", "ts", "value"), ["series_id", "ts"], "left")


def frame(window: int, center: bool = False):
    """The rows of a window that ends at, or is centred on, the observation."""
    return along().rowsBetween(-(window // 2), (window - 1) // 2) if center else along().rowsBetween(-(window - 1), 0)


def rolling(df: DataFrame, window: int, how: str = "mean", center: bool = False, min_periods: int | None = None) -> DataFrame:
    """A rolling aggregate; rows with fewer than min_periods values are dropped."""
    if how not in AGGREGATES:
        raise AttributeError(f"unknown aggregate {how!r}; there are {sorted(AGGREGATES)}")
    over = frame(window, center)
    enough = F.count("value").over(over) >= (window if min_periods is None else min_periods)
    out = F.when(enough, AGGREGATES[how](F.col("value")).over(over).cast("double"))
    return df.select("series_id", "ts", out.alias("value")).where("value IS NOT NULL")
