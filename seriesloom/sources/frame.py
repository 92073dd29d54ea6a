"""The canonical frame ``(series_id, ts, value)``: building, checking, describing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def by() -> WindowSpec:
    """All rows of a series."""
    return Window.partitionBy("series_id")


def along() -> WindowSpec:
    """A series in time order."""
    return by().orderBy("ts")


# Seconds of the known frequencies, and their labels.
GAP_SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400, "W": 604800, "MS": 2592000, "QS": 7862400, "YS": 31536000}
LABELS = {
    "s": "Secondly", "T": "Minutely", "min": "Minutely", "H": "Hourly", "h": "Hourly", "D": "Daily", "B": "Business daily", "W": "Weekly",
    "M": "Monthly (end)", "MS": "Monthly (start)", "ME": "Monthly (end)", "Q": "Quarterly (end)", "QS": "Quarterly (start)", "QE": "Quarterly (end)",
    "A": "Annual (end)", "AS": "Annual (start)", "Y": "Annual (end)", "YS": "Annual (start)", "YE": "Annual (end)",
}


def from_table(df: DataFrame, time_col: str, value_col: str, key_cols: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Any table as series: keys joined to series_id, NaN to null."""
    missing = [c for c in (time_col, value_col, *key_cols) if c not in df.columns]
    if missing:
        raise KeyError(f"no column {missing[0]!r}; there are {df.columns}")
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols]) if key_cols else F.lit(name)
    value = F.col(value_col).cast("double")
    return df.select(key.alias("series_id"), F.col(time_col).cast("timestamp_ntz").alias("ts"), F.when(~F.isnan(value), value).alias("value"))


def from_arrays(spark: SparkSession, values: Iterable[float], index: Iterable, name: str = "value", freq: str | None = None, unit: str | None = None) -> DataFrame:
    """Values and their times as one series. A frequency, if given, must be one that
    is known; it and the unit stay with the times (``declared``)."""
    values, index = list(values), list(index)
    if len(values) != len(index):
        raise ValueError(f"{len(values)} values and {len(index)} times")
    if not values:
        raise ValueError("a series needs an observation")
    rows = [(name, t, None if v is None or v != v else float(v)) for t, v in zip(index, values, strict=True)]
    return declare(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double"), freq, unit)


def from_pandas(spark: SparkSession, series, name: str | None = None, index=None, freq: str | None = None, unit: str | None = None) -> DataFrame:
    """A pandas Series with a time index; ``index``, if given, stands for its own."""
    at = series.index if index is None else index
    return from_arrays(spark, series.tolist(), [t.to_pydatetime() if hasattr(t, "to_pydatetime") else t for t in at], name or series.name or "value", freq, unit)


def declare(df: DataFrame, freq: str | None = None, unit: str | None = None) -> DataFrame:
    """``df`` whose times carry a frequency and a unit as metadata."""
    if freq is not None:
        validate_freq(freq)
    told = {k: v for k, v in (("freq", freq), ("unit", unit)) if v is not None}
    if not told:
        return df
    return df.withColumn("ts", F.col("ts").alias("ts", metadata=declared(df) | told))


def declared(df: DataFrame) -> dict:
    """The frequency and unit that ``declare`` left, as far as they are known."""
    return dict(df.schema["ts"].metadata or {})


def read_csv(spark: SparkSession, path: str, time_col: str = "date", value_col: str = "value", key_cols: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; columns besides those named are ignored."""
    return from_table(spark.read.option("header", True).csv(path), time_col, value_col, key_cols)


def read_parquet(spark: SparkSession, path: str, time_col: str, value_col: str, key_cols: Sequence[str] = ()) -> DataFrame:
    return from_table(spark.read.parquet(path), time_col, value_col, key_cols)


def validate(df: DataFrame) -> DataFrame:
    """``df`` if it holds rows whose times are known and do not repeat in a series
    and whose values are numbers."""
    kind = dict(df.dtypes).get("value")
    if kind not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not str(kind).startswith("decimal"):
        raise TypeError(f"values must be numbers, not {kind}")
    bad = df.groupBy("series_id", "ts").count().where("count > 1 OR ts IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"series {bad[0].series_id!r}: time {bad[0].ts} repeats or is missing")
    if df.isEmpty():
        raise ValueError("there is no observation")
    return df


def validate_positive_int(value, name: str = "value") -> int:
    if not hasattr(value, "__index__"):
        raise TypeError(f"{name} must be an integer, not {type(value).__name__}")
    if value < 1:
        raise ValueError(f"{name} must be positive, not {value}")
    return int(value)


def validate_lags(lags, n: int, name: str = "lags") -> int:
    lags = validate_positive_int(lags, name)
    if lags > n // 2:
        raise ValueError(f"{name} must be at most {n // 2}, not {lags}")
    return lags


def validate_freq(freq: str, name: str = "freq") -> str:
    """``freq`` if ``resample`` knows it, else a ValueError."""
    from seriesloom.sources.frequency import Frequency

    try:
        Frequency.of(freq)
    except ValueError as error:
        raise ValueError(f"{name}: {error}") from None
    return freq


def freq_label(freq: str | None) -> str | None:
    """A frequency's label; multiples and anchors do not matter, others pass through."""
    if freq is None:
        return None
    return LABELS.get(freq.lstrip("0123456789").split("-")[0], freq)


def positioned(df: DataFrame, name: str = "pos") -> DataFrame:
    """With the 0-based position of each observation in its series."""
    return df.withColumn(name, F.row_number().over(along()) - 1)


def micros(ts: str | Column = "ts") -> Column:
    """Microseconds since 1970 as the clock of the series counts them: the
    session's time zone and its changes of clock play no part."""
    c = F.col(ts) if isinstance(ts, str) else ts
    whole = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def seconds(ts: str | Column = "ts") -> Column:
    return micros(ts) / 1e6


def at_micros(us: Column) -> Column:
    """The time that ``micros`` counts."""
    days, rest = F.floor(us / 86_400_000_000).cast("int"), F.pmod(us, F.lit(86_400_000_000))
    midnight = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(secs=(rest.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def properties(df: DataFrame) -> DataFrame:
    """One row a series: n, start, end, duration, missing, regularity, frequency.

    A series is regular if all its gaps are one length, so months are not. Its
    frequency is read from calendar months, business days or the one gap there
    is; else from a median gap within a tenth of a known one.
    """
    gap = seconds() - F.lag(seconds()).over(along())
    months = F.year("ts") * 12 + F.month("ts")
    rows = df.select("series_id", "ts", "value", gap.alias("gap"), (months - F.lag(months).over(along())).alias("step"), (F.pmod(micros(), F.lit(86_400_000_000)) == 0).alias("midnight"))
    stats = rows.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count_if(F.col("value").isNull()).alias("n_nan"),
        F.min("gap").alias("low"),
        F.max("gap").alias("high"),
        F.median("gap").alias("mid"),
        F.min("step").alias("step"),
        F.max("step").alias("step_high"),
        F.min((F.dayofmonth("ts") == 1) & F.col("midnight")).alias("starts"),
        F.min((F.to_date("ts") == F.last_day("ts")) & F.col("midnight")).alias("finishes"),
        F.min((F.weekday("ts") < 5) & ((F.col("gap").isNull()) | (F.col("gap") == F.when(F.weekday("ts") == 0, 3 * 86400).otherwise(86400)))).alias("business"),
    )
    even = F.col("low") == F.col("high")
    calendar = F.when((F.col("step") == F.col("step_high")) & F.col("starts"), F.when(F.col("step") == 1, "MS").when(F.col("step") == 3, "QS").when(F.col("step") == 12, "YS"))
    ending = F.when((F.col("step") == F.col("step_high")) & F.col("finishes"), F.when(F.col("step") == 1, "ME").when(F.col("step") == 3, "QE").when(F.col("step") == 12, "YE"))
    whole = [(a, GAP_SECONDS[a]) for a in ("W", "D", "h", "min", "s")]
    times = F.coalesce(*[F.when(F.col("low") % s == 0, F.concat(F.when(F.col("low") / s == 1, "").otherwise((F.col("low") / s).cast("long").cast("string")), F.lit(a))) for a, s in whole])
    ladder = F.coalesce(*[F.when(F.abs(F.col("mid") - s) / s < 0.10, F.lit(a)) for a, s in GAP_SECONDS.items()])
    told = declared(df).get("freq")
    freq = F.lit(told) if told else F.when(F.col("n") >= 3, F.coalesce(calendar, ending, F.when(even, times), F.when(F.col("business"), "B"), ladder))
    return stats.select(
        "series_id", "n", "start_ts", "end_ts", (micros("end_ts") - micros("start_ts")).alias("duration_us"),
        (F.col("n_nan") > 0).alias("has_nan"), "n_nan", ((F.col("n") < 2) | even).alias("is_regular"), freq.alias("freq"),
    )


def to_pandas(df: DataFrame):
    """One series as a pandas Series; the boundary where data leaves Spark."""
    out = df.orderBy("ts").select("ts", "value").toPandas()
    return out.set_index("ts")["value"]


def to_numpy(df: DataFrame):
    return to_pandas(df).to_numpy(dtype=float)


def equals(a: DataFrame, b: DataFrame) -> bool:
    """Same series, times and values, null equal to null."""
    a, b = (x.select("series_id", "ts", "value") for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
