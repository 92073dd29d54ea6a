"""The series the registered queries read, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.transforms import resample, spine
from seriesloom.sources.frame import from_table


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf}/events.parquet"), "ts", "value", ["event_type"])


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means per event type; hours without events have no row."""
    return resample(raw_events(spark, sf), "h", "mean")


def events_spine(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every hour; null where there was no event."""
    return spine(events(spark, sf), "1 hour")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sum of order prices."""
    t = spark.read.parquet(f"{sf}/orders.parquet")
    return t.groupBy(F.lit("orders").alias("series_id"), F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sum of shipped quantities."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.groupBy(F.lit("lineitem").alias("series_id"), F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("l_quantity").alias("value"))


def shipped_coarse(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped quantities in steps of 100, which has equal neighbours."""
    return shipped(spark, sf).withColumn("value", F.floor(F.col("value") / 100).cast("double"))


#: Common table expressions: e events, s with every hour, o orders, l shipped, c coarse.
E = "e AS (SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"
S = (
    E
    + ", ends AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1), g AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ends)"
    + ", s AS (SELECT g.series_id, g.ts, e.value FROM g LEFT JOIN e ON g.series_id = e.series_id AND g.ts = e.ts)"
)
O = "o AS (SELECT 'orders' AS series_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"  # noqa: E741
L = "l AS (SELECT 'lineitem' AS series_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
C = L + ", c AS (SELECT series_id, ts, CAST(floor(value / 100) AS DOUBLE) AS value FROM l)"
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def shown(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """Doubles rounded and times as text, so that any engine's rows compare."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append((F.round(F.col(name), more.get(name, digits)) + F.lit(0.0)).alias(name))
        elif kind in ("timestamp_ntz", "timestamp"):
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
