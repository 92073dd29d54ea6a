"""Series from streams: windowed profiles and change signals with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_profile(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, mean, deviation and range of each series in tumbling or sliding
    windows; rows later than ``late`` are let go and their state with them."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    v = F.col("value")
    out = stream.withWatermark("ts", late).groupBy("series_id", at.alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select("series_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "mean", "std", "min", "max")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Stretches of each series without a gap of ``gap``."""
    out = stream.withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select("series_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "mean")


def cusum_signals(stream: DataFrame, target: float, sigma: float, threshold: float = 5.0, drift: float = 0.5, late: str = "2 hours", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Two-sided cumulative sums about a known target, across micro-batches; the
    state of a series is two numbers, let go when the stream's watermark, ``late``
    behind its newest time, is ``idle_ms`` milliseconds past the series' last row."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        up, down = state.get if state.exists else (0.0, 0.0)
        rows, found = [], pd.concat(list(batches)).sort_values("ts")[["ts", "value"]]
        for ts, x in found.itertuples(index=False):
            if x != x:
                continue
            up, down = max(0.0, up + x - target - drift * sigma), max(0.0, down - x + target - drift * sigma)
            if max(up, down) > threshold * sigma:
                rows.append((key[0], ts, x, "up" if up >= down else "down"))
                up = down = 0.0
        state.update((up, down))
        last = int(found["ts"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["series_id", "ts", "value", "direction"])

    return stream.withWatermark("ts", late).groupBy("series_id").applyInPandasWithState(run, "series_id string, ts timestamp, value double, direction string", "up double, down double", "append", GroupStateTimeout.EventTimeTimeout)
