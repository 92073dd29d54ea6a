"""Reports on every series: one plan of summaries, one collect, text or HTML.

A section that fails is a warning in the report, and the others still show. Only
summaries, one row a series and section, and a thinned line leave Spark.
"""

from __future__ import annotations

import html
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import events, forecast, quality, stats, structure
from seriesloom.plans.plotdata import svg_line
from seriesloom.sources.frame import by, freq_label, properties

#: Points of a drawn line, about.
POINTS = 400


def _detected(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("series_id").agg(F.count_if("mask").alias(name))


def _changes(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("series_id").agg(F.count_if("is_cp").alias(name))


def sections(df: DataFrame, period: int | None = None, alpha: float = 0.05) -> dict[str, Callable[[], DataFrame]]:
    """Name of each section and the plan of its summary, one row a series."""

    def stationarity() -> DataFrame:
        tests = stats.stationarity(df, ("ADF", "KPSS"), "c", alpha)
        wide = [F.max(F.when(F.col("test_name") == t, F.col(c))).alias(f"{t.lower()}_{c}") for t in ("ADF", "KPSS") for c in ("statistic", "p_value", "is_stationary")]
        return tests.groupBy("series_id").agg(*wide).join(stats.verdict(df, "c", alpha).select("series_id", "verdict"), "series_id")

    def anomalies() -> DataFrame:
        return _detected(events.rolling_iqr(df), "rolling_iqr").join(_detected(events.rolling_z(df), "rolling_z"), "series_id")

    def changepoints() -> DataFrame:
        return _changes(events.binary_segmentation(df), "binary_segmentation").join(_changes(events.cusum(df), "cusum"), "series_id")

    out = {
        "overview": lambda: properties(df),
        "quality": lambda: quality.missing_report(df).drop("nan_positions", "nan_run_lengths"),
        "statistics": lambda: stats.descriptive(df),
        "stationarity": stationarity,
        "seasonality": lambda: structure.seasonality(df, alpha=alpha),
        "forecastability": lambda: forecast.forecastability(df, period, alpha),
        "anomalies": anomalies,
        "changepoints": changepoints,
        "scorecard": lambda: scorecard(df),
        "seasonality in words": lambda: structure.seasonality_summary(structure.seasonality(df, alpha=alpha), alpha=alpha),
    }
    if period:
        out["decomposition"] = lambda: structure.strengths(structure.classical(df, period))
        out["decomposition in words"] = lambda: structure.summary(structure.classical(df, period), period, "classical")
    return out


def collect(df: DataFrame, period: int | None = None, alpha: float = 0.05) -> dict[str, dict[str, dict]]:
    """series_id -> section -> field -> value; a failed section has {"warning": ...}."""
    df = df.persist()
    out: dict[str, dict[str, dict]] = {r.series_id: {} for r in df.select("series_id").distinct().collect()}
    try:
        for name, plan in sections(df, period, alpha).items():
            try:
                for r in plan().collect():
                    fields = r.asDict(recursive=True)
                    out[fields.pop("series_id")][name] = fields
            except Exception as error:  # noqa: BLE001  a section that fails must not hide the rest
                for s in out.values():
                    s[name] = {"warning": f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"}
    finally:
        df.unpersist()
    for s in out.values():
        if "freq" in s.get("overview", {}):
            s["overview"]["frequency"] = freq_label(s["overview"]["freq"])
    return out


def _text(value) -> str:
    if isinstance(value, float):
        return f"{value:.4g}"
    if isinstance(value, list):
        return ", ".join("/".join(_text(x) for x in v.values()) if isinstance(v, dict) else _text(v) for v in value[:5])
    return "-" if value is None else str(value)


def to_string(df: DataFrame, period: int | None = None, alpha: float = 0.05, width: int = 72) -> str:
    """The report as text."""
    lines = []
    for name, parts in sorted(collect(df, period, alpha).items()):
        lines += ["=" * width, name.center(width), "=" * width]
        for title, fields in parts.items():
            lines += ["", title.capitalize(), "-" * width, *[f"  {k:<28}{_text(v)}" for k, v in fields.items()]]
        lines.append("")
    return "\n".join(lines)


def show(df: DataFrame, period: int | None = None, alpha: float = 0.05) -> None:
    print(to_string(df, period, alpha))


def _line(df: DataFrame) -> dict[str, str]:
    """A thinned line of each series with its anomalies, as SVG."""
    found = events.rolling_z(df).withColumn("n", F.count("*").over(by()))
    thin = found.groupBy("series_id", F.floor(F.col("pos") / F.greatest(F.lit(1), F.floor(F.col("n") / POINTS))).alias("k")).agg(F.min("pos").alias("x"), F.avg("value").alias("y"), F.max_by(F.struct("pos", "value"), F.col("mask").cast("int")).alias("m"), F.max("mask").alias("hit"))
    lines: dict[str, list] = {}
    for r in thin.orderBy("series_id", "k").collect():
        lines.setdefault(r.series_id, []).append(r)
    return {s: svg_line([(r.x, r.y) for r in rows], marks=[(r.m.pos, r.m.value) for r in rows if r.hit and r.m.value is not None]) for s, rows in lines.items()}




def generate_html(df: DataFrame, output_path: str, period: int | None = None, alpha: float = 0.05) -> str:
    """Write the report as one HTML file; returns its absolute path."""
    try:
        drawn = _line(df)
    except Exception as error:  # noqa: BLE001
        drawn = {}
        note = f"<p class=warn>{html.escape(str(error).splitlines()[0])}</p>"
    else:
        note = ""
    body = []
    for name, parts in sorted(collect(df, period, alpha).items()):
        body.append(f"<h1>{html.escape(name)}</h1>{drawn.get(name, note)}")
        for title, fields in parts.items():
            rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(_text(v))}</td></tr>" for k, v in fields.items())
            body.append(f'<section id="{html.escape(title)}"><h2>{title.capitalize()}</h2><table>{rows}</table></section>')
    page = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Series report</title><style>body{font:14px sans-serif;margin:2em}th{text-align:left;padding-right:2em}.warn{color:#a00}</style></head><body>" + "".join(body) + "</body></html>"
    path = os.path.abspath(output_path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path


def scorecard(df: DataFrame) -> DataFrame:
    """One row a series: a grade for each headline of the report."""
    missing = quality.missing_report(df).select("series_id", "pct_nan", "longest_nan_run")
    scores = forecast.forecastability(df).select("series_id", "score", "recommended_model", "is_stationary")
    grade = lambda c: F.when(c >= 70, "good").when(c >= 40, "fair").otherwise("poor")
    return missing.join(scores, "series_id").select("series_id", grade(100 - F.col("pct_nan")).alias("quality"), grade(F.col("score")).alias("forecastability"), "score", "is_stationary", "recommended_model", "longest_nan_run")


__all__ = ["collect", "generate_html", "scorecard", "sections", "show", "to_string"]
