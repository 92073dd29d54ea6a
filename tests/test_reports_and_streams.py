import datetime as dt

import numpy as np
import pytest

from seriesloom.plans import plotdata, report
from seriesloom.sources import frame
from seriesloom.streaming import profile

START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def two(spark):
    t = np.arange(120)
    rng = np.random.default_rng(0)
    x = 20 + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(size=120)
    at = [START + dt.timedelta(days=int(i)) for i in t]
    return frame.from_arrays(spark, x.tolist(), at, "<a>").unionByName(frame.from_arrays(spark, [1.0] * 12, at[:12], "flat"))


def test_reports_hold_every_section(two, tmp_path):
    found = report.collect(two, 7)
    assert set(found) == {"<a>", "flat"} and found["<a>"]["seasonality"]["dominant_period"] == 7
    text = report.to_string(two)
    assert "Forecastability" in text and "rolling_iqr" in text
    path = report.generate_html(two, str(tmp_path / "r.html"), 7)
    page = open(path, encoding="utf-8").read()
    assert "&lt;a&gt;" in page and "<svg" in page and 'id="decomposition"' in page


def test_a_failed_section_is_a_warning(two, monkeypatch):
    monkeypatch.setattr(report.stats, "descriptive", lambda df: 1 / 0)
    found = report.collect(two)
    assert "ZeroDivisionError" in found["<a>"]["statistics"]["warning"] and "n" in found["<a>"]["overview"]


def test_plot_rows(two):
    assert plotdata.svg_line([(0, 1.0), (1, None), (2, 3.0)], marks=[(2, 3.0)]).count("polyline") == 2
    assert plotdata.svg_line([]) == "<svg/>"
    q = plotdata.qq(two.where("series_id = '<a>'")).orderBy("r").collect()
    assert len(q) == 120 and q[0].theoretical < -2 < 2 < q[-1].theoretical
    d = plotdata.density(two).where("series_id = '<a>'").orderBy("i").collect()
    assert abs(sum(r.density for r in d) * (d[1].x - d[0].x) - 1) < 0.1
    assert {r.n for r in plotdata.histogram(two.where("series_id = 'flat'")).collect()} == {12}


def plain_heatmap(x, max_lag=40):
    x, n, found = np.asarray(x, float), len(x), {}
    size = min(max(2 * max_lag + 4, n // 5), n)
    if size < max_lag + 4:
        return found
    cap = min(max_lag, size // 2 - 1)
    for j, s in enumerate(range(0, n - size + 1, max(1, (n - size) // 50))):
        w = x[s : s + size]
        w = w[~np.isnan(w)]
        if len(w) < cap + 4 or w.min() == w.max():
            continue
        c = w - w.mean()
        found |= {(j, k): c[k:] @ c[: len(c) - k] / (c @ c) for k in range(cap + 1)}
    return found


def test_acf_heatmap_against_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    hourly = 20 + 5 * np.sin(2 * np.pi * np.arange(720) / 24) + rng.normal(size=720)
    hourly[100:190] = np.nan
    every = {"a#1": hourly, "b": rng.normal(size=300), "short": rng.normal(size=60), "tiny": rng.normal(size=43), "flat": np.ones(200)}
    df = None
    for name, x in every.items():
        at = [START + dt.timedelta(hours=i) for i in range(len(x))]
        one = frame.from_arrays(spark, [None if np.isnan(v) else float(v) for v in x], at, name)
        df = one if df is None else df.unionByName(one)
    got = {(r.series_id, r.window, r.lag): r.acf for r in plotdata.acf_heatmap(df).collect()}
    want = {(name, *k): v for name, x in every.items() for k, v in plain_heatmap(x).items()}
    assert set(got) == set(want) and ("b", 0, 40) in got
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_windowed_profile_and_sessions(spark, tmp_path):
    rows = [("a", START + dt.timedelta(minutes=m), float(m)) for m in (0, 10, 70, 80, 200)]
    s = stream(spark, tmp_path, rows)
    found = run(spark, profile.windowed_profile(s), "w", "complete")
    assert sorted(r.n for r in found) == [1, 2, 2]
    assert sorted(r.n for r in run(spark, profile.sessions(s), "s", "complete")) == [1, 2, 2]


def test_cusum_signals(spark, tmp_path):
    rows = [("a", START + dt.timedelta(minutes=m), 0.0 if m < 10 else 4.0) for m in range(20)]
    found = run(spark, profile.cusum_signals(stream(spark, tmp_path, rows), 0.0, 1.0), "c", "append")
    assert found and all(r.direction == "up" for r in found)
