import datetime as dt
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from seriesloom import catalog
from seriesloom.operators import events, features, forecast, quality, stats, structure, transforms
from seriesloom.sources import frame

SF = "/root/testdata/sf0.001"
START = dt.datetime(2020, 1, 1)


def series(spark, values, step=dt.timedelta(days=1), name="s"):
    return frame.from_arrays(spark, values, [START + i * step for i in range(len(values))], name)


def values(df):
    return [r.value for r in df.orderBy("ts").collect()]


def same(x):
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return float(f"{float(x):.7g}") if isinstance(x, (int, float, np.number)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted((tuple(map(same, r)) for r in d[columns].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) > 0 and (got["series_id"].notna()).all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_frame(spark):
    df = frame.from_table(spark.createDataFrame([("a", START, float("nan")), ("a", START + dt.timedelta(1), 2.0)], "k string, t timestamp_ntz, v double"), "t", "v", ["k"])
    assert values(df) == [None, 2.0]
    with pytest.raises(KeyError):
        frame.from_table(df, "no", "value")
    with pytest.raises(ValueError):
        frame.validate(df.unionByName(df))
    with pytest.raises(ValueError):
        frame.validate(df.limit(0))
    assert frame.equals(df, df) and not frame.equals(df, df.limit(1))
    assert len(frame.to_numpy(df)) == 2
    s = pd.Series([1.0, 2.0], index=pd.date_range("2020-01-01", periods=2), name="n")
    assert values(frame.from_pandas(spark, s)) == [1.0, 2.0]


@pytest.mark.parametrize("kind,freq", [("D", "D"), ("h", "h"), ("MS", "MS"), ("ME", "ME"), ("B", "B"), ("W-SUN", "W"), ("2h", "2h"), ("QS", "QS"), ("YS", "YS")])
def test_frequency(spark, kind, freq):
    at = pd.date_range("2020-01-01", periods=12, freq=kind)
    r = frame.properties(frame.from_arrays(spark, range(12), [t.to_pydatetime() for t in at])).first()
    assert r.freq == freq and r.is_regular == (len(set(np.diff(at))) == 1)


def test_validators():
    assert frame.validate_positive_int(np.int64(3)) == 3
    for bad, kind in ((0, ValueError), (1.5, TypeError), ("x", TypeError)):
        with pytest.raises(kind):
            frame.validate_positive_int(bad)
    with pytest.raises(ValueError):
        frame.validate_lags(6, 10)
    assert frame.validate_freq("2h") and frame.validate_freq("W-SUN") and frame.freq_label("2h") == "Hourly" and frame.freq_label("x") == "x"
    with pytest.raises(ValueError):
        frame.validate_freq("zz")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,value,more\n2020-01-01,1.5,x\n2020-01-02,,y\n")
    assert values(frame.read_csv(spark, str(tmp_path / "a.csv"))) == [1.5, None]


def test_transforms_of_bad_series_give_no_rows_or_null(spark):
    df = series(spark, [1.0, -1.0, 2.0])
    assert transforms.log(df).count() == 0 and transforms.difference(df, 1, "log").count() == 0
    flat = series(spark, [2.0, 2.0])
    assert values(transforms.standardize(flat)) == [None, None] == values(transforms.normalize(flat))
    with pytest.raises(ValueError):
        transforms.normalize(df, 1, 1)
    with pytest.raises(Exception, match="made 2 values"):
        transforms.apply(df, lambda x: x[:2]).collect()


def test_percent_carries_missing_values_on(spark):
    assert values(transforms.difference(series(spark, [1.0, None, 3.0]), 1, "percent")) == [0.0, 2.0]


def test_flat_runs(spark):
    df = series(spark, [1.0, 1.0, 1.0, 2.0, None, 2.0, 2.0, 5.0])
    assert [(r.start_pos, r.end_pos) for r in quality.flatlines(df, 2).orderBy("start_pos").collect()] == [(0, 2), (5, 6)]
    near = series(spark, [1.0, 1.4, 1.8, 2.2, 2.3])
    # each value is held against its run's first
    assert [(r.start_pos, r.end_pos) for r in quality.flatlines(near, 2, 0.5).orderBy("start_pos").collect()] == [(0, 1), (2, 4)]
    assert values(quality.remove_runs(df, quality.flatlines(df, 3))) == [1.0, None, None, 2.0, None, 2.0, 2.0, 5.0]


def test_outliers_and_clip(spark):
    x = [*np.sin(np.arange(49)).tolist(), 50.0, None]
    df = series(spark, x)
    for m in ("iqr", "zscore", "mad", "gesd"):
        assert [r.value for r in quality.outliers(df, m).where("mask").collect()] == [50.0]
    clipped = values(quality.clip(quality.outliers(df, "iqr")))
    assert clipped[49] < 50 and clipped[50] is None
    assert not quality.outliers(series(spark, [1.0, 2.0, 90.0])).where("mask").count()


def test_missing_and_fills(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None])
    r = quality.missing_report(df).first()
    assert (r.n_nan, r.longest_nan_run, r.nan_run_lengths, r.nan_positions, r.is_monotone_missing) == (4, 2, [1, 1, 2], [0, 2, 3, 5], True)
    assert values(quality.interpolate(df)) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert values(quality.interpolate(df, "linear", limit=1)) == [None, 1.0, 2.0, None, 4.0, 4.0]
    assert values(quality.interpolate(df, "nearest")) == [None, 1.0, 1.0, 4.0, 4.0, None]
    with pytest.raises(ValueError):
        quality.interpolate(df, "constant")


def test_planted_events_are_found(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    x[150:] += 5
    shift = series(spark, x.tolist())
    assert any(abs(r.pos - 150) <= 3 for r in events.binary_segmentation(shift).where("is_cp").collect())
    assert events.cusum(shift).where("is_cp").count() > 0
    y = rng.normal(size=200)
    y[100:] *= 5
    assert any(abs(r.pos - 100) <= 20 for r in events.variance_ratio(series(spark, y.tolist())).where("is_cp").collect())
    z = rng.normal(size=100)
    z[50] = 20
    df = series(spark, z.tolist())
    for found in (events.rolling_iqr(df), events.rolling_z(df), events.gesd(df)):
        assert 50 in [r.pos for r in found.where("mask").collect()]
    assert [r.n_obs for r in events.segments(events.binary_segmentation(shift, penalty=100.0)).orderBy("segment").collect()][0] in range(147, 154)


def test_season_is_found_and_parts_sum(spark):
    t = np.arange(120)
    df = series(spark, (50 + 8 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(size=120) / 5).tolist())
    for m in ("combined", "periodogram", "acf"):
        r = structure.seasonality(df, m).first()
        assert r.is_seasonal and r.dominant_period == 12
    assert structure.test_period(df, 12).first().detected
    for model in ("additive", "multiplicative"):
        parts = structure.classical(df, 12, model).where("trend IS NOT NULL").toPandas()
        back = parts.trend + parts.seasonal + parts.residual if model == "additive" else parts.trend * parts.seasonal * parts.residual
        assert np.allclose(back, parts.observed)
    assert structure.strengths(structure.classical(df, 12)).first().strength_seasonal > 0.9
    assert structure.default_period("QS-OCT") == 4 and structure.default_period("YS") is None


def test_statistics(spark):
    rng = np.random.default_rng(0)
    noise, walk = series(spark, rng.normal(size=300).tolist(), name="n"), series(spark, rng.normal(size=300).cumsum().tolist(), name="w")
    both = noise.unionByName(walk)
    assert {r.series_id: r.is_white_noise for r in stats.white_noise(both).collect()} == {"n": True, "w": False}
    assert {r.series_id: r.verdict for r in stats.verdict(both).collect()} == {"n": "stationary", "w": "unit root"}
    assert stats.stationarity(series(spark, [1.0] * 5)).where("statistic IS NULL").count() == 3
    f = features.spectral(series(spark, np.sin(2 * np.pi * np.arange(256) / 8).tolist())).first()
    assert abs(f.dominant_period - 8) < 0.3


def test_forecastability_and_leakage(spark):
    t = np.arange(200)
    df = series(spark, (20 + 5 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(2).normal(size=200) / 10).tolist())
    r = forecast.forecastability(df).first()
    assert 60 < r.score <= 100 and r.recommended_period == 7 and r.recommended_model == "SARIMA"
    rng = np.random.default_rng(3)
    y = rng.normal(size=100)
    wide = series(spark, y.tolist()).toPandas()
    wide["copy"], wide["ahead"], wide["other"] = y * 2, np.roll(y, 1), rng.normal(size=100)
    found = {x.feature: x for x in forecast.leakage(spark.createDataFrame(wide), ["copy", "ahead", "other"], 5).collect()}
    assert found["copy"].target_leak and not found["other"].target_leak
    assert not found["copy"].temporal_leak


def test_no_series(spark):
    df = series(spark, [1.0]).limit(0)
    for f in (frame.properties, transforms.difference, quality.missing_report, quality.outliers, stats.descriptive, stats.autocorrelation, events.rolling_z, events.cusum, features.statistical, structure.seasonality):
        assert f(df).count() == 0


def test_rest_does_not_import_the_llm_part():
    root = os.path.dirname(os.path.dirname(__file__))
    for d, _, names in os.walk(f"{root}/seriesloom"):
        if not d.endswith("llm"):
            for n in names:
                if n.endswith(".py"):
                    assert "seriesloom.llm" not in open(f"{d}/{n}").read()


@pytest.mark.parametrize("freq", ["s", "15min", "T", "2h", "H", "7h", "D", "3D", "B", "2B", "W", "W-MON", "W-WED", "2W", "MS", "M", "ME", "2ME", "QS", "Q", "QE-NOV", "QS-FEB", "2QS", "YS", "Y", "A", "YE-JUN", "YS-APR"])
@pytest.mark.parametrize("how", ["mean", "count"])
def test_resampling_as_pandas_does(spark, freq, how):
    if freq == "s" and how == "count":
        freq = "30s"
    rng = np.random.default_rng(len(freq))
    far = 3 if freq[-1] in "sT" or "min" in freq else 900
    at = pd.Timestamp("2021-03-10 05:17:31.5") + pd.to_timedelta(np.sort(rng.choice(far * 86400, 300, replace=False)), unit="s")
    x = rng.normal(size=300)
    df = frame.from_arrays(spark, x, [t.to_pydatetime() for t in at])
    alias = {"T": "min", "H": "h", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE"}.get(freq, freq)
    want = getattr(pd.Series(x, at).resample(alias), how)().dropna()
    got = transforms.resample(df, freq, how).orderBy("ts").collect()
    assert [r.ts for r in got] == [t.to_pydatetime() for t in want.index]
    assert np.allclose([r.value for r in got], want.to_numpy())


def test_bad_frequency_and_aggregate(spark):
    df = series(spark, [1.0, 2.0])
    for bad in ("NOTFREQ", "0h", "W-XXX", "QS-MON", "", "MX"):
        with pytest.raises(ValueError):
            transforms.resample(df, bad)
    with pytest.raises(AttributeError):
        transforms.resample(df, "W", "bad_agg")


def test_stray_time_makes_no_giant_row(spark):
    df = frame.from_arrays(spark, [1.0, 2.0], [START, START + dt.timedelta(days=2)])
    assert transforms.spine(df, "1 second").count() == 2 * 86400 + 1
    assert quality.index_gaps(df, "1 second").count() == 2 * 86400 - 1
    assert transforms.resample(df, "s", "sum").count() == 2 * 86400 + 1


@pytest.mark.parametrize("start,end,want", [("2020-04", "2020-04", 30), ("2020", "2020", 366), ("2020-04-01", "2020-04-01", 1), (None, "2020-01", 31), ("2020-12", None, 31), (dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 3), 2)])
def test_slices_by_parts_of_a_date(spark, start, end, want):
    assert transforms.slice_range(series(spark, range(366)), start, end).count() == want


def test_slices_by_hour_and_minute(spark):
    df = series(spark, range(600), dt.timedelta(minutes=1))
    assert transforms.slice_range(df, "2020-01-01 05", "2020-01-01 05").count() == 60
    assert transforms.slice_range(df, "2020-01-01 05:10", "2020-01-01T05:12").count() == 3
    assert transforms.slice_range(df, "2020-01-01 05:10:00", "2020-01-01 05:11:00").count() == 2


def test_undefined_series_do_not_disturb_others(spark):
    from seriesloom.plans import report

    rng = np.random.default_rng(1)
    good = series(spark, rng.normal(size=120).tolist(), name="good")
    mixed = good.unionByName(series(spark, [5.0] * 60, name="flat")).unionByName(series(spark, [1.0, 2.0, 3.0, 4.0], name="short")).unionByName(series(spark, [None] * 20, name="none"))
    rows = {(r.series_id, r.test_name): r for r in stats.stationarity(mixed).collect()}
    assert len(rows) == 12 and rows["good", "ADF"].is_stationary and rows["good", "ADF"].critical_values
    assert all(rows[s, t].statistic is None and rows[s, t].critical_values is None and rows[s, t].is_stationary is None for s in ("short", "none") for t in ("ADF", "KPSS", "PP"))
    assert {r.series_id: r.verdict for r in stats.verdict(mixed).collect()}["good"] == "stationary"
    alone, among = (forecast.forecastability(d).where("series_id = 'good'").first() for d in (good, mixed))
    assert alone == among
    text = report.to_string(mixed, 7)
    assert "warning" not in text.lower() and "scorecard" in text.lower()
    with pytest.raises(ValueError):
        forecast.forecastability(good, 1)


@pytest.mark.parametrize("n", [300, 12_000])
def test_kpss_of_any_length(spark, n):
    from seriesloom.functions import kernels

    x = np.random.default_rng(n).normal(size=n).cumsum()
    r = stats.kpss_statistic(series(spark, x.tolist(), dt.timedelta(minutes=1))).first()
    stat, _, width = kernels.kpss(x)
    assert r.n_lags == width and r.statistic == pytest.approx(stat)


def test_nothing_depends_on_the_time_zone(spark):
    """A spring night in which New York's clocks skip an hour."""
    at = [dt.datetime(2021, 3, 13) + i * dt.timedelta(hours=1) for i in range(72)]
    df = frame.from_arrays(spark, [float(i) if i % 5 else None for i in range(72)], at)
    found = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found.append([frame.properties(df).collect(), transforms.resample(df, "2h", "sum").orderBy("ts").collect(), quality.interpolate(df).orderBy("ts").collect(), features.temporal(df).orderBy("ts").collect(), transforms.resample(df, "D").orderBy("ts").collect()])
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1]
    assert found[0][0][0].is_regular and found[0][0][0].freq == "h"


def test_leakage_correlations_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, x = rng.normal(size=60), rng.normal(size=60)
    wide = series(spark, y.tolist()).toPandas().assign(x=np.where(np.arange(60) % 7 == 0, np.nan, x), flat=1.0)
    df = spark.createDataFrame(wide).withColumn("x", __import__("pyspark.sql.functions", fromlist=["nanvl"]).expr("nullif(x, double('NaN'))"))
    got = {(r.feature, r.lag): r.r for r in forecast.lagged_correlations(df, ["x", "flat"], 3).collect()}
    for k in range(-3, 4):
        pairs = [(wide.x[i], y[i + k]) for i in range(60) if 0 <= i + k < 60 and wide.x[i] == wide.x[i]]
        assert got["x", k] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1])
        assert got["flat", k] == 0.0


def test_one_period_is_tested_as_the_whole_search_finds_it(spark):
    t = np.arange(150)
    df = series(spark, (8 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(size=150)).tolist())
    for period in (12, 13):
        r = structure.test_period(df, period).first()
        for m, flag in (("periodogram", r.periodogram_detected), ("acf", r.acf_detected)):
            assert flag == (period in [c.period for c in structure.seasonality(df, m, 20).first().candidates])
        scores = {c.period: c.score for c in structure.seasonality(df, "combined", 20).first().candidates}
        assert r.strength == scores.get(period, 0.0)


def test_summaries_in_words(spark):
    t = np.arange(96)
    df = series(spark, (8 * np.sin(2 * np.pi * t / 12)).tolist())
    parts = structure.stl(df, 12)
    text = structure.summary(parts, 12, "stl").first().summary
    assert "method            : stl" in text and "period            : 12" in text and "strength_seasonal : 1.0000" in text
    text = structure.seasonality_summary(structure.seasonality(df)).first().summary
    assert "dominant_period   : 12" in text and "period=12 score=" in text


def test_local_regression_decomposition(spark):
    t = np.arange(120)
    x = 50 + 0.1 * t + 8 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(size=120) / 5
    x[40] += 30
    y = x.tolist()
    y[7] = None
    parts = structure.stl(series(spark, y), 12).orderBy("ts").toPandas()
    assert np.isnan(parts.residual[7]) and np.allclose((parts.trend + parts.seasonal + parts.residual).drop(7), np.delete(x, 7))
    assert parts.residual.abs().idxmax() == 40 and parts.residual[40] > 25  # what is robust leaves an outlier out of the season
    assert structure.strengths(structure.stl(series(spark, (x - 30 * (t == 40)).tolist()), 12)).first().strength_seasonal > 0.95
    assert structure.stl(series(spark, y[:20]), 12).count() == 0
    with pytest.raises(ValueError):
        structure.stl(series(spark, y), 1)


def test_declared_frequency_and_index(spark):
    s = pd.Series([1.0, 2.0, 3.0, 4.0], index=pd.date_range("2020-01-01", periods=4), name="n")
    other = pd.date_range("2021-06-01", periods=4, freq="h")
    df = frame.from_pandas(spark, s, index=other, freq="2h", unit="kW")
    assert frame.declared(df) == {"freq": "2h", "unit": "kW"}
    r = frame.properties(df).first()
    assert r.freq == "2h" and r.start_ts == dt.datetime(2021, 6, 1)
    assert frame.properties(frame.from_pandas(spark, s)).first().freq == "D"
    with pytest.raises(ValueError):
        frame.from_pandas(spark, s, freq="NOTFREQ")
    with pytest.raises(TypeError):
        frame.validate(spark.createDataFrame([("a", START, "x")], "series_id string, ts timestamp_ntz, value string"))
