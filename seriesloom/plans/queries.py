"""Registered queries: each a function of (spark, sf_dir), with SQL where SQL can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators import events as ev
from seriesloom.operators import features, forecast, quality, stats, structure
from seriesloom.operators import transforms as tr
from seriesloom.plans import plotdata, report
from seriesloom.plans.inputs import STAMP, C, E, L, O, S, events, events_spine, orders, raw_events, shipped, shipped_coarse, shown
from seriesloom.sources import frame as fr

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def add(name, build, operator, sql=None, digits=6):
    QUERIES[name] = lambda spark, sf: shown(operator(build(spark, sf)), digits)
    if sql is not None:
        SQL[name] = sql


W = "(PARTITION BY series_id ORDER BY ts)"
P = "(PARTITION BY series_id)"


def rows_sql(ctes: str, table: str, value: str, where: str = "", digits: int = 6, extra: str = "") -> str:
    return f"WITH {ctes}, r AS (SELECT *, {value} AS out FROM {table}) SELECT series_id, {STAMP}, round(out, {digits}) + 0.0 AS value{extra} FROM r {where}"


# Frame and transforms
add(
    "properties", events, fr.properties,
    f"""WITH {E}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER {W} AS gap FROM e),
    p AS (SELECT series_id, count(*) AS n, min(ts) AS a, max(ts) AS b, count(*) FILTER (WHERE value IS NULL) AS n_nan, min(gap) AS lo, max(gap) AS hi, median(gap) AS mid FROM g GROUP BY 1)
    SELECT series_id, n, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(b, '%Y-%m-%d %H:%M:%S') AS end_ts, epoch_us(b) - epoch_us(a) AS duration_us, n_nan > 0 AS has_nan, n_nan, n < 2 OR lo = hi AS is_regular,
    CASE WHEN n < 3 THEN NULL WHEN abs(mid / 1e6 - 3600) / 3600 < 0.1 THEN 'h' WHEN abs(mid / 1e6 - 86400) / 86400 < 0.1 THEN 'D' END AS freq FROM p""",
)
add("slice_range", orders, lambda d: tr.slice_range(d, "1995-03-01", "1995-06-30"), rows_sql(O, "o", "value", "WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-07-01'"))
add("slice_month", orders, lambda d: tr.slice_range(d, "1995-03", "1995-04"), rows_sql(O, "o", "value", "WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-05-01'"))
add("slice_year", orders, lambda d: tr.slice_range(d, end="1996"), rows_sql(O, "o", "value", "WHERE ts < TIMESTAMP '1997-01-01'"))
add("slice_hour", raw_events, lambda d: tr.resample(tr.slice_range(d, "2024-01-03 05", "2024-01-05 16"), "h", "count"), f"WITH {E}, c AS (SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, count(value) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-05 17:00:00' GROUP BY 1, 2), x AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM c GROUP BY 1), h AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM x) SELECT h.series_id, strftime(h.ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM h LEFT JOIN c ON c.series_id = h.series_id AND c.ts = h.ts")
add("positions", orders, lambda d: tr.at_positions(d, 10, -10).select("series_id", "ts", "value", "pos"), f"WITH {O}, r AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n FROM o) SELECT series_id, {STAMP}, round(value, 6) + 0.0 AS value, pos FROM r WHERE pos >= 10 AND pos < n - 10")
add("contains", orders, lambda d: tr.contains(d, "1996-02-29 00:00:00"), f"WITH {O} SELECT series_id, bool_or(ts = TIMESTAMP '1996-02-29') AS found FROM o GROUP BY 1")
add("diff_simple", orders, tr.difference, rows_sql(O, "o", f"value - lag(value) OVER {W}", "WHERE out IS NOT NULL", 4), 4)
add("diff_log", orders, lambda d: tr.difference(d, 7, "log"), rows_sql(O, "o", f"ln(value) - lag(ln(value), 7) OVER {W}", "WHERE out IS NOT NULL"))
add("diff_percent", events_spine, lambda d: tr.difference(d, 1, "percent"), f"WITH {S}, f AS (SELECT series_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM s), r AS (SELECT *, value / lag(value) OVER {W} - 1 AS out FROM f) SELECT series_id, {STAMP}, round(out, 6) + 0.0 AS value FROM r WHERE out IS NOT NULL")
add("log", orders, tr.log, rows_sql(O, "o", "ln(value)"))
add("standardize", orders, tr.standardize, rows_sql(O, "o", f"(value - avg(value) OVER {P}) / stddev_samp(value) OVER {P}"))
add("normalize", orders, lambda d: tr.normalize(d, lower=-1.0, upper=1.0), rows_sql(O, "o", f"(value - min(value) OVER {P}) / (max(value) OVER {P} - min(value) OVER {P}) * 2 - 1"))
add("apply_rank_share", events, lambda d: tr.apply(d, lambda x: x.argsort(kind="stable").argsort(kind="stable") / max(1, len(x) - 1)), rows_sql(E, "e", "(row_number() OVER (PARTITION BY series_id ORDER BY value, ts) - 1) / greatest(1, count(*) OVER (PARTITION BY series_id) - 1)"))

# Resampling and rolling windows
_AGG = {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_samp(value)", "var": "var_samp(value)", "first": "arg_min(value, ts)", "last": "arg_max(value, ts)"}
_RAW = "e AS (SELECT event_type AS series_id, ts, value FROM events)"
for _how, _sql in _AGG.items():
    if _how in ("first", "last"):  # hourly means have one row a time, raw events may not
        add(f"resample_{_how}", events, lambda d, h=_how: tr.resample(d, "D", h), f"WITH {E}, r AS (SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS b, {_sql} AS v FROM e GROUP BY 1, 2) SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 6) + 0.0 AS value FROM r")
    else:
        add(f"resample_{_how}", raw_events, lambda d, h=_how: tr.resample(d, "D", h), f"WITH {_RAW}, r AS (SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS b, {_sql} AS v FROM e GROUP BY 1, 2) SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 6) + 0.0 AS value FROM r WHERE v IS NOT NULL")
for _how in ("sum", "count"):
    add(
        f"resample_{_how}", raw_events, lambda d, h=_how: tr.resample(d, "h", h),
        f"""WITH {_RAW}, r AS (SELECT series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, CAST({_how}(value) AS DOUBLE) AS v FROM e GROUP BY 1, 2), ends AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM r GROUP BY 1),
        g AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ends) SELECT g.series_id, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(v, 0.0), 6) + 0.0 AS value FROM g LEFT JOIN r ON r.series_id = g.series_id AND r.ts = g.ts""",
    )
add("resample_week", orders, lambda d: tr.resample(d, "W", "mean"), f"WITH {O}, r AS (SELECT series_id, date_trunc('week', ts) + INTERVAL 6 DAY AS b, avg(value) AS v FROM o GROUP BY 1, 2) SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 4) + 0.0 AS value FROM r", 4)
add("resample_month_end", orders, lambda d: tr.resample(d, "ME", "max"), f"WITH {O}, r AS (SELECT series_id, last_day(ts) AS b, max(value) AS v FROM o GROUP BY 1, 2) SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 6) + 0.0 AS value FROM r")
add("resample_quarter", orders, lambda d: tr.resample(d, "QS", "median"), f"WITH {O}, r AS (SELECT series_id, date_trunc('quarter', ts) AS b, quantile_cont(value, 0.5) AS v FROM o GROUP BY 1, 2) SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 4) + 0.0 AS value FROM r", 4)
_DATED = "SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 4) + 0.0 AS value FROM r"
for _name, _freq, _bin in (
    ("week_monday", "W-MON", "ts + to_days(CAST((8 - isodow(ts)) % 7 AS INTEGER))"),
    ("business", "B", "ts - to_days(CAST(greatest(0, isodow(ts) - 5) AS INTEGER))"),
    ("month", "M", "last_day(ts)"),
    ("quarter_end", "Q", "last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH)"),
    ("quarter_november", "QE-NOV", "last_day(date_trunc('quarter', ts + INTERVAL 1 MONTH) + INTERVAL 1 MONTH)"),
    ("year_april", "YS-APR", "date_trunc('year', ts - INTERVAL 3 MONTH) + INTERVAL 3 MONTH"),
):
    add(f"resample_{_name}", orders, lambda d, f=_freq: tr.resample(d, f, "mean"), f"WITH {O}, r AS (SELECT series_id, CAST({_bin} AS TIMESTAMP) AS b, avg(value) AS v FROM o GROUP BY 1, 2) {_DATED}", 4)
add("resample_two_weeks", orders, lambda d: tr.resample(d, "2W", "max"), f"WITH {O}, w AS (SELECT *, ts + to_days(CAST(7 - isodow(ts) AS INTEGER)) AS e FROM o), f AS (SELECT *, min(e) OVER {P} AS first FROM w), r AS (SELECT series_id, first + to_days(CAST(14 * ceil(date_diff('day', first, e) / 14.0) AS INTEGER)) AS b, max(value) AS v FROM f GROUP BY 1, 2) {_DATED}", 4)
add("resample_two_hours", raw_events, lambda d: tr.resample(d, "2h", "median"), f"WITH {_RAW}, r AS (SELECT series_id, time_bucket(INTERVAL 2 HOUR, ts) AS b, quantile_cont(value, 0.5) AS v FROM e GROUP BY 1, 2) {_DATED} WHERE v IS NOT NULL", 4)
add("resample_quarter_hour", raw_events, lambda d: tr.resample(d, "15min", "max"), f"WITH {_RAW}, r AS (SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS b, max(value) AS v FROM e GROUP BY 1, 2) {_DATED} WHERE v IS NOT NULL", 4)
add(
    "resample_seven_hours", raw_events, lambda d: tr.resample(d, "7h", "sum"),
    f"""WITH {_RAW}, f AS (SELECT *, date_trunc('day', min(ts) OVER {P}) AS first FROM e), k AS (SELECT series_id, first, CAST(floor((epoch_us(ts) - epoch_us(first)) / 25200e6) AS BIGINT) AS k, sum(value) AS v FROM f GROUP BY 1, 2, 3), x AS (SELECT series_id, first, min(k) AS a, max(k) AS b FROM k GROUP BY 1, 2),
    g AS (SELECT series_id, first, unnest(range(a, b + 1)) AS k FROM x) SELECT g.series_id, strftime(g.first + to_hours(CAST(7 * g.k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(v, 0.0), 4) + 0.0 AS value FROM g LEFT JOIN k ON k.series_id = g.series_id AND k.k = g.k""", 4,
)
for _how, _sql in {**_AGG, "sum": "sum(value)", "count": "count(value)", "first": "first_value(value IGNORE NULLS)", "last": "last_value(value IGNORE NULLS)"}.items():
    _over = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    add(f"rolling_{_how}", events_spine, lambda d, h=_how: tr.rolling(d, 12, h, min_periods=6), rows_sql(S, "s", f"CASE WHEN count(value) {_over} >= 6 THEN {_sql} {_over} END", "WHERE out IS NOT NULL", 9), 9)
_over = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)"
add("rolling_centred", orders, lambda d: tr.rolling(d, 8, "mean", center=True), rows_sql(O, "o", f"CASE WHEN count(value) {_over} >= 8 THEN avg(value) {_over} END", "WHERE out IS NOT NULL", 4), 4)

# Missing values
_RUNS = f"{S}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, value IS NULL AS gone FROM s), i AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id, gone ORDER BY ts) AS run FROM q)"


@query(
    "missing_report",
    f"""WITH {_RUNS}, u AS (SELECT series_id, run, count(*) AS size FROM i WHERE gone GROUP BY 1, 2), z AS (SELECT series_id, max(size) AS longest, string_agg(CAST(size AS VARCHAR), ',' ORDER BY size) AS sizes FROM u GROUP BY 1),
    b AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE gone) AS n_nan, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE gone) AS at_pos, bool_or(gone AND pos = 0) AS head, max(pos) AS last, max(pos) FILTER (WHERE gone) AS lastgone FROM i GROUP BY 1)
    SELECT b.series_id, n, n_nan, round(100.0 * n_nan / n, 4) AS pct_nan, CAST(coalesce(longest, 0) AS BIGINT) AS longest_nan_run, coalesce(sizes, '') AS nan_run_lengths, coalesce(at_pos, '') AS nan_positions, coalesce(head OR last = lastgone, false) AS is_monotone_missing FROM b LEFT JOIN z ON b.series_id = z.series_id""",
)
def _missing(spark, sf):
    r = quality.missing_report(events_spine(spark, sf))
    return shown(r.withColumn("nan_run_lengths", F.array_join("nan_run_lengths", ",")).withColumn("nan_positions", F.array_join("nan_positions", ",")))


add("index_gaps", events, lambda d: quality.index_gaps(d, "1 hour"), f"WITH {S} SELECT series_id, {STAMP} FROM s WHERE value IS NULL")
_FILL = f"""{S}, q AS (SELECT *, row_number() OVER {W} AS i FROM s), f AS (SELECT *,
 last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pi, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pv,
 last_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pt,
 first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi, first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv,
 first_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qt FROM q)"""


def _fill_sql(expr: str) -> str:
    return f"WITH {_FILL}, r AS (SELECT *, {expr} AS x FROM f) SELECT series_id, {STAMP}, round(coalesce(value, x), 6) + 0.0 AS value, value IS NULL AND x IS NOT NULL AS was_filled FROM r"


_LINE = "pv + (qv - pv) * (epoch_us(ts) - pt) / (qt - pt)"
for _name, _kw, _expr in (
    ("linear", {}, f"CASE WHEN pt = qt THEN pv WHEN pv IS NOT NULL AND qv IS NOT NULL THEN {_LINE} ELSE coalesce(pv, qv) END"),
    ("linear_limit", {"limit": 1}, f"CASE WHEN pt = qt THEN pv WHEN i - pi > 1 THEN NULL WHEN pv IS NOT NULL AND qv IS NOT NULL THEN {_LINE} ELSE pv END"),
    ("forward", {}, "pv"),
    ("forward_limit", {"limit": 1}, "CASE WHEN i - coalesce(pi, 0) <= 1 THEN pv END"),
    ("backward", {}, "qv"),
    ("backward_limit", {"limit": 1}, "CASE WHEN qi - i <= 1 THEN qv END"),
    ("nearest", {}, "CASE WHEN pv IS NOT NULL AND qv IS NOT NULL THEN CASE WHEN epoch_us(ts) - pt <= qt - epoch_us(ts) THEN pv ELSE qv END END"),
    ("zero", {}, "0.0"),
    ("constant", {"fill_value": 7.5}, "7.5"),
):
    add(f"interpolate_{_name}", events_spine, lambda d, m=_name.split("_")[0], k=_kw: quality.interpolate(d, m, **k), _fill_sql(_expr))
add("interpolate_spline", events_spine, lambda d: quality.interpolate(d, "spline"))

# Flat runs
_ISLANDS = f"{C}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, CASE WHEN value IS DISTINCT FROM lag(value) OVER {W} THEN 1 ELSE 0 END AS new FROM c), i AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM q)"
add("flatline", shipped_coarse, lambda d: quality.flatlines(d, 2), f"WITH {_ISLANDS} SELECT series_id, min(pos) AS start_pos, max(pos) AS end_pos, min(value) AS value, count(*) AS size FROM i GROUP BY series_id, run HAVING count(*) >= 2")
add(
    "flatline_tolerance", shipped_coarse, lambda d: quality.flatlines(d, 3, 1.0),
    f"""WITH RECURSIVE {C}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM c), f AS (SELECT series_id, pos, value, value AS anchor, 1 AS run FROM q WHERE pos = 0 UNION ALL
    SELECT q.series_id, q.pos, q.value, CASE WHEN abs(q.value - anchor) <= 1 THEN anchor ELSE q.value END, CASE WHEN abs(q.value - anchor) <= 1 THEN run ELSE run + 1 END FROM f JOIN q ON q.series_id = f.series_id AND q.pos = f.pos + 1)
    SELECT series_id, min(pos) AS start_pos, max(pos) AS end_pos, arg_min(value, pos) AS value, count(*) AS size FROM f GROUP BY series_id, run HAVING count(*) >= 3""",
)
add("near_zero", shipped_coarse, lambda d: quality.near_zero(d.withColumn("value", F.col("value") - 10), 1, 1.0), f"WITH {C}, q AS (SELECT series_id, ts, value - 10 AS value, row_number() OVER {W} - 1 AS pos, abs(value - 10) <= 1 AS small FROM c), i AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id, small ORDER BY ts) AS run FROM q) SELECT series_id, min(pos) AS start_pos, max(pos) AS end_pos, arg_min(value, pos) AS value, count(*) AS size FROM i WHERE small GROUP BY series_id, run")
add("remove_flatlines", shipped_coarse, lambda d: quality.remove_runs(d, quality.flatlines(d, 2)), f"WITH {_ISLANDS}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY pos) AS r FROM i) SELECT series_id, {STAMP}, CASE WHEN r = 1 THEN value END AS value FROM k")

# Outliers
_BOUNDS = {
    "iqr": "SELECT series_id, 2.5 * quantile_cont(value, 0.25) - 1.5 * quantile_cont(value, 0.75) AS lo, 2.5 * quantile_cont(value, 0.75) - 1.5 * quantile_cont(value, 0.25) AS hi FROM o GROUP BY 1",
    "zscore": "SELECT series_id, avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM o GROUP BY 1",
    "mad": "SELECT series_id, median(value) - 3.5 / 0.6745 * mad(value) AS lo, median(value) + 3.5 / 0.6745 * mad(value) AS hi FROM o GROUP BY 1",
}
for _m, _b in _BOUNDS.items():
    add(f"outliers_{_m}", orders, lambda d, m=_m: quality.outliers(d, m), f"WITH {O}, b AS ({_b}) SELECT o.series_id, {STAMP}, round(value, 3) + 0.0 AS value, value < lo OR value > hi AS mask, round(lo, 3) + 0.0 AS lower_bound, round(hi, 3) + 0.0 AS upper_bound FROM o JOIN b ON o.series_id = b.series_id", 3)
add("outliers_gesd", orders, lambda d: quality.outliers(d, "gesd"))
add("outliers_removed", orders, lambda d: quality.remove_flagged(quality.outliers(d, "iqr")), f"WITH {O}, b AS ({_BOUNDS['iqr']}) SELECT o.series_id, {STAMP}, CASE WHEN value >= lo AND value <= hi THEN round(value, 6) + 0.0 END AS value FROM o JOIN b ON o.series_id = b.series_id")
add("outliers_clipped", orders, lambda d: quality.clip(quality.outliers(d, "iqr")), f"WITH {O}, b AS ({_BOUNDS['iqr']}) SELECT o.series_id, {STAMP}, round(greatest(lo, least(hi, value)), 4) + 0.0 AS value FROM o JOIN b ON o.series_id = b.series_id", 4)

# Statistics
_Q = ", ".join(f"round(quantile_cont(value, {q}), 5) + 0.0 AS q{round(100 * q):02d}" for q in stats.QUANTILES)
_TRIM = "SELECT series_id, avg(value) AS tm FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM s WHERE value IS NOT NULL) WHERE r > {k} AND r <= n - {k} GROUP BY 1"
add(
    "descriptive", events_spine, stats.descriptive,
    f"""WITH {S}, t AS ({_TRIM.format(k="floor(n * 0.05)")}), d AS (SELECT series_id, count(*) AS n_total, count(value) AS n_valid, count(*) - count(value) AS n_nan, round(100.0 * (count(*) - count(value)) / count(*), 4) AS pct_nan, round(avg(value), 5) AS mean, round(median(value), 5) AS median,
    round(stddev_samp(value), 5) AS std, round(var_samp(value), 5) AS var, round(mad(value), 5) AS mad, round(stddev_samp(value) / abs(avg(value)), 5) AS cv, round(min(value), 5) AS min, round(max(value), 5) AS max, round(max(value) - min(value), 5) AS range, round(arg_min(value, ts) FILTER (WHERE value IS NOT NULL), 5) AS first, round(arg_max(value, ts) FILTER (WHERE value IS NOT NULL), 5) AS last,
    round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis, {_Q}, count(*) FILTER (WHERE value = 0) AS n_zeros, count(*) FILTER (WHERE value > 0) AS n_positive, count(*) FILTER (WHERE value < 0) AS n_negative FROM s GROUP BY 1)
    SELECT d.*, round(tm, 5) AS trimmed_mean FROM d JOIN t ON d.series_id = t.series_id""", 5,
)
_ACF = f"""{O}, q AS (SELECT series_id, row_number() OVER {W} AS i, value - avg(value) OVER {P} AS c, count(*) OVER {P} AS n FROM o), t AS (SELECT series_id, sum(c * c) AS d, max(n) AS n FROM q GROUP BY 1),
k AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.c * b.c) AS p FROM q a JOIN q b ON a.series_id = b.series_id AND b.i - a.i BETWEEN 0 AND 40 GROUP BY 1, 2), r AS (SELECT k.series_id, n, lag, p / d AS acf FROM k JOIN t ON k.series_id = t.series_id)"""
add(
    "acf", orders, stats.autocorrelation,
    f"WITH {_ACF} SELECT series_id, n, lag, round(acf, 6) + 0.0 AS acf, round(CASE WHEN lag = 0 THEN -1 ELSE -1.959963984540054 / sqrt(n) END, 6) AS conf_lower, round(CASE WHEN lag = 0 THEN 1 ELSE 1.959963984540054 / sqrt(n) END, 6) AS conf_upper, round(n * (n + 2) * sum(CASE WHEN lag > 0 THEN acf * acf / (n - lag) ELSE 0 END) OVER (PARTITION BY series_id ORDER BY lag), 6) + 0.0 AS lb_statistic FROM r",
)
_RUNNING = O.replace("o AS", "o0 AS") + ", o AS (SELECT series_id, ts, sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM o0)"
add(
    "significant_lags", lambda spark, sf: orders(spark, sf).withColumn("value", F.sum("value").over(fr.along().rowsBetween(Window.unboundedPreceding, 0))), lambda d: stats.significant_lags(stats.autocorrelation(d)).select("series_id", "lag", "acf"),
    f"WITH {_ACF.replace(O, _RUNNING)} SELECT series_id, lag, round(acf, 6) + 0.0 AS acf FROM r WHERE lag > 0 AND abs(acf) > 1.959963984540054 / sqrt(n)",
)
add("correlogram_pacf", events, stats.correlogram)
_EACF = _ACF.replace(O, E).replace("FROM o)", "FROM e)")
add(
    "pacf", events, lambda d: stats.correlogram(d, 20).select("series_id", "lag", "acf", "pacf"),
    f"""WITH RECURSIVE {_EACF}, l AS (SELECT series_id, list(acf ORDER BY lag) AS rho FROM r WHERE lag BETWEEN 1 AND 20 GROUP BY 1), d AS (SELECT series_id, 1 AS lag, rho, [rho[1]] AS phi FROM l UNION ALL
    SELECT series_id, lag + 1, rho, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda x: x[1] - z * x[2]), z) FROM (SELECT *, (rho[lag + 1] - list_dot_product(phi, list_reverse(rho[1:lag]))) / (1 - list_dot_product(phi, rho[1:lag])) AS z FROM d WHERE lag < len(rho)))
    SELECT series_id, lag, round(rho[lag], 6) + 0.0 AS acf, round(phi[lag], 6) + 0.0 AS pacf FROM d UNION ALL SELECT series_id, 0, 1.0, 1.0 FROM l""",
)
#: The chi-squared value of 20 degrees that 5 in 100 exceed.
add("white_noise", events, stats.white_noise, f"WITH {_EACF} SELECT series_id, max(n) AS n_obs, 20 AS lag, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 6) + 0.0 AS q, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) < 31.410432844230918 AS is_white_noise FROM r WHERE lag BETWEEN 1 AND 20 GROUP BY 1")
add("stationarity", orders, lambda d: stats.stationarity(d).withColumn("critical_values", F.to_json("critical_values")))
add("stationarity_verdict", events, stats.verdict)
add(
    "kpss_statistic", orders, stats.kpss_statistic,
    f"""WITH {O}, q AS (SELECT series_id, row_number() OVER {W} AS i, value - avg(value) OVER {P} AS e, count(*) OVER {P} AS n FROM o), c AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS s, CAST(greatest(1, floor(4 * power(n / 100.0, 0.25))) AS BIGINT) AS w FROM q),
    a AS (SELECT series_id, max(n) AS n, max(w) AS w, sum(s * s) AS ss, sum(e * e) AS ee FROM c GROUP BY 1), j AS (SELECT x.series_id, y.i - x.i AS lag, sum(x.e * y.e) AS p FROM c x JOIN c y ON x.series_id = y.series_id AND y.i - x.i BETWEEN 1 AND x.w GROUP BY 1, 2),
    l AS (SELECT j.series_id, sum(2 * (1 - lag / (w + 1.0)) * p) AS extra FROM j JOIN a ON j.series_id = a.series_id GROUP BY 1) SELECT a.series_id, n AS n_obs, w AS n_lags, round(ss / (n * (ee + extra)), 6) + 0.0 AS statistic FROM a JOIN l ON a.series_id = l.series_id""",
)

# Decomposition and seasonality
def _classical_sql(ctes: str, table: str, period: int, digits: int, mult: bool = False) -> str:
    h = period // 2
    over = lambda a, b: f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
    full = lambda a, b: f"CASE WHEN count(value) {over(a, b)} = {a + b + 1} THEN avg(value) {over(a, b)} END"
    trend = full(h, h) if period % 2 else f"({full(h, h - 1)} + {full(h - 1, h)}) / 2"
    op, inv, both = ("/", "/", "trend * seasonal") if mult else ("-", "-", "(trend + seasonal)")
    rest = f"value / ({both})" if mult else "value - trend - seasonal"
    return f"""WITH {ctes}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, {trend} AS trend FROM {table}), m AS (SELECT series_id, pos % {period} AS phase, avg(value {op} trend) AS m FROM q GROUP BY 1, 2),
    c AS (SELECT series_id, phase, m {inv} avg(m) OVER (PARTITION BY series_id) AS seasonal FROM m) SELECT q.series_id, {STAMP}, pos, round(value, {digits}) + 0.0 AS observed, round(trend, {digits}) + 0.0 AS trend, round(seasonal, {digits}) + 0.0 AS seasonal, round({rest}, {digits}) + 0.0 AS residual FROM q JOIN c ON q.series_id = c.series_id AND pos % {period} = phase"""


add("decompose_additive_24", events, lambda d: structure.classical(d, 24), _classical_sql(E, "e", 24, 9), 9)
add("decompose_additive_7", orders, lambda d: structure.classical(d, 7), _classical_sql(O, "o", 7, 3), 3)
add("decompose_multiplicative", orders, lambda d: structure.classical(d, 7, "multiplicative"), _classical_sql(O, "o", 7, 4, True), 4)
_PARTS = f"p AS ({_classical_sql(E, 'e', 24, 15)})"
_SHARE = "round(CASE WHEN count({c} + residual) >= 2 THEN coalesce(greatest(0, 1 - var_pop(residual) FILTER (WHERE {c} IS NOT NULL) / nullif(var_pop({c} + residual), 0)), 0) ELSE 0 END, 6) + 0.0"
add("decompose_strengths", events, lambda d: structure.strengths(structure.classical(d, 24)), f"WITH {_PARTS} SELECT series_id, count(residual) AS n_obs_used, {_SHARE.format(c='trend')} AS strength_trend, {_SHARE.format(c='seasonal')} AS strength_seasonal FROM p GROUP BY 1")
add("stl", events, lambda d: structure.stl(d, 24))
add("stl_savgol", events, lambda d: structure.stl(d, 24, "savgol"))
#: Power of the detrended, Hann-windowed series at each frequency but zero.
_POWER = f"""{E}, q AS (SELECT series_id, value AS x, row_number() OVER {W} - 1 AS i, count(*) OVER {P} AS n FROM e), l AS (SELECT series_id, avg(x) AS m, sum((i - (n - 1) / 2.0) * x) / sum(power(i - (n - 1) / 2.0, 2)) AS slope FROM q GROUP BY 1),
h AS (SELECT q.series_id, i, n, (x - m - slope * (i - (n - 1) / 2.0)) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM q JOIN l ON q.series_id = l.series_id), k AS (SELECT series_id, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT series_id, n FROM h)),
p AS (SELECT k.series_id, k.k, any_value(k.n) AS n, power(sum(y * cos(2 * pi() * ((k.k * i) % k.n) / k.n)), 2) + power(sum(y * sin(2 * pi() * ((k.k * i) % k.n) / k.n)), 2) AS p FROM k JOIN h ON k.series_id = h.series_id GROUP BY 1, 2)"""
add("periodogram", events, structure.periodogram, f"WITH {_POWER} SELECT series_id, k, round(n / k, 6) + 0.0 AS period, round(p, 6) + 0.0 AS power FROM p")
for _m in ("combined", "periodogram", "acf"):
    add(f"seasonality_{_m}", events, lambda d, m=_m: structure.seasonality(d, m).withColumn("candidates", F.to_json("candidates")))
add("seasonality_test_period", events, lambda d: structure.test_period(d, 24))

# Anomalies
_C24 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"
add(
    "anomaly_rolling_z", events, lambda d: ev.rolling_z(d, 24),
    f"WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, CASE WHEN count(value) {_C24} >= 12 AND stddev_samp(value) {_C24} > 0 THEN abs(value - avg(value) {_C24}) / stddev_samp(value) {_C24} END AS z FROM e) SELECT series_id, {STAMP}, pos, round(value, 6) + 0.0 AS value, coalesce(z > 3, false) AS mask, round(CASE WHEN z > 3 THEN least(1, (z - 3) / 3) ELSE 0 END, 6) + 0.0 AS score FROM q",
)
add(
    "anomaly_rolling_iqr", events, lambda d: ev.rolling_iqr(d, 24, k=1.5),
    f"WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(value) {_C24} AS n, quantile_cont(value, 0.25) {_C24} AS a, quantile_cont(value, 0.75) {_C24} AS b FROM e), r AS (SELECT *, CASE WHEN n >= 12 THEN greatest(a - 1.5 * (b - a) - value, value - b - 1.5 * (b - a)) END AS x, 4 * (b - a) + 1e-10 AS w FROM q) SELECT series_id, {STAMP}, pos, round(value, 6) + 0.0 AS value, coalesce(x > 0, false) AS mask, round(CASE WHEN x > 0 THEN least(1, x / w) ELSE 0 END, 6) + 0.0 AS score FROM r",
)
for _m in ("iqr", "mad", "z"):
    add(f"anomaly_stl_{_m}", events, lambda d, m=_m: ev.stl_residual(d, 24, m))
add("anomaly_gesd", events, ev.gesd)
add("anomaly_removed", events, lambda d: ev.remove(ev.rolling_z(d, 24)), f"WITH {E}, q AS (SELECT *, CASE WHEN count(value) {_C24} >= 12 AND stddev_samp(value) {_C24} > 0 THEN abs(value - avg(value) {_C24}) / stddev_samp(value) {_C24} END AS z FROM e) SELECT series_id, {STAMP}, CASE WHEN z > 3 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM q")
add("anomaly_labels", events, lambda d: ev.label(ev.rolling_z(d, 24)), f"WITH {E}, q AS (SELECT *, CASE WHEN count(value) {_C24} >= 12 AND stddev_samp(value) {_C24} > 0 THEN abs(value - avg(value) {_C24}) / stddev_samp(value) {_C24} END AS z FROM e) SELECT series_id || '_anomaly_label' AS series_id, {STAMP}, CASE WHEN z > 3 THEN 1.0 ELSE 0.0 END AS value FROM q")

# Changepoints
add(
    "cusum", events, lambda d: ev.cusum(d).where("is_cp").select("series_id", "ts", "pos"),
    f"""WITH RECURSIVE {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, value - lag(value) OVER {W} AS dv FROM e), m AS (SELECT series_id, avg(value) AS mu, stddev_samp(dv) / sqrt(2) AS sigma FROM q GROUP BY 1),
    x AS (SELECT q.series_id, ts, pos, value - mu AS c, sigma FROM q JOIN m ON q.series_id = m.series_id), f AS (SELECT series_id, ts, pos, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS hit FROM x WHERE pos = 0 UNION ALL
    SELECT x.series_id, x.ts, x.pos, greatest(0, CASE WHEN hit THEN 0 ELSE up END + c - 0.5 * sigma), greatest(0, CASE WHEN hit THEN 0 ELSE down END - c - 0.5 * sigma), greatest(greatest(0, CASE WHEN hit THEN 0 ELSE up END + c - 0.5 * sigma), greatest(0, CASE WHEN hit THEN 0 ELSE down END - c - 0.5 * sigma)) > 5 * sigma
    FROM f JOIN x ON x.series_id = f.series_id AND x.pos = f.pos + 1) SELECT series_id, {STAMP}, pos FROM f WHERE hit""",
)
_PAST = "OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
add(
    "cusum_without_reset", orders, ev.cusum_without_reset,
    f"""WITH {O}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, value - lag(value) OVER {W} AS dv, value - avg(value) OVER {P} AS c FROM o), x AS (SELECT *, stddev_samp(dv) OVER {P} / sqrt(2) AS g FROM q),
    y AS (SELECT *, sum(CASE WHEN pos = 0 THEN 0 ELSE c - 0.5 * g END) {_PAST} AS u, sum(CASE WHEN pos = 0 THEN 0 ELSE -c - 0.5 * g END) {_PAST} AS w FROM x) SELECT series_id, {STAMP}, pos, round(value, 2) + 0.0 AS value, round(u - least(0, min(u) {_PAST}), 2) + 0.0 AS s_up, round(w - least(0, min(w) {_PAST}), 2) + 0.0 AS s_down FROM y""", 2,
)
_GAIN = "power(t.s - x.s, 2) / (t.pos - g.a) + power(y.s - t.s, 2) / (g.b - t.pos) - power(y.s - x.s, 2) / (g.b - g.a)"
add(
    "split_gains", events, lambda d: ev.split_gains(d).select("series_id", "ts", "pos", "score"),
    f"""WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n, value - avg(value) OVER {P} AS c FROM e), x AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, sum(c * c) OVER {P} AS t FROM q)
    SELECT series_id, {STAMP}, pos, round((l * l / pos + l * l / (n - pos)) / t, 6) + 0.0 AS score FROM x WHERE pos >= 10 AND pos <= n - 10""",
)
add(
    "binary_segmentation_positions", events, lambda d: ev.binary_segmentation(d, penalty=2.0).where("is_cp").select("series_id", "ts", "pos"),
    f"""WITH RECURSIVE {E}, q AS (SELECT series_id, ts, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n, value - avg(value) OVER {P} AS c FROM e), t AS (SELECT series_id, ts, pos, n, coalesce(sum(c) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q),
    ends AS (SELECT series_id, pos, s FROM t UNION ALL SELECT series_id, max(n), 0.0 FROM t GROUP BY 1), g AS (SELECT series_id, CAST(0 AS BIGINT) AS a, max(n) AS b, CAST(NULL AS BIGINT) AS cut FROM t GROUP BY 1 UNION ALL
    SELECT series_id, unnest([a, best]) AS a, unnest([best, b]) AS b, best AS cut FROM (SELECT g.series_id, g.a, g.b, arg_max(t.pos, {_GAIN}) AS best, max({_GAIN}) AS gain FROM g JOIN t ON t.series_id = g.series_id AND t.pos BETWEEN g.a + 10 AND g.b - 10 JOIN ends x ON x.series_id = g.series_id AND x.pos = g.a JOIN ends y ON y.series_id = g.series_id AND y.pos = g.b GROUP BY 1, 2, 3) WHERE gain > 2.0)
    SELECT DISTINCT t.series_id, strftime(t.ts, '%Y-%m-%d %H:%M:%S') AS ts, t.pos FROM g JOIN t ON t.series_id = g.series_id AND t.pos = g.cut""",
)
add("binary_segmentation", orders, lambda d: ev.binary_segmentation(d, penalty=1e9).where("is_cp"))
add(
    "variance_ratio_statistic", orders, ev.variance_ratio_statistic,
    f"""WITH {O}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n, greatest(var_samp(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 1e-12) AS a, greatest(var_samp(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), 1e-12) AS b FROM o)
    SELECT series_id, {STAMP}, pos, round(value, 6) + 0.0 AS value, CASE WHEN pos >= 30 AND pos < n - 30 THEN round(greatest(a, b) / least(a, b), 6) END AS f_ratio FROM q""",
)
add("variance_ratio", orders, ev.variance_ratio)
add(
    "segments", events, lambda d: ev.segments(ev.rolling_z(d, 24).withColumnRenamed("mask", "is_cp")),
    f"""WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, CASE WHEN count(value) {_C24} >= 12 AND stddev_samp(value) {_C24} > 0 THEN abs(value - avg(value) {_C24}) / stddev_samp(value) {_C24} END AS z FROM e),
    g AS (SELECT *, CAST(sum(CASE WHEN z > 3 AND pos > 0 THEN 1 ELSE 0 END) {_PAST} AS BIGINT) AS segment FROM q) SELECT series_id, segment, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_obs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM g GROUP BY 1, 2""",
)

# Features
_T = "2 * pi() *"
add(
    "features_temporal", events, features.temporal,
    f"""WITH {E}, q AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER {P}) / 86400e6 AS d FROM e) SELECT series_id, {STAMP}, year(ts) AS year, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS dayofweek, hour(ts) AS hour, quarter(ts) AS quarter, week(ts) AS weekofyear, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend, CASE WHEN day(ts) = 1 THEN 1.0 ELSE 0.0 END AS is_month_start, CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 1.0 ELSE 0.0 END AS is_month_end,
    round(sin({_T} (month(ts) - 1) / 12), 6) + 0.0 AS month_sin, round(cos({_T} (month(ts) - 1) / 12), 6) + 0.0 AS month_cos, round(sin({_T} (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos({_T} (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_cos, round(sin({_T} hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos({_T} hour(ts) / 24), 6) + 0.0 AS hour_cos,
    round(d, 6) + 0.0 AS days_since_start, round(d / max(d) OVER {P}, 6) + 0.0 AS time_norm FROM q""",
)
add(
    "features_statistical", events_spine, features.statistical,
    f"""WITH {S}, v AS (SELECT series_id, ts, value, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n, value - lag(value) OVER {W} AS d, lead(value) OVER {W} - value AS e, value - avg(value) OVER {P} AS c FROM s WHERE value IS NOT NULL), w AS (SELECT *, lag(c) OVER {W} AS c1 FROM v), t AS ({_TRIM.format(k="greatest(1, floor(n * 0.05))")})
    SELECT w.series_id, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(var_samp(value), 5) AS var, round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis, round(min(value), 5) AS min, round(max(value), 5) AS max, round(max(value) - min(value), 5) AS range, round(median(value), 5) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr, round(mad(value), 5) AS mad, round(stddev_samp(value) / abs(avg(value)), 5) AS cv, round(max(tm), 5) AS trimmed_mean,
    round(quantile_cont(value, 0.05), 5) AS q05, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.75), 5) AS q75, round(quantile_cont(value, 0.95), 5) AS q95, round(count(*) FILTER (WHERE sign(d) <> sign(e)) / (max(n) - 2), 5) AS turning_points_ratio, round(count(*) FILTER (WHERE c * c1 < 0) / (max(n) - 1), 5) AS mean_crossing_rate, round(count(*) FILTER (WHERE d = 0) / (max(n) - 1), 5) + 0.0 AS flatness_ratio,
    round(sum(c * c1) / sum(c * c), 5) + 0.0 AS lag1_acf, round(regr_slope(value, pos), 5) + 0.0 AS linear_slope, round(regr_r2(value, pos), 5) + 0.0 AS linear_r2, CAST(count(*) FILTER (WHERE d > 0 AND e < 0) AS DOUBLE) AS n_peaks, CAST(count(*) FILTER (WHERE d < 0 AND e > 0) AS DOUBLE) AS n_troughs FROM w JOIN t ON w.series_id = t.series_id GROUP BY 1""", 5,
)
add(
    "features_entropy", events, features.entropies,
    f"""WITH {E}, q AS (SELECT series_id, row_number() OVER {W} AS i, count(*) OVER {P} AS n, 0.2 * stddev_samp(value) OVER {P} AS r, value AS v0, lead(value) OVER {W} AS v1, lead(value, 2) OVER {W} AS v2 FROM e),
    d AS (SELECT a.series_id, a.i, a.n, a.r, a.i = b.i AS own, b.i AS j, greatest(abs(a.v0 - b.v0), abs(a.v1 - b.v1)) AS two, greatest(abs(a.v0 - b.v0), abs(a.v1 - b.v1), abs(a.v2 - b.v2)) AS three, b.v1 IS NOT NULL AND a.v1 IS NOT NULL AS has2, b.v2 IS NOT NULL AND a.v2 IS NOT NULL AS has3 FROM q a JOIN q b ON a.series_id = b.series_id),
    c AS (SELECT series_id, i, max(n) AS n, ln(count(*) FILTER (WHERE has2 AND two <= r) / nullif(count(*) FILTER (WHERE has2), 0)) AS l2, ln(count(*) FILTER (WHERE has3 AND three <= r) / nullif(count(*) FILTER (WHERE has3), 0)) AS l3, count(*) FILTER (WHERE has3 AND NOT own AND two < r) AS b, count(*) FILTER (WHERE has3 AND NOT own AND three < r) AS a FROM d GROUP BY 1, 2)
    SELECT series_id, CASE WHEN max(n) <= 2000 THEN round(abs(avg(l2) - avg(l3)), 6) + 0.0 END AS approx_entropy, CASE WHEN max(n) > 500 OR (sum(b) > 0 AND sum(a) = 0) THEN NULL WHEN sum(b) = 0 THEN 0.0 ELSE round(-ln(sum(a) / sum(b)), 6) + 0.0 END AS sample_entropy FROM c GROUP BY 1""",
)
add(
    "features_spectral", events, features.spectral,
    f"""WITH {_POWER}, s AS (SELECT *, k / n AS f, count(*) OVER (PARTITION BY series_id) AS m, sum(p) OVER (PARTITION BY series_id) AS total, sum(p) OVER (PARTITION BY series_id ORDER BY k) AS run, lag(p) OVER (PARTITION BY series_id ORDER BY k) AS before, lead(p) OVER (PARTITION BY series_id ORDER BY k) AS after FROM p), c AS (SELECT series_id, sum(f * p) / max(total) AS centre FROM s GROUP BY 1)
    SELECT s.series_id, round(max(total), 6) + 0.0 AS total_power, {', '.join(f"round(sum(p) FILTER (WHERE k > {i} * m // 3 AND k <= {i + 1} * m // 3), 6) + 0.0 AS band_power_{i}" for i in range(3))}, round(max(centre), 6) + 0.0 AS spectral_centroid, round(sqrt(sum(power(f - centre, 2) * p) / max(total)), 6) + 0.0 AS spectral_bandwidth,
    round(min(f) FILTER (WHERE run >= 0.5 * total), 6) + 0.0 AS spectral_rolloff_50, round(min(f) FILTER (WHERE run >= 0.85 * total), 6) + 0.0 AS spectral_rolloff_85, round(-sum(p / total * ln(p / total)) / ln(max(m)), 6) + 0.0 AS spectral_entropy, round(exp(avg(ln(p + 1e-12))) / avg(p), 6) + 0.0 AS spectral_flatness,
    round(arg_max(f, p), 6) + 0.0 AS dominant_freq, round(1 / arg_max(f, p), 6) + 0.0 AS dominant_period, CAST(count(*) FILTER (WHERE p > before AND p > after) AS DOUBLE) AS n_spectral_peaks FROM s JOIN c ON s.series_id = c.series_id GROUP BY 1""",
)

# Forecastability and leakage
add("forecastability", events, forecast.forecastability)


def _with_features(d):
    return d.withColumn("copy", 2 * F.col("value") + 1).withColumn("future", F.lag("value", 2).over(fr.along())).withColumn("weekday", F.weekday("ts").cast("double"))


_FEATS = f"{O}, x AS (SELECT *, row_number() OVER {W} AS i, 2 * value + 1 AS copy, lag(value, 2) OVER {W} AS future, CAST(isodow(ts) - 1 AS DOUBLE) AS weekday FROM o), u AS (SELECT series_id, i, value, unnest(['copy', 'future', 'weekday']) AS feature, unnest([copy, future, weekday]) AS x FROM x), k AS (SELECT unnest(range(-3, 4)) AS lag)"
add("leakage_correlations", orders, lambda d: forecast.lagged_correlations(_with_features(d), ["copy", "future", "weekday"], 3), f"WITH {_FEATS} SELECT u.series_id, feature, lag, round(corr(u.x, y.value), 6) + 0.0 AS r FROM u CROSS JOIN k JOIN o2 y ON y.series_id = u.series_id AND y.i = u.i + lag WHERE u.x IS NOT NULL GROUP BY 1, 2, 3".replace(", k AS (", ", o2 AS (SELECT series_id, i, value FROM x), k AS ("))
add(
    "leakage", orders, lambda d: forecast.leakage(_with_features(d), ["copy", "future", "weekday"], 3),
    f"""WITH {_FEATS}, r AS (SELECT u.series_id, feature, lag, corr(u.x, y.value) AS r FROM u CROSS JOIN k JOIN x y ON y.series_id = u.series_id AND y.i = u.i + lag WHERE u.x IS NOT NULL GROUP BY 1, 2, 3),
    m AS (SELECT series_id, feature, max(r) FILTER (WHERE lag = 0) AS c0, first(lag ORDER BY round(abs(r), 12) DESC, lag) AS peak, first(r ORDER BY round(abs(r), 12) DESC, lag) AS top FROM r GROUP BY 1, 2)
    SELECT series_id, feature, round(c0, 6) + 0.0 AS corr_lag0, peak AS peak_lag, abs(c0) >= 0.95 AS target_leak, peak > 0 AND abs(top) > abs(c0) + 0.05 AS temporal_leak FROM m""",
)

# Plot data and reports
add("plot_series", events, lambda d: plotdata.series_line(d, 24), f"WITH {E} SELECT series_id, {STAMP}, round(value, 9) + 0.0 AS value, CASE WHEN count(value) OVER w = 24 THEN round(avg(value) OVER w, 9) + 0.0 END AS rolling_mean FROM e WINDOW w AS (PARTITION BY series_id ORDER BY e.ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", 9)
add("plot_seasonal_subseries", orders, lambda d: plotdata.seasonal_subseries(d, 7), f"WITH {O}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM o) SELECT series_id, pos % 7 AS phase, pos // 7 AS cycle, round(value, 4) + 0.0 AS value, round(avg(value) OVER (PARTITION BY series_id, pos % 7), 4) + 0.0 AS phase_mean FROM q", 4)
add("plot_lag", orders, plotdata.lag_pairs, f"WITH {O}, k AS (SELECT unnest([1, 2, 7]) AS lag), q AS (SELECT *, row_number() OVER {W} AS i FROM o) SELECT a.series_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, lag, round(b.value, 4) + 0.0 AS x, round(a.value, 4) + 0.0 AS y FROM q a CROSS JOIN k JOIN q b ON a.series_id = b.series_id AND b.i = a.i - lag", 4)
add("plot_calendar_heatmap", orders, plotdata.calendar_heatmap, f"WITH {O} SELECT series_id, year(ts) AS year, week(ts) AS week, isodow(ts) - 1 AS dow, round(avg(value), 4) + 0.0 AS mean FROM o GROUP BY 1, 2, 3, 4", 4)
add("plot_month_boxplots", orders, plotdata.boxplots, f"WITH {O} SELECT series_id, month(ts) AS box, count(*) AS n, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max FROM o GROUP BY 1, 2", 4)
add("plot_annual_boxplots", orders, lambda d: plotdata.boxplots(d, F.year("ts")), f"WITH {O} SELECT series_id, year(ts) AS box, count(*) AS n, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max FROM o GROUP BY 1, 2", 4)
add(
    "plot_density_ridge", orders, lambda d: plotdata.density(d, F.year("ts")).withColumn("density", F.col("density") * 1e6),
    f"""WITH {O}, m AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM o GROUP BY 1), b AS (SELECT series_id, year(ts) AS box, count(*) AS n, stddev_samp(value) * power(count(*), -0.2) AS h FROM o GROUP BY 1, 2 HAVING count(*) >= 3), g AS (SELECT b.*, lo, hi, unnest(range(300)) AS i FROM b JOIN m ON b.series_id = m.series_id), p AS (SELECT *, lo + (hi - lo) * i / 299 AS x FROM g)
    SELECT p.series_id, box, i, round(x, 4) + 0.0 AS x, round(1e6 * sum(exp(-0.5 * power((x - value) / h, 2))) / (n * h * sqrt(2 * pi())), 4) + 0.0 AS density FROM p JOIN o ON o.series_id = p.series_id AND year(o.ts) = box GROUP BY p.series_id, box, i, x, n, h""", 4,
)
add(
    "plot_distribution_curves", events, plotdata.distribution_curves,
    f"""WITH {E}, b AS (SELECT series_id, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd, stddev_samp(value) * power(count(*), -0.2) AS h FROM e GROUP BY 1), p AS (SELECT *, lo + (hi - lo) * i / 299 AS x FROM (SELECT *, unnest(range(300)) AS i FROM b))
    SELECT p.series_id, i, round(x, 6) + 0.0 AS x, round(sum(exp(-0.5 * power((x - value) / h, 2))) / (n * h * sqrt(2 * pi())), 6) + 0.0 AS density, round(any_value(exp(-0.5 * power((x - mu) / sd, 2)) / (sd * sqrt(2 * pi()))), 6) + 0.0 AS normal FROM p JOIN e ON e.series_id = p.series_id GROUP BY p.series_id, i, x, n, h""",
)
add("plot_distribution", events, plotdata.histogram, f"WITH {E}, b AS (SELECT *, min(value) OVER {P} AS lo, max(value) OVER {P} AS hi FROM e), c AS (SELECT *, least(29, CAST(floor((value - lo) / (hi - lo) * 30) AS BIGINT)) AS bin FROM b) SELECT series_id, bin, round(lo + (hi - lo) * bin / 30, 6) + 0.0 AS left, count(*) AS n FROM c GROUP BY series_id, lo, hi, bin")
add("plot_qq", events, plotdata.qq)
add("plot_rolling_stats", orders, lambda d: plotdata.rolling_stats(d, 30), f"WITH {O} SELECT series_id, {STAMP}, round(value, 4) + 0.0 AS value, CASE WHEN count(value) OVER w = 30 THEN round(avg(value) OVER w, 4) + 0.0 END AS rolling_mean, CASE WHEN count(value) OVER w = 30 THEN round(stddev_samp(value) OVER w, 4) + 0.0 END AS rolling_std FROM o WINDOW w AS (PARTITION BY series_id ORDER BY o.ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", 4)
add(
    "plot_acf_heatmap", events, plotdata.acf_heatmap,
    f"""WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n FROM e), z AS (SELECT *, least(n, greatest(84, n // 5)) AS size FROM q), y AS (SELECT *, greatest(1, (n - size) // 50) AS step, least(40, size // 2 - 1) AS cap FROM z WHERE size >= 44),
    v AS (SELECT DISTINCT series_id, size, step, cap, unnest(range((n - size) // step + 1)) AS win FROM y), c AS (SELECT v.series_id, win, v.cap, pos, value - avg(value) OVER (PARTITION BY v.series_id, win) AS c FROM v JOIN y ON y.series_id = v.series_id AND pos >= win * v.step AND pos < win * v.step + v.size),
    d AS (SELECT series_id, win, sum(c * c) AS p0 FROM c GROUP BY 1, 2 HAVING sum(c * c) > 0) SELECT a.series_id, a.win AS "window", b.pos - a.pos AS lag, round(sum(a.c * b.c) / max(p0), 6) + 0.0 AS acf FROM c a JOIN c b ON a.series_id = b.series_id AND a.win = b.win AND b.pos - a.pos BETWEEN 0 AND a.cap JOIN d ON d.series_id = a.series_id AND d.win = a.win GROUP BY 1, 2, 3""",
)
add("plot_strength_radar", events, lambda d: plotdata.strength_radar(structure.classical(d, 24)), f"WITH {_PARTS} SELECT series_id, round(1 - var_pop(residual) / var_pop(observed), 6) + 0.0 AS signal, round(var_pop(trend) / var_pop(observed), 6) + 0.0 AS smoothness, round(var_pop(seasonal) / var_pop(observed), 6) + 0.0 AS seasonal_share FROM p WHERE residual IS NOT NULL AND trend IS NOT NULL GROUP BY 1")
add("plot_residuals", events, lambda d: plotdata.residuals(structure.classical(d, 24)), f"WITH {_PARTS} SELECT series_id, ts, round(residual, 6) + 0.0 AS value FROM p WHERE residual IS NOT NULL")
add("plot_polar_seasonal", events, lambda d: plotdata.polar(d, 24), f"WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM e), m AS (SELECT series_id, pos % 24 AS phase, avg(value) AS mean FROM q GROUP BY 1, 2) SELECT series_id, phase, round(phase * 2 * pi() / 24, 6) + 0.0 AS angle, round(mean, 6) + 0.0 AS mean, round((mean - min(mean) OVER {P}) / (max(mean) OVER {P} - min(mean) OVER {P}), 6) + 0.0 AS radius FROM m")
add("plot_season_heatmap", events, lambda d: plotdata.season_heatmap(d, 24), f"WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM e) SELECT series_id, pos // 24 AS cycle, pos % 24 AS phase, round(avg(value), 9) + 0.0 AS mean FROM q GROUP BY 1, 2, 3", 9)
add("plot_anomaly_agreement", events, lambda d: plotdata.agreement({"rolling_z": ev.rolling_z(d, 24), "rolling_iqr": ev.rolling_iqr(d, 24), "gesd": ev.gesd(d)}))
add(
    "plot_segment_means", events, lambda d: plotdata.segment_means(ev.rolling_z(d, 24).withColumnRenamed("mask", "is_cp")),
    f"""WITH {E}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, CASE WHEN count(value) {_C24} >= 12 AND stddev_samp(value) {_C24} > 0 THEN abs(value - avg(value) {_C24}) / stddev_samp(value) {_C24} END AS z FROM e),
    g AS (SELECT *, CAST(sum(CASE WHEN z > 3 AND pos > 0 THEN 1 ELSE 0 END) {_PAST} AS BIGINT) AS segment FROM q) SELECT series_id, {STAMP}, round(value, 6) + 0.0 AS value, segment, round(avg(value) OVER (PARTITION BY series_id, segment), 6) + 0.0 AS segment_mean FROM g""",
)
add("plot_missing_map", events_spine, plotdata.missing_map, f"WITH {S}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER {P} AS n FROM s) SELECT series_id, pos // greatest(1, n // 200) AS chunk, strftime(min(q.ts), '%Y-%m-%d %H:%M:%S') AS ts, CAST(max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM q GROUP BY 1, 2")
add("report_scorecard", events, report.scorecard)
