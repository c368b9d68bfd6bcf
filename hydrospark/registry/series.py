"""Time-series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrospark.operators import timeseries as ts
from hydrospark.registry import query
from hydrospark.registry.tables import (
    G_SQL, GAUGE_KEY, H_SQL, R_SQL, history, plain_times, readings, rounded, stage,
)

# A small chunk makes the test tables cross many cuts; production keeps the default.
CHUNK = 120


def rolling_max_of_hourly_max(spark, sf_dir):
    """Hourly maximum per gauge, gaps filled, then the trailing day's maximum."""
    hourly = ts.bucket_max(readings(spark, sf_dir), keys=GAUGE_KEY)
    filled = ts.fill_forward(hourly, keys=GAUGE_KEY)
    return plain_times(ts.rolling(filled, [24], ["max"], keys=GAUGE_KEY, name="stage", dense=True))


query("hourly_rolling_max", f"""
WITH {R_SQL},
m AS (SELECT entity_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM r GROUP BY 1, 2),
sp AS (SELECT entity_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM m GROUP BY 1),
f AS (SELECT entity_id, ts, last_value(m.value IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts) AS value
      FROM sp LEFT JOIN m USING (entity_id, ts))
SELECT entity_id, ts, value,
       max(value) OVER (PARTITION BY entity_id ORDER BY ts ROWS 23 PRECEDING) AS stage__roll24_max
FROM f""")(rolling_max_of_hourly_max)


@query("hourly_max", f"""WITH {H_SQL}
SELECT entity_type, entity_id, metric, date_trunc('hour', ts) AS ts, max(value) AS value
FROM h GROUP BY ALL""")
def hourly_max(spark, sf_dir):
    return plain_times(ts.bucket_max(history(spark, sf_dir)))


@query("daily_max", f"""WITH {H_SQL}
SELECT entity_type, entity_id, metric, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, max(value) AS value
FROM h GROUP BY ALL""")
def daily_max(spark, sf_dir):
    return plain_times(ts.bucket_max(history(spark, sf_dir), ts.DAY_S))


@query("daily_mean", f"""WITH {H_SQL}
SELECT entity_type, entity_id, metric, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(avg(value) + 1e-9, 6) AS value
FROM h GROUP BY ALL""")
def daily_mean(spark, sf_dir):
    return rounded(ts.bucket_mean(history(spark, sf_dir)), nudge=1e-9)


@query("hourly_last_locf", f"WITH {G_SQL} SELECT entity_id, ts, value FROM g")
def hourly_last_locf(spark, sf_dir):
    return plain_times(stage(spark, sf_dir))


@query("regular_series", f"""WITH {H_SQL},
b AS (SELECT *, CASE source WHEN 'usgs_iv' THEN 1 WHEN 'snapshot' THEN 2 ELSE 3 END AS rk FROM h),
k AS (SELECT *, min(rk) OVER (PARTITION BY entity_id, metric) AS best FROM b),
v AS (SELECT entity_type, entity_id, metric, date_trunc('hour', ts) AS ts,
             arg_max(value, (epoch_us(ts), seq)) AS value FROM k WHERE rk = best GROUP BY ALL),
sp AS (SELECT entity_type, entity_id, metric, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
       FROM v GROUP BY 1, 2, 3)
SELECT entity_type, entity_id, metric, ts,
       last_value(v.value IGNORE NULLS) OVER (PARTITION BY entity_id, metric ORDER BY ts) AS value
FROM sp LEFT JOIN v USING (entity_type, entity_id, metric, ts)""")
def regular_series(spark, sf_dir):
    return plain_times(ts.regular(history(spark, sf_dir), tie="seq"))


@query("best_source", f"""WITH {H_SQL},
b AS (SELECT *, CASE source WHEN 'usgs_iv' THEN 1 WHEN 'snapshot' THEN 2 ELSE 3 END AS rk FROM h)
SELECT ts, source, entity_type, entity_id, metric, value, seq FROM b
QUALIFY rk = min(rk) OVER (PARTITION BY entity_type, entity_id, metric)""")
def best_source(spark, sf_dir):
    return plain_times(ts.best_source(history(spark, sf_dir)))


@query("first_metric", f"""WITH {H_SQL},
a AS (SELECT *, CASE metric WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 END AS rk,
             CASE WHEN metric IN ('purchase', 'signup', 'view') THEN 'precip'
                  WHEN metric = 'error' THEN 'soil_top' END AS al
      FROM h WHERE metric <> 'click')
SELECT ts, source, entity_type, entity_id, al AS metric, value, seq FROM a
QUALIFY rk = min(rk) OVER (PARTITION BY entity_type, entity_id, al)""")
def first_metric(spark, sf_dir):
    aliases = {"precip": ["purchase", "signup", "view"], "soil_top": ["error"]}
    return plain_times(ts.first_metric(history(spark, sf_dir), aliases))


LAGS, ROLLS, HORIZONS = (1, 3, 6, 12, 24), (3, 6, 12, 24, 72), (6, 24, 72)

_LAGS_SQL = ", ".join(f"lag(value, {k}) OVER w AS x__lag{k}, round(value - lag(value, {k}) OVER w, 6) AS x__delta{k}"
                      for k in LAGS)


@query("lag_delta", f"""WITH {G_SQL}
SELECT entity_id, ts, value, {_LAGS_SQL}
FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY ts)""")
def lag_delta(spark, sf_dir):
    lagged = ts.lags(stage(spark, sf_dir), LAGS, keys=GAUGE_KEY, chunk_rows=CHUNK, dense=True)
    return rounded(ts.deltas(lagged, LAGS, keys=GAUGE_KEY, chunk_rows=CHUNK, dense=True))


def _rolls_sql(source: str) -> str:
    columns = ", ".join(
        f"round(avg(value) OVER w{k} + 1e-9, 6) AS x__roll{k}_mean, max(value) OVER w{k} AS x__roll{k}_max, "
        f"min(value) OVER w{k} AS x__roll{k}_min, round(stddev_samp(value) OVER w{k} + 1e-9, 6) AS x__roll{k}_std"
        for k in ROLLS)
    frames = ", ".join(f"w{k} AS (PARTITION BY entity_id ORDER BY ts ROWS {k - 1} PRECEDING)" for k in ROLLS)
    return f"SELECT entity_id, ts, value, {columns} FROM {source} WINDOW {frames}"


@query("rolling_stats", f"WITH {G_SQL} {_rolls_sql('g')}")
def rolling_stats(spark, sf_dir):
    return rounded(ts.rolling(stage(spark, sf_dir), ROLLS, keys=GAUGE_KEY,
                              chunk_rows=CHUNK, dense=True), nudge=1e-9)


def _gapped(spark, sf_dir):
    """Hourly maxima of every user's events: far fewer rows than hours, with holes of any length."""
    events = history(spark, sf_dir).select("entity_id", "ts", "value")
    return ts.bucket_max(events, keys=GAUGE_KEY)


_GAPPED_SQL = f"""WITH {H_SQL},
q AS (SELECT entity_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM h GROUP BY 1, 2)"""


@query("gapped_rolling", f"{_GAPPED_SQL} {_rolls_sql('q')}")
def gapped_rolling(spark, sf_dir):
    return rounded(ts.rolling(_gapped(spark, sf_dir), ROLLS, keys=GAUGE_KEY, chunk_rows=CHUNK),
                   nudge=1e-9)


@query("antecedent_index", f"""WITH {G_SQL},
n AS (SELECT entity_id, ts, value, row_number() OVER (PARTITION BY entity_id ORDER BY ts) AS i FROM g)
SELECT a.entity_id, a.ts, a.value,
       round(sum(CASE WHEN a.i - b.i < 14 THEN pow(0.85, a.i - b.i) * b.value ELSE 0 END) + 1e-9, 6) AS precip__api14_d85,
       round(sum(pow(0.99, a.i - b.i) * b.value) + 1e-9, 6) AS precip__api336_d99
FROM n a JOIN n b ON a.entity_id = b.entity_id AND b.i BETWEEN a.i - 335 AND a.i
GROUP BY 1, 2, 3""")
def antecedent_index(spark, sf_dir):
    short = ts.antecedent(stage(spark, sf_dir), 0.85, 14, keys=GAUGE_KEY, chunk_rows=CHUNK,
                          dense=True)
    return rounded(ts.antecedent(short, 0.99, 336, keys=GAUGE_KEY, dense=True), nudge=1e-9)


def _targets_sql(source: str) -> str:
    inner = ", ".join(
        f"CASE WHEN lead(1, {h - 1}) OVER w IS NOT NULL THEN max(value) OVER w{h} END AS m{h}, "
        f"lead(value, {h}) OVER w AS v{h}" for h in HORIZONS)
    frames = ", ".join(f"w{h} AS (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
                       for h in HORIZONS)
    outer = ", ".join(
        f"m{h} AS y_future_max_{h}h, round(m{h} - value, 6) AS y_future_rise_{h}h, v{h} AS y_future_val_{h}h, "
        f'CAST(m{h} >= 100 AS INTEGER) AS "y_peak_above_100.0_{h}h"' for h in HORIZONS)
    return (f"SELECT entity_id, ts, value, {outer} FROM (SELECT *, {inner} FROM {source} "
            f"WINDOW w AS (PARTITION BY entity_id ORDER BY ts), {frames})")


def _with_targets(df, dense):
    out = ts.targets(df, HORIZONS, [100.0], keys=GAUGE_KEY, chunk_rows=CHUNK, dense=dense)
    for h in HORIZONS:
        out = out.withColumn(f"y_future_rise_{h}h", F.round(f"y_future_rise_{h}h", 6) + 0.0)
    return plain_times(out)


@query("future_targets", f"WITH {G_SQL} {_targets_sql('g')}")
def future_targets(spark, sf_dir):
    return _with_targets(stage(spark, sf_dir), True)


@query("gapped_targets", f"{_GAPPED_SQL} {_targets_sql('q')}")
def gapped_targets(spark, sf_dir):
    return _with_targets(_gapped(spark, sf_dir), False)


@query("forward_backward_sums", f"""WITH {R_SQL},
d AS (SELECT entity_id, CAST(ts AS DATE) AS day, max(value) AS value FROM r GROUP BY 1, 2)
SELECT entity_id, day, value,
  round(sum(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS next_3d,
  round(sum(value) OVER (w ROWS 6 PRECEDING), 6) AS past_7d,
  round((value - lag(value) OVER w) / 24, 6) AS rate_ft_per_hr
FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY day)""")
def forward_backward_sums(spark, sf_dir):
    days = (readings(spark, sf_dir).groupBy("entity_id", F.to_date("ts").alias("day"))
            .agg(F.max("value").alias("value")))
    # One row per gauge and calendar day: a group is bounded by the calendar.
    w = Window.partitionBy("entity_id").orderBy("day")
    return rounded(days.withColumns({
        "next_3d": ts.forward_sum("value", 3, w), "past_7d": ts.past_sum("value", 7, w),
        "rate_ft_per_hr": ts.hourly_rate("value", w)}))


@query("max_window_total", f"""WITH {G_SQL},
f AS (SELECT *, sum(value) OVER w6 AS t6, count(*) OVER w6 AS n6
      FROM g WINDOW w6 AS (PARTITION BY entity_id ORDER BY ts ROWS 5 PRECEDING))
SELECT entity_id, round(coalesce(max(t6) FILTER (n6 = 6), sum(value)), 4) AS max_6, round(sum(value), 4) AS total,
       max(value) AS peak_value, CASE WHEN max(value) > 0 THEN arg_max(ts, (value, -epoch_us(ts))) END AS peak_ts
FROM f GROUP BY entity_id""")
def max_window_total(spark, sf_dir):
    return rounded(ts.largest_total(stage(spark, sf_dir), 6, keys=GAUGE_KEY, chunk_rows=CHUNK,
                                    dense=True), 4)


@query("cumulative_share", f"""WITH {R_SQL}
SELECT entity_id, ts, value, seq, round(sum(value) OVER w, 4) AS running,
       round(sum(value) OVER (PARTITION BY entity_id), 4) AS total,
       round(sum(value) OVER w / sum(value) OVER (PARTITION BY entity_id), 6) AS share
FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""")
def cumulative_share(spark, sf_dir):
    out = ts.cumulative_share(readings(spark, sf_dir), keys=GAUGE_KEY, order=["ts", "seq"],
                              span_s=5 * ts.DAY_S)
    return plain_times(out.select("entity_id", "ts", "value", "seq",
                                  F.round("running", 4).alias("running"),
                                  F.round("total", 4).alias("total"),
                                  F.round("share", 6).alias("share")))
