"""Gauge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions import stage as rules
from hydrospark.operators import gauges, timeseries
from hydrospark.registry import query
from hydrospark.registry.tables import R_SQL, plain_times, readings, rounded, table, values_sql

LEVELS = values_sql("lv", "site_id, action, minor, moderate, major, record",
                    [r[:6] for r in dims.FLOOD_STAGES])
# Every reading belongs to one of the published sites or to one of two sites without levels.
SITE_IDS = [r[0] for r in dims.FLOOD_STAGES] + ["99999998", "99999999"]
SITES_SQL = "[" + ", ".join(f"'{s}'" for s in SITE_IDS) + "]"
READING_SQL = f"""rd AS (
  SELECT event_id, ts, ({SITES_SQL})[1 + user_id % 26] AS site_id,
    CASE WHEN event_type <> 'error' THEN value / 4 END AS stage_ft,
    CASE WHEN event_type IN ('error', 'view') THEN value END AS pool_elevation_ft,
    CASE WHEN user_id % 26 IN (1, 6, 24) THEN 'reservoir' ELSE 'statewide' END AS role
  FROM events)"""


def site_readings(spark, sf_dir):
    sites = F.array(*[F.lit(s) for s in SITE_IDS])
    at = (F.col("user_id") % 26).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.element_at(sites, at + 1).alias("site_id"),
        F.when(F.col("event_type") != "error", F.col("value") / 4).alias("stage_ft"),
        F.when(F.col("event_type").isin("error", "view"), F.col("value")).alias("pool_elevation_ft"),
        F.when(at.isin(1, 6, 24), "reservoir").otherwise("statewide").alias("role"))


CATEGORY_SQL = """CASE WHEN coalesce(stage_ft, pool_elevation_ft) IS NULL THEN 'unknown'
    WHEN lv.site_id IS NULL THEN CASE WHEN role = 'reservoir' OR stage_ft IS NULL THEN 'pool stage' ELSE 'no thresholds' END
    WHEN coalesce(stage_ft, pool_elevation_ft) >= major THEN 'MAJOR FLOOD'
    WHEN coalesce(stage_ft, pool_elevation_ft) >= moderate THEN 'MODERATE FLOOD'
    WHEN coalesce(stage_ft, pool_elevation_ft) >= minor THEN 'MINOR FLOOD'
    WHEN coalesce(stage_ft, pool_elevation_ft) >= action THEN 'action stage' ELSE 'below action' END"""


@query("stage_category", f"""WITH {READING_SQL}, {LEVELS}
SELECT event_id, rd.site_id, {CATEGORY_SQL} AS flood_category,
  round(100 * stage_ft / nullif(minor, 0), 6) AS pct_to_minor, round(100 * stage_ft / nullif(major, 0), 6) AS pct_to_major,
  coalesce(stage_ft, pool_elevation_ft) AS display_ft,
  CASE WHEN stage_ft IS NULL AND pool_elevation_ft IS NOT NULL THEN 'ft pool elev' ELSE 'ft' END AS display_units
FROM rd LEFT JOIN lv ON rd.site_id = lv.site_id""")
def stage_category(spark, sf_dir):
    out = gauges.classify(site_readings(spark, sf_dir), dims.thresholds(spark))
    return out.select("event_id", "site_id", "flood_category",
                      F.round("pct_to_minor", 6).alias("pct_to_minor"),
                      F.round("pct_to_major", 6).alias("pct_to_major"), "display_ft",
                      "display_units")


@query("near_threshold_label", f"""WITH {READING_SQL}, {LEVELS}
SELECT event_id, rd.site_id, round(stage_ft, 1) AS threshold,
  CASE WHEN abs(action - round(stage_ft, 1)) < 0.01 THEN 'action' WHEN abs(minor - round(stage_ft, 1)) < 0.01 THEN 'minor'
       WHEN abs(moderate - round(stage_ft, 1)) < 0.01 THEN 'moderate' WHEN abs(major - round(stage_ft, 1)) < 0.01 THEN 'major'
       ELSE '' END AS level
FROM rd LEFT JOIN lv ON rd.site_id = lv.site_id WHERE stage_ft IS NOT NULL""")
def near_threshold_label(spark, sf_dir):
    rows = site_readings(spark, sf_dir).filter(F.col("stage_ft").isNotNull())
    out = gauges.near_level(rows.withColumn("threshold", F.round("stage_ft", 1)),
                            dims.thresholds(spark), "threshold")
    return out.select("event_id", "site_id", "threshold", "level")


RATE_SQL = f"""{R_SQL},
last12 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, value DESC) <= 12),
ra AS (SELECT entity_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, min(ts) AS first_ts,
         max(ts) AS last_ts, count(*) AS n,
         CASE WHEN count(*) >= 2 AND max(ts) > min(ts) THEN
           (arg_max(value, ts) - arg_min(value, ts)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE) END AS rate
       FROM last12 GROUP BY 1)"""


@query("rate_of_rise_eta", f"""WITH {RATE_SQL}
SELECT entity_id, first_value, last_value, first_ts, last_ts, n, round(rate, 6) AS rate_ft_per_hr,
  round(CASE WHEN rate > 0.05 THEN CASE WHEN last_value >= 100 THEN 0 ELSE (100 - last_value) / rate END END, 6) AS eta_100_hr
FROM ra""")
def rate_of_rise_eta(spark, sf_dir):
    rates = timeseries.recent_rate(readings(spark, sf_dir), keys=["entity_id"])
    eta = rules.eta_hours("last_value", F.lit(100.0), "rate_ft_per_hr")
    return rounded(rates.withColumn("eta_100_hr", eta))


@query("network_state", f"""WITH {READING_SQL}, {LEVELS},
latest AS (SELECT site_id, any_value(role) AS role, arg_max(stage_ft, ts) FILTER (stage_ft IS NOT NULL) AS stage_ft,
    arg_max(pool_elevation_ft, ts) FILTER (pool_elevation_ft IS NOT NULL) AS pool_elevation_ft, max(ts) AS timestamp
  FROM rd GROUP BY 1),
own AS (SELECT site_id, ts, CASE WHEN role = 'reservoir' THEN pool_elevation_ft ELSE stage_ft END AS v FROM rd),
tail AS (SELECT * FROM own WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ts DESC, v DESC) <= 12),
ra AS (SELECT site_id, CASE WHEN count(*) >= 2 THEN (arg_max(v, ts) - arg_min(v, ts))
        / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE) END AS rate FROM tail GROUP BY 1),
hist AS (SELECT site_id, least(count(*), 96) AS n_history FROM own WHERE v IS NOT NULL GROUP BY 1)
SELECT latest.site_id, role, stage_ft, pool_elevation_ft, timestamp, round(rate, 6) AS rate_ft_per_hr, n_history,
  {CATEGORY_SQL} AS flood_category,
  round(CASE WHEN role <> 'reservoir' AND rate > 0.05 THEN CASE WHEN stage_ft >= minor THEN 0 ELSE (minor - stage_ft) / rate END END, 6) AS eta_minor_hr,
  round(CASE WHEN role <> 'reservoir' AND rate > 0.05 THEN CASE WHEN stage_ft >= major THEN 0 ELSE (major - stage_ft) / rate END END, 6) AS eta_major_hr
FROM latest LEFT JOIN lv ON latest.site_id = lv.site_id LEFT JOIN ra ON ra.site_id = latest.site_id
LEFT JOIN hist ON hist.site_id = latest.site_id""")
def network_state(spark, sf_dir):
    rows = site_readings(spark, sf_dir)
    sites = rows.select("site_id", "role").distinct().select(
        "site_id", F.col("site_id").alias("label"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        "role")
    long = rows.select(F.col("site_id").alias("entity_id"), "ts", F.expr(
        "stack(2, 'stage_ft', stage_ft, 'pool_elevation_ft', pool_elevation_ft) AS (metric, value)"))
    out = gauges.network_state(long.filter(F.col("value").isNotNull()), sites,
                               dims.thresholds(spark))
    return rounded(out.select(
        "site_id", "role", "stage_ft", "pool_elevation_ft", "timestamp", "rate_ft_per_hr",
        F.size("history").cast("bigint").alias("n_history"), "flood_category", "eta_minor_hr",
        "eta_major_hr"))


ROLES = ["primary", "upstream", "tributary", "regional", "statewide", "reservoir"]


@query("network_counts", f"""
WITH n AS (SELECT c_custkey, {[*ROLES]!r}[1 + c_nationkey % 6] AS role FROM customer),
k AS (SELECT CASE WHEN role IN ('primary', 'upstream', 'headwaters', 'tributary') THEN 'french_broad'
             WHEN role = 'reservoir' THEN 'reservoirs' ELSE role END AS network FROM n)
SELECT coalesce(network, 'all') AS network, count(*) AS n FROM k GROUP BY ROLLUP (network)""")
def network_counts(spark, sf_dir):
    roles = F.array(*[F.lit(r) for r in ROLES])
    sites = table(spark, sf_dir, "customer").select(
        F.element_at(roles, F.col("c_nationkey") % 6 + 1).alias("role"))
    return gauges.network_counts(sites)


@query("month_percentile", f"""WITH {R_SQL},
cur AS (SELECT entity_id, arg_max(value, (epoch_us(ts), seq)) AS current_ft, CAST(month(max(ts)) AS INTEGER) AS month FROM r GROUP BY 1)
SELECT r.entity_id, current_ft, month, CASE WHEN count(*) >= 30 THEN
    (printf('%.1f', (count(*) FILTER (value <= current_ft) / count(*) * 100)::DOUBLE)::DOUBLE + 0.0::DOUBLE) END AS percentile
FROM r JOIN cur ON r.entity_id = cur.entity_id AND month(ts) = month GROUP BY 1, 2, 3""")
def month_percentile(spark, sf_dir):
    rows = readings(spark, sf_dir)
    current = rows.groupBy("entity_id").agg(
        F.max_by("value", F.struct("ts", "seq")).alias("current_ft"))
    return gauges.month_percentile(rows, current)


@query("stage_history", f"""WITH {READING_SQL}, {LEVELS},
v AS (SELECT site_id AS entity_id, event_id, ts, stage_ft AS value,
        CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rk FROM rd WHERE stage_ft IS NOT NULL),
b AS (SELECT * FROM v QUALIFY rk = min(rk) OVER (PARTITION BY entity_id)),
d AS (SELECT entity_id, CAST(ts AS DATE) AS day, max(value) AS ft FROM b GROUP BY 1, 2),
cr AS (SELECT entity_id, max(ft) AS peak_ft, max(ft) FILTER (day BETWEEN DATE '2024-01-12' AND DATE '2024-01-18') AS event_ft,
         arg_max(day, (ft, -epoch(day))) FILTER (day BETWEEN DATE '2024-01-12' AND DATE '2024-01-18') AS event_day
       FROM d GROUP BY 1),
tot AS (SELECT entity_id, count(*) AS n_observations, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day,
          arg_max(value, epoch_us(ts)) AS current_ft, month(max(ts)) AS mon FROM b GROUP BY 1),
pc AS (SELECT b.entity_id, CASE WHEN count(*) >= 30 THEN (printf('%.1f', (count(*) FILTER (value <= current_ft) / count(*) * 100)::DOUBLE)::DOUBLE + 0.0::DOUBLE) END AS percentile
       FROM b JOIN tot ON b.entity_id = tot.entity_id AND month(ts) = mon GROUP BY 1)
SELECT tot.entity_id, n_observations, first_day, last_day, peak_ft, event_ft, event_day, current_ft, record AS record_ft,
  CAST(mon AS INTEGER) AS month, percentile, round(greatest(peak_ft, coalesce(record, 0), current_ft) * 1.05, 6) AS axis_max,
  coalesce(record - event_ft > 1, false) AS daily_mean_series
FROM tot JOIN cr USING (entity_id) LEFT JOIN lv ON lv.site_id = tot.entity_id LEFT JOIN pc ON pc.entity_id = tot.entity_id""")
def stage_history(spark, sf_dir):
    source = (F.when(F.col("event_id") % 3 == 0, "usgs_iv").when(F.col("event_id") % 3 == 1, "snapshot")
              .otherwise("usgs_dv"))
    rows = site_readings(spark, sf_dir).filter(F.col("stage_ft").isNotNull()).select(
        F.col("site_id").alias("entity_id"), "ts", source.alias("source"),
        F.col("stage_ft").alias("value"))
    current = timeseries.best_source(rows, ["entity_id"]).groupBy("entity_id").agg(
        F.max_by("value", "ts").alias("current_ft"))
    out = gauges.stage_history(rows, current, dims.thresholds(spark), "2024-01-15")
    return out.withColumn("axis_max", F.round("axis_max", 6))


@query("year_starts", """
SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(min(l_shipdate) AS DATE) AS first_day
FROM lineitem GROUP BY 1, 2""")
def year_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("entity_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"))
    return gauges.year_starts(gauges.daily_peaks(rows))


# Customers as gauges of forests, nations as forests, parts as threshold rows.
@query("registry_checks", """
WITH g AS (SELECT CAST(c_custkey % 997 AS VARCHAR) AS site_id, c_mktsegment AS label,
    33.5::DOUBLE + (c_custkey % 41) * 0.1::DOUBLE AS lat, -84.5::DOUBLE + (c_custkey % 46) * 0.1::DOUBLE AS lon,
    CASE WHEN c_custkey % 500 = 0 THEN 'primary' ELSE 'regional' END AS role, c_nationkey AS forest FROM customer),
fo AS (SELECT n_nationkey AS forest, 34.0::DOUBLE + n_nationkey * 0.1::DOUBLE AS flat, -83.0::DOUBLE AS flon FROM nation),
th AS (SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_size > 5 THEN p_size::DOUBLE END AS action, 20.0::DOUBLE AS minor,
    (20 + p_partkey % 7 - 1)::DOUBLE AS moderate, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 26.0::DOUBLE END AS major FROM part)
SELECT 'duplicate_site' AS "check", site_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM g GROUP BY site_id HAVING count(*) > 1
UNION ALL SELECT 'primary_count', 'primary', CAST(count(*) FILTER (role = 'primary') AS VARCHAR) FROM g HAVING count(*) FILTER (role = 'primary') <> 1
UNION ALL SELECT 'thresholds_order', site_id, concat_ws(',', action, minor, moderate, major) FROM th
  WHERE list_filter([action, minor, moderate, major], lambda x: x IS NOT NULL)
     <> list_sort(list_filter([action, minor, moderate, major], lambda x: x IS NOT NULL))
UNION ALL SELECT 'forest_gauge_far', site_id, CAST(round(mi, 1) AS VARCHAR) FROM (
  SELECT site_id, 2 * 3958.7613::DOUBLE * asin(sqrt(pow(sin(radians((flat - lat) / 2)), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin(radians((flon - lon) / 2)), 2))) AS mi
  FROM g JOIN fo USING (forest)) WHERE mi >= 75
UNION ALL SELECT 'label_conflict', site_id, min(label) || ' / ' || max(label) FROM g GROUP BY site_id HAVING min(label) <> max(label)""")
def registry_checks(spark, sf_dir):
    key = F.col("c_custkey")
    sites = table(spark, sf_dir, "customer").select(
        (key % 997).cast("string").alias("site_id"), F.col("c_mktsegment").alias("label"),
        (F.lit(33.5) + (key % 41) * 0.1).alias("lat"), (F.lit(-84.5) + (key % 46) * 0.1).alias("lon"),
        F.when(key % 500 == 0, "primary").otherwise("regional").alias("role"),
        F.col("c_nationkey").alias("forest"))
    forests = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("forest"), (F.lit(34.0) + F.col("n_nationkey") * 0.1).alias("lat"),
        F.lit(-83.0).alias("lon"))
    part = F.col("p_partkey")
    levels = table(spark, sf_dir, "part").select(
        part.cast("string").alias("site_id"),
        F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("action"),
        F.lit(20.0).alias("minor"), (20 + part % 7 - 1).cast("double").alias("moderate"),
        F.when(part % 4 != 0, 26.0).alias("major"), F.lit(None).cast("double").alias("record"))
    return gauges.registry_checks(sites, sites, forests, levels)


@query("threshold_extract", """
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS returned_id,
    CASE WHEN p_size > 5 THEN p_size::DOUBLE ELSE -9999 END AS action, CASE WHEN p_partkey % 5 = 0 THEN -9999 ELSE 20.0::DOUBLE END AS minor,
    CASE WHEN p_partkey % 5 = 0 THEN -9999 ELSE (20 + p_partkey % 7 - 1)::DOUBLE END AS moderate,
    CASE WHEN p_partkey % 5 = 0 THEN -9999 ELSE 26.0::DOUBLE END AS major, p_retailprice AS c1 FROM part),
c AS (SELECT *, CASE WHEN action > -999 THEN action END AS a, CASE WHEN minor > -999 THEN minor END AS b,
    CASE WHEN moderate > -999 THEN moderate END AS d, CASE WHEN major > -999 THEN major END AS e FROM p)
SELECT site_id, a AS action, b AS minor, d AS moderate, e AS major, c1 AS record FROM c
WHERE returned_id = site_id AND NOT (a IS NULL AND b IS NULL AND d IS NULL AND e IS NULL)
  AND list_filter([a, b, d, e], lambda x: x IS NOT NULL) = list_sort(list_filter([a, b, d, e], lambda x: x IS NOT NULL))""")
def threshold_extract(spark, sf_dir):
    part, off = F.col("p_partkey"), F.lit(-9999.0)
    gone = part % 5 == 0
    payloads = table(spark, sf_dir, "part").select(
        part.cast("string").alias("site_id"),
        F.when(part % 11 == 0, "x").otherwise(part.cast("string")).alias("returned_id"),
        F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).otherwise(off).alias("action"),
        F.when(gone, off).otherwise(20.0).alias("minor"),
        F.when(gone, off).otherwise((20 + part % 7 - 1).cast("double")).alias("moderate"),
        F.when(gone, off).otherwise(26.0).alias("major"),
        F.array(off, F.col("p_retailprice")).alias("crests"))
    return gauges.extract_thresholds(payloads)[0]


@query("distinct_sites", """
SELECT CAST(k AS VARCHAR) AS site_id, arg_min(label, (rk, label)) AS label FROM (
  SELECT c_custkey % 700 AS k, c_mktsegment AS label, 0 AS rk FROM customer
  UNION ALL SELECT s_suppkey * 9, s_name, 1 FROM supplier) GROUP BY k""")
def distinct_sites(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 700).cast("string").alias("site_id"), F.col("c_mktsegment").alias("label"))
    second = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 9).cast("string").alias("site_id"), F.col("s_name").alias("label"))
    return gauges.distinct_sites(first, second)
