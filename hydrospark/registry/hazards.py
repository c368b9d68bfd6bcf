"""Weather, fire, slide, sea, soil and air queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.functions import hazard
from hydrospark.functions.base import settle
from hydrospark.operators import hazards as ops
from hydrospark.registry import query
from hydrospark.registry.tables import table

# Line items as weather reports: quantity 1..50, discount 0..0.1, tax 0..0.08, dates 1992-2001.
TEMP = "(40 + l_quantity * 1.7::DOUBLE)"
RH = "(1 + (l_partkey * 7 + l_linenumber) % 99)"
WIND = "(l_suppkey % 45)"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
HEAT = f"""w AS (SELECT *, {TEMP} AS t, {RH}::DOUBLE AS h FROM lineitem),
x AS (SELECT *, (t - 32) * 5 / 9 AS c, -42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 0.00683783 * t * t
     - 0.05391553 * h * h + 0.00122874 * t * t * h + 0.00085282 * t * h * h - 0.00000199 * t * t * h * h AS reg FROM w),
y AS (SELECT *, (printf('%.1f', (CASE WHEN t < 80 THEN 0.5 * (t + 61 + (t - 68) * 1.2 + h * 0.094)
     WHEN h < 13 AND t BETWEEN 80 AND 112 THEN reg - (13 - h) / 4 * sqrt(greatest(0, 17 - abs(t - 95)) / 17)
     WHEN h > 85 AND t BETWEEN 80 AND 87 THEN reg + (h - 85) / 10 * (87 - t) / 5 ELSE reg END)::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS hi,
   (printf('%.1f', ((c * atan(0.151977 * sqrt(h + 8.313659)) + atan(c + h) - atan(h - 1.676331)
     + 0.00391838 * pow(h, 1.5) * atan(0.023101 * h) - 4.686035) * 9 / 5 + 32)::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS wb FROM x)"""
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def reports(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({
        "temp_f": F.lit(40) + F.col("l_quantity") * 1.7,
        "humidity_pct": F.lit(1) + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 99,
        "wind_mph": F.col("l_suppkey") % 45,
    })


@query("heat_index", f"""WITH {HEAT}
SELECT {KEY}, hi AS heat_index_f, wb AS wet_bulb_f,
  CASE WHEN hi >= 125 THEN 'Extreme Danger' WHEN hi >= 103 THEN 'Danger' WHEN hi >= 90 THEN 'Extreme Caution'
       WHEN hi >= 80 THEN 'Caution' ELSE 'Normal' END AS heat_category,
  CASE WHEN wb < 65 THEN 'Low Risk' WHEN wb < 72 THEN 'Caution' WHEN wb < 78 THEN 'High Risk' WHEN wb < 83 THEN 'Danger'
       ELSE 'Extreme' END AS wet_bulb_band,
  CASE WHEN hi < 80 THEN 'Normal' WHEN hi < 90 THEN 'Caution' WHEN hi < 103 THEN 'Ext. Caution' WHEN hi < 124 THEN 'Danger'
       ELSE 'Extreme' END AS heat_band
FROM y""")
def heat_index(spark, sf_dir):
    return ops.heat_stress(reports(spark, sf_dir)).select(
        *ID, "heat_index_f", "wet_bulb_f", "heat_category", "wet_bulb_band", "heat_band")


@query("fire_index", f"""WITH w AS (SELECT *, {TEMP} AS t, {RH}::DOUBLE AS h, {WIND}::DOUBLE AS u,
    CASE l_linenumber % 3 WHEN 0 THEN 'mountain' WHEN 1 THEN 'piedmont' ELSE 'coastal' END AS region,
    l_returnflag = 'R' AND l_linestatus = 'F' AS red, l_returnflag = 'R' AS alert FROM lineitem),
m AS (SELECT *, least(40, greatest(1, CASE WHEN h < 10 THEN 0.03229 + 0.281073 * h - 0.000578 * h * t
     WHEN h < 50 THEN 2.22749 + 0.160107 * h - 0.014784 * t
     ELSE 21.0606 + 0.005565 * h * h - 0.00035 * h * t - 0.483199 * h END)) / 30 AS x FROM w),
f AS (SELECT *, (printf('%.1f', (least(100, greatest(0, least(1, greatest(0, 1 - 2 * x + 1.5 * x * x - 0.5 * x * x * x))
     * sqrt(1 + u * u) / 0.3002)))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS fwi FROM m),
s AS (SELECT *, (printf('%.1f', (greatest(CASE WHEN region = 'coastal' AND NOT alert THEN least(fwi, 65) ELSE fwi END,
     CASE WHEN red THEN 70 WHEN alert THEN 45 ELSE 0 END))::DOUBLE)::DOUBLE + 0.0::DOUBLE)::DOUBLE AS fire_score FROM f)
SELECT {KEY}, fwi, fire_score, CASE WHEN fire_score >= 75 THEN 'EXTREME' WHEN fire_score >= 55 THEN 'HIGH'
  WHEN fire_score >= 30 THEN 'ELEVATED' ELSE 'CALM' END AS fire_label FROM s""")
def fire_index(spark, sf_dir):
    region = (F.when(F.col("l_linenumber") % 3 == 0, "mountain")
              .when(F.col("l_linenumber") % 3 == 1, "piedmont").otherwise("coastal"))
    alert = F.col("l_returnflag") == "R"
    out = reports(spark, sf_dir).withColumns({
        "region": region, "fire_alert": alert, "red_flag": alert & (F.col("l_linestatus") == "F")})
    return ops.fire_weather(out).select(*ID, "fwi", "fire_score", "fire_label")


SLIDE_SQL = """(printf('%.1f', (greatest(0, least(CASE region WHEN 'mountain' THEN 100 WHEN 'piedmont' THEN 65 ELSE 30 END,
     ((CASE region WHEN 'mountain' THEN 18 WHEN 'piedmont' THEN 6 ELSE 0 END)
      + CASE WHEN saturated THEN 30 WHEN soil >= 0.35 THEN 22 WHEN soil >= 0.3 THEN 14 WHEN soil >= 0.2 THEN 6 ELSE 0 END
      + CASE WHEN past >= 8 THEN 20 WHEN past >= 5 THEN 14 WHEN past >= 3 THEN 8 WHEN past >= 1.5 THEN 3 ELSE 0 END
      + CASE WHEN ahead >= 6 THEN 35 WHEN ahead >= 4 THEN 25 WHEN ahead >= 2 THEN 14 WHEN ahead >= 1 THEN 6 ELSE 0 END)
     * CASE WHEN saturated AND ahead >= 3 AND region = 'mountain' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)))::DOUBLE)::DOUBLE + 0.0::DOUBLE)::DOUBLE"""


@query("landslide_score", f"""WITH w AS (SELECT *,
    CASE l_linenumber % 3 WHEN 0 THEN 'mountain' WHEN 1 THEN 'piedmont' ELSE 'coastal' END AS region,
    l_quantity / 100 AS soil, l_quantity > 40 AS saturated, l_discount * 100 AS past, l_tax * 100 AS ahead FROM lineitem),
s AS (SELECT *, {SLIDE_SQL} AS slide_score FROM w)
SELECT {KEY}, slide_score, CASE WHEN slide_score >= 80 THEN 'EXTREME' WHEN slide_score >= 60 THEN 'HIGH'
  WHEN slide_score >= 35 THEN 'ELEVATED' ELSE 'CALM' END AS slide_label FROM s""")
def landslide_score(spark, sf_dir):
    region = (F.when(F.col("l_linenumber") % 3 == 0, "mountain")
              .when(F.col("l_linenumber") % 3 == 1, "piedmont").otherwise("coastal"))
    out = table(spark, sf_dir, "lineitem").withColumns({
        "region": region, "soil_moisture_top": F.col("l_quantity") / 100,
        "soil_moisture_shallow": F.lit(None).cast("double"), "saturated": F.col("l_quantity") > 40,
        "past_7d_precip_in": F.col("l_discount") * 100, "next_72h_precip_in": F.col("l_tax") * 100})
    return ops.landslide(out).select(*ID, "slide_score", "slide_label")


@query("sea_soil_aqi_bands", """WITH w AS (SELECT *, (printf('%.1f', (l_quantity / 5 * 3.28084)::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS wave, (printf('%.1f', (l_quantity * 0.7::DOUBLE * 1.94384)::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS wind,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 100 END AS soil, l_quantity > 42 AS sat FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, wave AS wave_ht_ft, wind AS wind_kt,
  CASE WHEN wave >= 25 OR wind >= 64 THEN 'PHENOMENAL' WHEN wave >= 13 OR wind >= 48 THEN 'VERY ROUGH' WHEN wave >= 8 OR wind >= 34 THEN 'ROUGH'
       WHEN wave >= 4 OR wind >= 22 THEN 'MODERATE' ELSE 'CALM' END AS seas,
  CASE WHEN soil >= 0.4 THEN 'SATURATED' WHEN soil >= 0.3 THEN 'wet' WHEN soil >= 0.2 THEN 'moist' WHEN soil < 0.15 THEN 'very dry' ELSE 'normal' END AS soil_condition,
  round(least(100, coalesce(soil, 0) / 0.45 * 100), 6) AS saturation_pct,
  (CASE WHEN sat THEN 1.25 WHEN soil >= 0.3 THEN 1.1 ELSE 1.0 END)::DOUBLE AS amplifier,
  CASE WHEN l_quantity * 8 >= 300 THEN 'HAZARDOUS' WHEN l_quantity * 8 >= 200 THEN 'VERY UNHEALTHY' WHEN l_quantity * 8 >= 150 THEN 'UNHEALTHY'
       WHEN l_quantity * 8 >= 100 THEN 'UNHEALTHY SENS.' WHEN l_quantity * 8 >= 50 THEN 'MODERATE' ELSE 'GOOD' END AS air,
  CASE WHEN l_discount * 10 >= 0.5 THEN 'extreme' WHEN l_discount * 10 >= 0.25 THEN 'heavy' ELSE '' END AS rain,
  round(l_extendedprice / 25.4, 6) AS mm_in, round(l_quantity * 9 / 5 + 32, 6) AS c_f, round(l_quantity * 0.621371, 6) AS kmh_mph
FROM w""")
def sea_soil_aqi_bands(spark, sf_dir):
    q = F.col("l_quantity")
    out = table(spark, sf_dir, "lineitem").withColumns({
        "wave_ht_ft": hazard.m_to_ft(q / 5), "wind_kt": hazard.ms_to_kt(q * 0.7),
        "soil": F.when(F.col("l_linenumber") != 7, q / 100)})
    return out.select(
        *ID, "wave_ht_ft", "wind_kt", hazard.sea_state("wave_ht_ft", "wind_kt").alias("seas"),
        hazard.soil_condition("soil").alias("soil_condition"),
        F.round(hazard.soil_saturation_pct("soil"), 6).alias("saturation_pct"),
        hazard.soil_amplifier("soil", q > 42).alias("amplifier"),
        hazard.air_band(q * 8).alias("air"), hazard.rain_class(F.col("l_discount") * 10).alias("rain"),
        F.round(hazard.mm_to_in("l_extendedprice"), 6).alias("mm_in"),
        F.round(hazard.c_to_f(q), 6).alias("c_f"),
        F.round(hazard.kmh_to_mph(q), 6).alias("kmh_mph"))


@query("freshness", """WITH f AS (SELECT user_id, event_type AS feed, max(ts) AS last_ts FROM events GROUP BY 1, 2),
n AS (SELECT max(ts) AS now FROM events),
a AS (SELECT *, greatest(0, (floor(epoch(now)) - floor(epoch(last_ts))) / 60) AS age FROM f, n)
SELECT user_id, feed, (printf('%.1f', (age)::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS age_minutes,
  CASE WHEN age < 75 THEN 'fresh' WHEN age < 150 THEN 'aging' WHEN age < 360 THEN 'stale' ELSE 'frozen' END AS level
FROM a""")
def freshness(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max(F.unix_timestamp("ts")).alias("now"))  # one row
    feeds = events.groupBy("user_id", F.col("event_type").alias("feed")).agg(
        F.max(F.unix_timestamp("ts")).alias("as_of"))
    age, band = hazard.freshness("as_of", "now")
    aged = feeds.crossJoin(F.broadcast(now)).withColumn("level", band)
    return settle(aged, 1, {"age_minutes": age}).select("user_id", "feed", "age_minutes", "level")


@query("array_sums", """WITH a AS (SELECT *, list_transform(range(96), lambda i: (event_id * 7 + i * 13) % 50 / 100) AS rain,
    list_transform(range(30), lambda i: CASE WHEN (event_id + i) % 5 = 0 THEN NULL ELSE 60 + (event_id + i) % 40 END) AS temp,
    list_transform(range(30), lambda i: CASE WHEN (event_id + i) % 7 = 0 THEN NULL ELSE 30 + (event_id + i) % 60 END) AS rh FROM events)
SELECT event_id, (printf('%.2f', (list_reduce(rain[1:72], lambda a, b: a + b))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS next_72h, (printf('%.2f', (list_reduce(rain[1:24], lambda a, b: a + b))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS next_24h,
  CAST(len(list_filter(temp[1:24], lambda v: v IS NOT NULL)) AS INTEGER) AS n_temp,
  CAST(len(list_filter(list_zip(temp[1:24], rh[1:24]), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL)) AS INTEGER) AS n_wet_bulb,
  list_sum(list_filter(temp[1:24], lambda v: v IS NOT NULL))::BIGINT AS sum_temp
FROM a""")
def array_sums(spark, sf_dir):
    """Hourly arrays of every report: totals of the coming hours and slices without gaps."""
    k = F.col("event_id")

    def series(n, fn):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), fn)

    docs = table(spark, sf_dir, "events").select(
        k, series(96, lambda i: (k * 7 + i * 13) % 50 / 100).alias("rain"),
        series(30, lambda i: F.when((k + i) % 5 != 0, 60 + (k + i) % 40)).alias("temp"),
        series(30, lambda i: F.when((k + i) % 7 != 0, 30 + (k + i) % 60)).alias("rh"),
        series(30, lambda i: F.concat(F.lit("+"), i.cast("string"), F.lit("h"))).alias("times"))
    parts = ops.hourly_slices(F.col("times"), F.col("temp"), F.col("rh"))
    total = {n: ops.first_sum(F.col("rain"), n) for n in (72, 24)}
    return docs.select(
        k, total[72].alias("next_72h"), total[24].alias("next_24h"),
        F.size(parts["hourly_temp_f"]).alias("n_temp"),
        F.size(parts["hourly_wet_bulb_f"]).alias("n_wet_bulb"),
        F.aggregate(parts["hourly_temp_f"], F.lit(0).cast("bigint"), lambda a, v: a + v).alias("sum_temp"))
