"""Radius, nearest-point and area queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.operators import hazards
from hydrospark.plans.pick import top_rows
from hydrospark.plans.spatial import nearest_of_sites, radius_join
from hydrospark.registry import query
from hydrospark.registry.tables import (
    P_SQL, customers, miles_sql, rounded, suppliers, table, values_sql,
)

PAIR = miles_sql("site_lat", "site_lon", "lat", "lon")


@query("haversine_radius", f"""WITH {P_SQL}, p AS (SELECT s_suppkey, c_custkey, {PAIR} AS d FROM s, c)
SELECT s_suppkey, c_custkey, round(d, 6) AS distance_mi, CAST(row_number() OVER (
         PARTITION BY s_suppkey ORDER BY round(d, 6), c_custkey) AS INTEGER) AS nearness
FROM p WHERE d <= 25 QUALIFY nearness <= 25""")
def haversine_radius(spark, sf_dir):
    """Customers within 25 miles of each supplier, the 25 closest of each (a top-k report)."""
    pairs = radius_join(customers(spark, sf_dir).select("c_custkey", "lat", "lon"),
                        suppliers(spark, sf_dir), 25.0, nearest=25, tie=["c_custkey"])
    near = pairs.select("s_suppkey", "c_custkey", F.round("distance_mi", 6).alias("distance_mi"))
    return top_rows(near, ["s_suppkey"], 25, "distance_mi", "c_custkey", rank="nearness")


_FAR = ("f AS (SELECT c_custkey, 60 + (c_custkey % 61) * 0.5::DOUBLE AS lat, (c_custkey * 7 % 720) * 0.5::DOUBLE - 180 AS lon FROM customer),"
        " g AS (SELECT s_suppkey, 60.2::DOUBLE + (s_suppkey % 60) * 0.5::DOUBLE AS site_lat,"
        " 179.9::DOUBLE - (s_suppkey * 11 % 720) * 0.5::DOUBLE AS site_lon FROM supplier)")


@query("far_radius", f"""WITH {_FAR}
SELECT s_suppkey, c_custkey, round({PAIR}, 6) AS distance_mi FROM g, f WHERE {PAIR} <= 60""")
def far_radius(spark, sf_dir):
    """Pairs from 60 degrees to the pole and across the date line."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(
        c, (F.lit(60) + (c % 61) * 0.5).alias("lat"), ((c * 7 % 720) * 0.5 - 180).alias("lon"))
    sites = table(spark, sf_dir, "supplier").select(
        s, (F.lit(60.2) + (s % 60) * 0.5).alias("site_lat"), (F.lit(179.9) - (s * 11 % 720) * 0.5).alias("site_lon"))
    pairs = radius_join(points, sites, 60.0, hot_cell_rows=50)
    return pairs.select("s_suppkey", "c_custkey", F.round("distance_mi", 6).alias("distance_mi"))


@query("nearest_by_table", f"""WITH {P_SQL}, {_FAR},
t AS (SELECT s_suppkey, 'near' AS place, site_lat, site_lon FROM s UNION ALL SELECT s_suppkey, 'far', site_lat, site_lon FROM g),
p AS (SELECT s_suppkey, place, c_custkey, round({PAIR}, 6) AS d FROM t, c)
SELECT s_suppkey, place, c_custkey, d AS distance_mi FROM p
QUALIFY row_number() OVER (PARTITION BY s_suppkey, place ORDER BY d, c_custkey) = 1""")
def nearest_by_table(spark, sf_dir):
    """The customer closest to every supplier, and to every supplier moved to the far north."""
    s = F.col("s_suppkey")
    near = suppliers(spark, sf_dir).select("s_suppkey", F.lit("near").alias("place"), "site_lat", "site_lon")
    far = table(spark, sf_dir, "supplier").select(
        s, F.lit("far").alias("place"), (F.lit(60.2) + (s % 60) * 0.5).alias("site_lat"),
        (F.lit(179.9) - (s * 11 % 720) * 0.5).alias("site_lon"))
    return nearest_of_sites(customers(spark, sf_dir).select("c_custkey", "lat", "lon"), near.unionByName(far),
                            ["s_suppkey", "place"], ["c_custkey"])


@query("radius_rollup", f"""WITH {P_SQL}
SELECT s_suppkey, count(*) AS fires, round(sum(c_acctbal), 2) AS total_acres, max(c_acctbal) AS max_acres,
       min(c_nationkey) AS min_contained_pct, round(min({PAIR}), 6) AS nearest_mi
FROM s, c WHERE {PAIR} <= 40 GROUP BY 1""")
def radius_rollup(spark, sf_dir):
    """Totals around each supplier. Customers are first reduced to one row per position."""
    spots = customers(spark, sf_dir).groupBy("lat", "lon").agg(
        F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.max("c_acctbal").alias("top"),
        F.min("c_nationkey").alias("low"))
    pairs = radius_join(spots, suppliers(spark, sf_dir), 40.0, hot_cell_rows=20)
    return pairs.groupBy("s_suppkey").agg(
        F.sum("n").alias("fires"), F.round(F.sum("total"), 2).alias("total_acres"),
        F.max("top").alias("max_acres"), F.min("low").alias("min_contained_pct"),
        F.round(F.min("distance_mi"), 6).alias("nearest_mi"))


SITES = hazards.area_sites()
AREAS = values_sql("ar", "area_type, area_id, site_lat, site_lon, region, mi",
                   [tuple(s.values()) for s in SITES])


@query("nearest_neighbor", f"""WITH {P_SQL}, {AREAS},
p AS (SELECT area_type, area_id, c_custkey, round({PAIR}, 6) AS d FROM ar, c)
SELECT area_type, area_id, c_custkey, d AS distance_mi FROM p
QUALIFY row_number() OVER (PARTITION BY area_type, area_id ORDER BY d, c_custkey) = 1""")
def nearest_neighbor(spark, sf_dir):
    """The customer closest to every forest and district."""
    return hazards.nearest_storm(customers(spark, sf_dir), carry=["c_custkey"])


FIRES_SQL = f"""{P_SQL}, {AREAS},
f AS (SELECT area_type, area_id, c_custkey, c_acctbal AS acres, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS contained_pct,
        (printf('%.1f', ({PAIR})::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS distance_mi, mi, {PAIR} AS d FROM ar, c),
fi AS (SELECT * FROM f WHERE d <= mi)"""


def _fires(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "c_custkey", F.col("c_acctbal").alias("acres"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("contained_pct"), "lat", "lon")


@query("area_fires", f"""WITH {FIRES_SQL}
SELECT area_type, area_id, c_custkey, distance_mi FROM fi
QUALIFY row_number() OVER (PARTITION BY area_type, area_id ORDER BY distance_mi, c_custkey) <= 6""")
def area_fires(spark, sf_dir):
    """The six closest fires of each area, a top-k report."""
    pairs = hazards.fires_near(_fires(spark, sf_dir))
    return hazards.top_fires(pairs, tie="c_custkey").select(
        "area_type", "area_id", "c_custkey", "distance_mi")


@query("slide_inventory", f"""WITH {P_SQL}, {AREAS}
SELECT area_type, area_id, count(*) AS slides, max(CASE WHEN c_nationkey > 2 THEN 2000 + c_nationkey END) AS most_recent_year
FROM ar, c WHERE {PAIR} <= 25 GROUP BY 1, 2""")
def slide_inventory(spark, sf_dir):
    return hazards.slide_inventory(_slides(spark, sf_dir))[0]


@query("newest_slides", f"""WITH {P_SQL}, {AREAS},
f AS (SELECT area_type, area_id, c_custkey, CASE WHEN c_nationkey > 2 THEN 2000 + c_nationkey END AS year, {PAIR} AS d FROM ar, c)
SELECT area_type, area_id, c_custkey, year FROM f WHERE d <= 25
QUALIFY row_number() OVER (PARTITION BY area_type, area_id ORDER BY year DESC NULLS LAST, round(d, 9), c_custkey) <= 25""")
def newest_slides(spark, sf_dir):
    """The 25 newest slides of each area, a report."""
    return hazards.slide_inventory(_slides(spark, sf_dir))[1].select("area_type", "area_id", "c_custkey", "year")


def _slides(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "c_custkey", F.when(F.col("c_nationkey") > 2, F.lit(2000) + F.col("c_nationkey")).alias("year"),
        "lat", "lon")


EVENTS = ["Red Flag Warning", "Fire Weather Watch", "Flood Warning", "Heat Advisory"]


@query("area_hazards", f"""WITH {FIRES_SQL},
e AS (SELECT *, ({[(s['area_type'], s['area_id']) for s in SITES]!r})[1 + user_id % 12] AS a FROM events),
w AS (SELECT a[1] AS area_type, a[2] AS area_id, round(avg(value), 4) AS temp_f, round(avg(event_id % 60), 4) AS humidity_pct,
        round(avg(user_id % 40), 4) AS wind_mph, round(avg(value) / 200, 4) AS soil, round(avg(event_id % 9), 4) AS past7,
        round(max(value) / 80, 4) AS next72, avg(value) > 49.0 AS saturated FROM e GROUP BY 1, 2),
al AS (SELECT a[1] AS area_type, a[2] AS area_id, bool_or(event_type = 'click' AND user_id % 7 = 0) AS red,
         bool_or(event_type = 'click' AND user_id % 7 = 0 OR event_type = 'error' AND user_id % 5 = 0) AS fire FROM e GROUP BY 1, 2),
ft AS (SELECT area_type, area_id, count(*) AS fires, (printf('%.1f', (sum(acres))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS total_acres, (printf('%.1f', (max(acres))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS max_acres,
         min(contained_pct)::DOUBLE AS min_contained_pct FROM fi GROUP BY 1, 2),
sl AS (SELECT area_type, area_id, count(*) AS slides FROM f WHERE d <= 25 GROUP BY 1, 2),
ne AS (SELECT area_type, area_id, min(round(d, 6)) AS nearest_storm_mi FROM f GROUP BY 1, 2),
j AS (SELECT ar.area_type, ar.area_id, region, temp_f, humidity_pct AS h, wind_mph, soil, past7, next72, saturated, red, fire,
    coalesce(fires, 0) AS fires, coalesce(total_acres, 0) AS total_acres, coalesce(max_acres, 0) AS max_acres, min_contained_pct,
    coalesce(slides, 0) AS slides, nearest_storm_mi
  FROM ar LEFT JOIN w USING (area_type, area_id) LEFT JOIN al USING (area_type, area_id) LEFT JOIN ft USING (area_type, area_id)
  LEFT JOIN sl USING (area_type, area_id) LEFT JOIN ne USING (area_type, area_id)),
m AS (SELECT *, least(40, greatest(1, CASE WHEN h < 10 THEN 0.03229 + 0.281073 * h - 0.000578 * h * temp_f
     WHEN h < 50 THEN 2.22749 + 0.160107 * h - 0.014784 * temp_f
     ELSE 21.0606 + 0.005565 * h * h - 0.00035 * h * temp_f - 0.483199 * h END)) / 30 AS x FROM j),
fw AS (SELECT *, (printf('%.1f', (least(100, greatest(0, least(1, greatest(0, 1 - 2 * x + 1.5 * x * x - 0.5 * x * x * x))
     * sqrt(1 + wind_mph * wind_mph) / 0.3002)))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS fwi FROM m),
sc AS (SELECT *, (printf('%.1f', (greatest(CASE WHEN region = 'coastal' AND NOT coalesce(fire, false) THEN least(coalesce(fwi, 0), 65) ELSE coalesce(fwi, 0) END,
     CASE WHEN red THEN 70 WHEN fire THEN 45 ELSE 0 END))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS fire_score,
   (printf('%.1f', (greatest(0, least(CASE region WHEN 'mountain' THEN 100 WHEN 'piedmont' THEN 65 ELSE 30 END,
     ((CASE region WHEN 'mountain' THEN 18 WHEN 'piedmont' THEN 6 ELSE 0 END)
      + CASE WHEN saturated THEN 30 WHEN soil >= 0.35 THEN 22 WHEN soil >= 0.3 THEN 14 WHEN soil >= 0.2 THEN 6 ELSE 0 END
      + CASE WHEN past7 >= 8 THEN 20 WHEN past7 >= 5 THEN 14 WHEN past7 >= 3 THEN 8 WHEN past7 >= 1.5 THEN 3 ELSE 0 END
      + CASE WHEN next72 >= 6 THEN 35 WHEN next72 >= 4 THEN 25 WHEN next72 >= 2 THEN 14 WHEN next72 >= 1 THEN 6 ELSE 0 END)
     * CASE WHEN saturated AND next72 >= 3 AND region = 'mountain' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)))::DOUBLE)::DOUBLE + 0.0::DOUBLE) AS slide_score FROM fw)
SELECT area_type, area_id, fires, total_acres, max_acres, min_contained_pct, slides, nearest_storm_mi, fwi, fire_score::DOUBLE AS fire_score,
  CASE WHEN fire_score >= 75 THEN 'EXTREME' WHEN fire_score >= 55 THEN 'HIGH' WHEN fire_score >= 30 THEN 'ELEVATED' ELSE 'CALM' END AS fire_label,
  slide_score::DOUBLE AS slide_score,
  CASE WHEN slide_score >= 80 THEN 'EXTREME' WHEN slide_score >= 60 THEN 'HIGH' WHEN slide_score >= 35 THEN 'ELEVATED' ELSE 'CALM' END AS slide_label
FROM sc""")
def area_hazards(spark, sf_dir):
    """Everything known about each forest and district, from all feeds at once."""
    names = F.array(*[F.struct(F.lit(s["area_type"]).alias("area_type"),
                               F.lit(s["area_id"]).alias("area_id")) for s in SITES])
    e = table(spark, sf_dir, "events").withColumn(
        "a", F.element_at(names, (F.col("user_id") % 12 + 1).cast("int"))).select("*", "a.*")
    weather = e.groupBy("area_type", "area_id").agg(
        F.round(F.avg("value"), 4).alias("temp_f"),
        F.round(F.avg(F.col("event_id") % 60), 4).alias("humidity_pct"),
        F.round(F.avg(F.col("user_id") % 40), 4).alias("wind_mph"),
        F.round(F.avg("value") / 200, 4).alias("soil_moisture_top"),
        F.lit(None).cast("double").alias("soil_moisture_shallow"),
        F.round(F.avg(F.col("event_id") % 9), 4).alias("past_7d_precip_in"),
        F.round(F.max("value") / 80, 4).alias("next_72h_precip_in"),
        (F.avg("value") > 49.0).alias("saturated"))
    event = (F.when((F.col("event_type") == "click") & (F.col("user_id") % 7 == 0), EVENTS[0])
             .when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), EVENTS[1])
             .when(F.col("event_type") == "view", EVENTS[2]).otherwise(EVENTS[3]))
    alerts = e.select("area_type", "area_id", event.alias("event"))
    storms = customers(spark, sf_dir).withColumn("name", F.col("c_custkey"))
    out = hazards.rollup(weather, alerts, _fires(spark, sf_dir), _slides(spark, sf_dir), storms)
    return out.select("area_type", "area_id", "fires", "total_acres", "max_acres",
                      "min_contained_pct", "slides", "nearest_storm_mi", "fwi", "fire_score",
                      "fire_label", "slide_score", "slide_label")
