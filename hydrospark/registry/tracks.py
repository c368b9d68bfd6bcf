"""Track and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions.geo import (
    angular_diff, bearing_deg, inside_ring, ring_distance_mi, ring_proximity,
)
from hydrospark.operators import grid, tracks as ops
from hydrospark.registry import query
from hydrospark.registry.tables import T_SQL, customers, miles_sql, P_SQL, rounded, table, tracks
from hydrospark.registry.tables import values_sql

HOME = (str(dims.HOME_LAT), str(dims.HOME_LON))
DIST = miles_sql(*HOME, "lat", "lon")
RING = values_sql("edges", "y1, x1, y2, x2", [
    (*a, *b) for a, b in zip(dims.BASIN_RING[:-1], dims.BASIN_RING[1:])])
DAY = 86400


def inside_sql(lat: str, lon: str) -> str:
    return (f"(SELECT count(*) % 2 = 1 FROM edges WHERE (y1 > {lat}) <> (y2 > {lat})"
            f" AND {lon} < (x2 - x1) * ({lat} - y1) / (y2 - y1) + x1)")


@query("storm_summary", f"""WITH {T_SQL}, n AS (SELECT *, {DIST} AS d FROM t)
SELECT storm_id, name, year, round(min(d), 6) AS min_dist_mi, max(wind_kt) AS peak_wind_kt,
  min(pres_mb) AS min_pres_mb, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses,
  min(datetime) AS first_time, max(datetime) AS last_time
FROM n WHERE d <= 60 GROUP BY 1, 2, 3""")
def storm_summary(spark, sf_dir):
    return rounded(ops.near(tracks(spark, sf_dir), 60.0).drop("site_id"))


@query("closest_storms", f"""WITH {T_SQL}, n AS (SELECT *, {DIST} AS d FROM t)
SELECT storm_id, year, round(min(d), 6) AS min_dist_mi, max(wind_kt) AS peak_wind_kt
FROM n WHERE d <= 150 GROUP BY 1, 2 ORDER BY round(min(d), 6), storm_id LIMIT 20""")
def closest_storms(spark, sf_dir):
    """The twenty closest approaches, a top-k report."""
    found = ops.near(tracks(spark, sf_dir)).select(
        "storm_id", "year", F.round("min_dist_mi", 6).alias("min_dist_mi"), "peak_wind_kt")
    return found.orderBy("min_dist_mi", "storm_id").limit(20)


@query("climatology", f"""WITH {T_SQL}, n AS (SELECT *, {DIST} AS d FROM t WHERE year >= 1950),
y AS (SELECT min(year) AS a, max(year) AS b FROM n),
s AS (SELECT storm_id, year, max(wind_kt) AS peak FROM n WHERE d <= 60 GROUP BY 1, 2),
k AS (SELECT count(*) AS n_storms, count(*) FILTER (peak >= 64) AS n_hurricanes FROM s)
SELECT a AS first_year, b AS last_year, b - a + 1 AS n_years, n_storms, n_hurricanes,
  round(n_storms / (b - a + 1), 6) AS rate_per_year,
  round(1 - exp(-n_storms / (b - a + 1)), 6) AS p_at_least_one,
  round(1 - exp(-n_hurricanes / (b - a + 1)), 6) AS p_hurricane, round(90 / 123, 6) AS seasonal_scale,
  round(1 - exp(-n_storms / (b - a + 1) * 90 / 123), 6) AS seasonal_p_at_least_one
FROM y, k""")
def climatology(spark, sf_dir):
    climo = ops.climatology(tracks(spark, sf_dir), 60.0)
    return rounded(ops.seasonal_risk(climo).drop("site_id"))


@query("tracks_near_site", f"""WITH {T_SQL}
SELECT storm_id, datetime, lat, lon FROM t
WHERE storm_id IN (SELECT storm_id FROM t WHERE {DIST} <= 8)""")
def tracks_near_site(spark, sf_dir):
    found = ops.whole_tracks_near(tracks(spark, sf_dir), 8.0)
    return rounded(found.select("storm_id", "datetime", "lat", "lon"), 9)


BEARING = ("(degrees(atan2(sin(radians(lo2 - lo1)) * cos(radians(la2)), cos(radians(la1)) * sin(radians(la2))"
           " - sin(radians(la1)) * cos(radians(la2)) * cos(radians(lo2 - lo1)))) + 360)")
MOTION_SQL = f"""{T_SQL},
o AS (SELECT *, {DIST} AS d, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lead(lat) OVER w AS nla,
             lead(lon) OVER w AS nlo
      FROM t WINDOW w AS (PARTITION BY storm_id ORDER BY datetime)),
q AS (SELECT *, coalesce(pla, lat) AS la1, coalesce(plo, lon) AS lo1, coalesce(nla, lat) AS la2,
             coalesce(nlo, lon) AS lo2 FROM o),
mo AS (SELECT *, CASE WHEN pla IS NOT NULL OR nla IS NOT NULL
                 THEN {BEARING} - 360 * floor({BEARING} / 360) END AS motion FROM q)"""


@query("closest_fix_motion", f"""WITH {MOTION_SQL}
SELECT storm_id, datetime, round(d, 6) AS distance_mi, round(lat, 6) AS lat, round(lon, 6) AS lon,
  round(motion, 6) AS motion_deg,
  round(abs((motion - 130 + 180) - 360 * floor((motion - 130 + 180) / 360) - 180), 6) AS off_upslope_deg
FROM mo QUALIFY row_number() OVER (PARTITION BY storm_id ORDER BY round(d, 6), datetime) = 1""")
def closest_fix_motion(spark, sf_dir):
    found = ops.closest_fix(tracks(spark, sf_dir)).drop("site_id")
    return rounded(found.withColumn("off_upslope_deg", angular_diff("motion_deg", F.lit(130.0))))


@query("polygon_fraction", f"""WITH {MOTION_SQL}, {RING},
mids AS (SELECT storm_id, (lat + nla) / 2 AS mla, (lon + nlo) / 2 AS mlo FROM o),
hits AS (SELECT storm_id, mla, CASE WHEN {inside_sql('mla', 'mlo')} THEN 1.0 ELSE 0.0 END AS hit FROM mids)
SELECT storm_id, round(coalesce(avg(hit) FILTER (mla IS NOT NULL), 0)::DOUBLE, 6) AS track_fraction FROM hits GROUP BY 1""")
def polygon_fraction(spark, sf_dir):
    return rounded(ops.basin_fraction(tracks(spark, sf_dir)))


VERTICES = ", ".join(miles_sql("lat", "lon", str(y), str(x))
                     for y, x in dict.fromkeys(dims.BASIN_RING))


@query("basin_distance", f"""WITH {P_SQL}, {RING},
i AS (SELECT c_custkey, lat, lon, {inside_sql('lat', 'lon')} AS inside FROM c)
SELECT c_custkey, inside, round(CASE WHEN inside THEN 0 ELSE least({VERTICES}) END, 6) AS basin_mi,
  round(exp(-(CASE WHEN inside THEN 0 ELSE least({VERTICES}) END) / 100), 6) AS proximity
FROM i""")
def basin_distance(spark, sf_dir):
    ring = dims.BASIN_RING
    miles = ring_distance_mi("lat", "lon", ring)
    return rounded(customers(spark, sf_dir).select(
        "c_custkey", inside_ring("lat", "lon", ring).alias("inside"), miles.alias("basin_mi"),
        ring_proximity(miles).alias("proximity")))


# ---- elevation grids from line items ---------------------------------------------------------

CELL_SQL = """raw AS (
  SELECT l_returnflag AS grid_id, CAST(l_orderkey % 21 AS INTEGER) AS i, CAST(l_partkey % 23 AS INTEGER) AS j,
         CASE WHEN (l_orderkey % 21) * 23 + l_partkey % 23 <> 60 THEN avg(l_quantity) * 100 END AS elev
  FROM lineitem GROUP BY 1, 2, 3, (l_orderkey % 21) * 23 + l_partkey % 23),
spine AS (SELECT grid_id, i::INTEGER AS i, j::INTEGER AS j FROM (SELECT DISTINCT grid_id FROM raw), range(21) a(i), range(23) b(j)),
hol AS (SELECT s.grid_id, s.i, s.j, r.elev FROM spine s LEFT JOIN raw r USING (grid_id, i, j)),
cells AS (SELECT grid_id, i, j, coalesce(elev, avg(elev) OVER (PARTITION BY grid_id)) AS elev FROM hol
          QUALIFY avg(CASE WHEN elev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY grid_id) <= 0.25),
gr AS (SELECT *, coalesce((lead(elev) OVER wi - lag(elev) OVER wi) / 0.4::DOUBLE, (lead(elev) OVER wi - elev) / 0.2::DOUBLE,
                          (elev - lag(elev) OVER wi) / 0.2::DOUBLE) AS dh_dlat,
              coalesce((lead(elev) OVER wj - lag(elev) OVER wj) / 0.4::DOUBLE, (lead(elev) OVER wj - elev) / 0.2::DOUBLE,
                       (elev - lag(elev) OVER wj) / 0.2::DOUBLE) AS dh_dlon
       FROM cells WINDOW wi AS (PARTITION BY grid_id, j ORDER BY i), wj AS (PARTITION BY grid_id, i ORDER BY j))"""


def cells(spark, sf_dir):
    """Mean quantity per cell as a height, unknown in one cell of every grid."""
    i, j = (F.col("l_orderkey") % 21).cast("int"), (F.col("l_partkey") % 23).cast("int")
    raw = (table(spark, sf_dir, "lineitem")
           .groupBy(F.col("l_returnflag").alias("grid_id"), i.alias("i"), j.alias("j"))
           .agg((F.avg("l_quantity") * 100).alias("elev"))
           .withColumn("elev", F.when(F.col("i") * 23 + F.col("j") != 60, F.col("elev"))))
    return grid.fill_holes(grid.complete(raw))


@query("grid_gradient", f"""WITH {CELL_SQL}
SELECT grid_id, i, j, round(elev, 4) AS elev, round(dh_dlat, 4) AS dh_dlat, round(dh_dlon, 4) AS dh_dlon FROM gr""")
def grid_gradient(spark, sf_dir):
    return rounded(grid.gradient(cells(spark, sf_dir), chunk_cells=8), 4)


@query("grid_sample", f"""WITH {CELL_SQL}, {P_SQL},
p AS (SELECT ['A', 'N', 'R'][1 + c_custkey % 3] AS grid_id, c_custkey, lat + 0.03::DOUBLE AS lat, lon + 0.07::DOUBLE AS lon, (c_custkey % 360)::DOUBLE AS wind_from,
             (20 + c_custkey % 60)::DOUBLE AS wind_kt FROM c),
f AS (SELECT *, (lat - 33.5) / 0.2::DOUBLE AS fi, (lon + 84.5) / 0.2::DOUBLE AS fj FROM p),
x AS (SELECT *, CAST(least(19, floor(fi)) AS INTEGER) AS i0, CAST(least(21, floor(fj)) AS INTEGER) AS j0 FROM f
      WHERE fi BETWEEN 0 AND 20 AND fj BETWEEN 0 AND 22),
b AS (SELECT x.c_custkey, sum((CASE WHEN g.i = i0 THEN 1 - (fi - i0) ELSE fi - i0 END)
                            * (CASE WHEN g.j = j0 THEN 1 - (fj - j0) ELSE fj - j0 END) * dh_dlat) AS dh_dlat,
             sum((CASE WHEN g.i = i0 THEN 1 - (fi - i0) ELSE fi - i0 END)
                            * (CASE WHEN g.j = j0 THEN 1 - (fj - j0) ELSE fj - j0 END) * dh_dlon) AS dh_dlon
      FROM x JOIN gr g ON g.grid_id = x.grid_id AND g.i IN (i0, i0 + 1) AND g.j IN (j0, j0 + 1) GROUP BY 1)
SELECT p.c_custkey, round(dh_dlat, 3) AS dh_dlat, round(dh_dlon, 3) AS dh_dlon,
  round(coalesce(wind_kt * 0.5144::DOUBLE * (sin(radians(wind_from + 180)) * dh_dlon / (111320 * cos(radians(lat)))
        + cos(radians(wind_from + 180)) * dh_dlat / 111320), 0), 6) AS upslope_ms
FROM p LEFT JOIN b USING (c_custkey)""")
def grid_sample(spark, sf_dir):
    points = customers(spark, sf_dir).select(
        F.element_at(F.array(*map(F.lit, "ANR")), (1 + F.col("c_custkey") % 3).cast("int")).alias("grid_id"),
        "c_custkey", (F.col("lat") + 0.03).alias("lat"),
        (F.col("lon") + 0.07).alias("lon"), (F.col("c_custkey") % 360).cast("double").alias("wind_from"),
        (F.lit(20) + F.col("c_custkey") % 60).cast("double").alias("wind_kt"))
    out = grid.upslope(points, grid.gradient(cells(spark, sf_dir)))
    return out.select("c_custkey", F.round("dh_dlat", 3).alias("dh_dlat"),
                      F.round("dh_dlon", 3).alias("dh_dlon"),
                      (F.round("upslope_ms", 6) + 0.0).alias("upslope_ms"))


PWAT = ", ".join(f"{v}.0" for v in (14, 15, 19, 24, 32, 41, 47, 48, 41, 28, 20, 15))


@query("terrain_score", f"""WITH {MOTION_SQL}, {RING}, {CELL_SQL},
crest AS (SELECT grid_id, sum(w * dh_dlat) AS dh_dlat, sum(w * dh_dlon) AS dh_dlon FROM (
  SELECT (CASE WHEN i = 8 THEN 9 - (35.30::DOUBLE - 33.5) / 0.2::DOUBLE ELSE (35.30::DOUBLE - 33.5) / 0.2::DOUBLE - 8 END)
       * (CASE WHEN j = 10 THEN 11 - (84.5::DOUBLE - 82.40) / 0.2::DOUBLE ELSE (84.5::DOUBLE - 82.40) / 0.2::DOUBLE - 10 END) AS w, *
  FROM gr WHERE i IN (8, 9) AND j IN (10, 11)) GROUP BY grid_id),
near AS (SELECT DISTINCT storm_id FROM mo WHERE d <= 20),
mids AS (SELECT storm_id, (lat + nla) / 2 AS mla, (lon + nlo) / 2 AS mlo FROM o WHERE nla IS NOT NULL),
frac AS (SELECT storm_id, avg(CASE WHEN {inside_sql('mla', 'mlo')} THEN 1.0 ELSE 0.0 END) AS f FROM mids GROUP BY 1),
peak AS (SELECT storm_id, max(wind_kt)::DOUBLE AS peak FROM t GROUP BY 1),
a AS (SELECT mo.*, peak, coalesce(f, 0)::DOUBLE AS frac, CAST(month(datetime) AS INTEGER) AS mon FROM mo JOIN near USING (storm_id)
      JOIN peak USING (storm_id) LEFT JOIN frac USING (storm_id)
      QUALIFY row_number() OVER (PARTITION BY storm_id ORDER BY round(d, 9), datetime) = 1),
e AS (SELECT *, CASE WHEN coalesce(peak, 0) <= 26 THEN coalesce(peak, 0)
                     ELSE 26 + (peak - 26) * exp(-0.18 * d / 12) END AS dec,
  1 + 2 * (0.2 + 0.8 / (1 + exp(-(({HOME[1]}) - lon) * 69 * cos(radians(lat)) / 25)))
    * CASE WHEN motion IS NULL THEN 0.5 ELSE greatest(0, cos(radians(motion))) END AS oro,
  0.3 + 1.2 * least(65, ([{PWAT}])[mon] + 18 * (1 - exp(-greatest(0, {HOME[0]} - lat) / 3))
    * least(1, greatest(0, (coalesce(peak, 25) - 25) / 75))) / 65 AS moist,
  exp(-(CASE WHEN {inside_sql('lat', 'lon')} THEN 0 ELSE least({VERTICES}) END) / 100) AS prox FROM a),
u AS (SELECT e.*, site_id, CASE WHEN dec > 5 AND crest.dh_dlat IS NOT NULL THEN dec * 0.5144 * (
    sin(radians(coalesce(motion + 180, 160) + 180)) * crest.dh_dlon / (111320 * cos(radians(35.30)))
  + cos(radians(coalesce(motion + 180, 160) + 180)) * crest.dh_dlat / 111320) ELSE 0 END AS up FROM e, (VALUES ('A'), ('N'), ('R'), ('rejected')) AS si(site_id) LEFT JOIN crest ON grid_id = site_id)
SELECT site_id, storm_id, mon AS month, round(d, 6) AS min_dist_mi, peak AS peak_wind_kt, round(dec, 6) AS decayed_wind_kt,
  round(oro, 6) AS orographic_factor, round(moist, 6) AS moisture_factor, round(prox, 6) AS watershed_proximity,
  round(frac, 6) AS watershed_track_frac, round(up, 6) AS upslope_w_ms,
  round(coalesce(nullif(peak, 0), 25) * exp(-d / 75) * oro * moist * (1 + 5 * greatest(0, up))
    * (0.5 + 0.5 * prox + 0.5 * frac) / 2, 4) AS rainfall_risk_score
FROM u""")
def terrain_score(spark, sf_dir):
    """The home site on every grid, and on one that was rejected and so has no cells."""
    slopes = grid.gradient(cells(spark, sf_dir))
    sites = [ops.HOME[0] | {"site_id": g, "site_grid_id": g} for g in ("A", "N", "R", "rejected")]
    out = ops.terrain_score(tracks(spark, sf_dir), slopes, radius_mi=20.0, sites=sites)
    return rounded(out.withColumn("rainfall_risk_score", F.round("rainfall_risk_score", 4)).select(
        "site_id", "storm_id", "month", "min_dist_mi", "peak_wind_kt", "decayed_wind_kt", "orographic_factor",
        "moisture_factor", "watershed_proximity", "watershed_track_frac", "upslope_w_ms",
        "rainfall_risk_score"))
