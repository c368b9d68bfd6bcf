import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.operators import grid, tracks
from hydrospark.plans.spatial import radius_join

FIX = "storm_id string, name string, datetime timestamp, year int, status string, lat double, lon double, wind_kt int, pres_mb int"


def fixes(spark, *rows):
    out = []
    for storm, hour, lat, lon, wind in rows:
        t = dt.datetime(2024, 9, 26) + dt.timedelta(hours=hour)
        out.append((storm, storm.upper(), t, t.year, "HU" if wind and wind >= 64 else "TS", lat, lon, wind, 990))
    return spark.createDataFrame(out, FIX)


@pytest.fixture(scope="module")
def storms(spark):
    return fixes(
        spark, ("a", 0, 30.0, -84.0, 100), ("a", 6, 33.0, -83.5, 70), ("a", 12, 35.5, -82.8, 50),
        ("a", 18, 37.5, -82.5, None), ("b", 0, 35.3, -82.5, 30), ("far", 0, 20.0, -50.0, 120)).cache()


def test_near_summary(storms):
    rows = {r["storm_id"]: r for r in tracks.near(storms, 150.0).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["peak_wind_kt"] == 50 and rows["a"]["statuses"] == "TS"
    assert rows["a"]["min_dist_mi"] < 20


def test_climatology_and_empty(storms):
    row = tracks.climatology(storms, 150.0).first()
    assert (row["n_years"], row["n_storms"], row["n_hurricanes"]) == (1, 2, 0)
    assert row["p_at_least_one"] == pytest.approx(1 - math.exp(-2))
    none = tracks.climatology(storms, 0.001).first()
    assert (none["n_storms"], none["rate_per_year"], none["p_at_least_one"]) == (0, 0.0, 0.0)
    scaled = tracks.seasonal_risk(tracks.climatology(storms, 150.0)).first()
    assert scaled["seasonal_p_at_least_one"] == pytest.approx(1 - math.exp(-2 * 90 / 123))


def test_motion_is_clamped_at_ends_and_unknown_for_one_fix(storms):
    rows = {(r["storm_id"], r["datetime"].hour): r["motion_deg"] for r in tracks.with_motion(
        storms, span_s=6 * 3600).collect()}
    assert rows[("b", 0)] is None
    assert all(0 <= rows[("a", h)] < 40 for h in (0, 6, 12, 18))


def test_terrain_score(storms):
    rows = {r["storm_id"]: r for r in tracks.terrain_score(storms).collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    # The whole track counts for the peak wind, not only the part inside the radius.
    assert a["peak_wind_kt"] == 100 and a["month"] == 9
    assert a["decayed_wind_kt"] == pytest.approx(26 + 74 * math.exp(-0.18 * a["min_dist_mi"] / 12))
    assert rows["b"]["watershed_track_frac"] == 0.0 and rows["b"]["watershed_proximity"] == 1.0
    # Unknown motion counts half.
    side = 0.2 + 0.8 / (1 + math.exp(-((dims.HOME_LON + 82.5) * 69 * math.cos(math.radians(35.3))) / 25))
    assert rows["b"]["orographic_factor"] == pytest.approx(1 + 2 * side * 0.5)


def test_basin_fraction(spark):
    inside = fixes(spark, ("in", 0, 35.20, -82.50, 30), ("in", 6, 35.25, -82.50, 30), ("in", 12, 35.30, -82.50, 30),
                   ("out", 0, 40.0, -100.0, 30), ("out", 6, 41.0, -100.0, 30), ("one", 0, 35.2, -82.5, 30))
    got = {r["storm_id"]: r["track_fraction"] for r in tracks.basin_fraction(inside).collect()}
    assert got == {"in": 1.0, "out": 0.0, "one": 0.0}


def test_gradient_of_a_plane(spark):
    cells = spark.range(21 * 23).select(
        F.lit("g").alias("grid_id"), F.floor(F.col("id") / 23).cast("int").alias("i"),
        (F.col("id") % 23).cast("int").alias("j")).withColumn("elev", F.col("i") * 10.0 + F.col("j") * 4.0)
    slopes = grid.gradient(cells, chunk_cells=5)
    assert slopes.count() == 483
    for r in slopes.collect():
        assert (r["dh_dlat"], r["dh_dlon"]) == (pytest.approx(50.0), pytest.approx(20.0))
    points = spark.createDataFrame(
        [("g", 35.33, -82.41, 180.0, 20.0), ("g", 33.5, -84.5, 180.0, 20.0), ("g", 10.0, 10.0, 180.0, 20.0)],
        "grid_id string, lat double, lon double, wind_from double, wind_kt double")
    rows = {r["lat"]: r for r in grid.upslope(points, slopes).collect()}
    # Wind from the south climbs a slope that rises to the north.
    assert rows[35.33]["upslope_ms"] == pytest.approx(20 * 0.5144 * 50 / 111320)
    assert rows[33.5]["dh_dlat"] == pytest.approx(50.0)
    assert rows[10.0]["dh_dlat"] is None and rows[10.0]["upslope_ms"] == 0.0
    height = grid.sample(points, cells, ["elev"]).filter("lat = 35.33").first()["elev"]
    assert height == pytest.approx((35.33 - 33.5) / 0.2 * 10 + (-82.41 + 84.5) / 0.2 * 4)


def test_holes_take_the_mean_and_broken_grids_are_rejected(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, 2.0), ("b", 0, 0, 1.0)],
                                  "grid_id string, i int, j int, elev double")
    filled = grid.fill_holes(grid.complete(cells, 2, 2)).collect()
    assert {(r["grid_id"], r["i"], r["j"], r["elev"]) for r in filled} == {
        ("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, 2.0), ("a", 1, 1, 2.0)}


@pytest.mark.parametrize("hot", [10**6, 3])
def test_radius_join_equals_all_pairs(spark, hot):
    from hydrospark.functions.geo import haversine_mi

    # A third of the points share one place.
    points = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 35.5).otherwise(
        30 + F.rand(1) * 10).alias("lat"), F.when(F.col("id") % 3 == 0, -82.5).otherwise(
        -90 + F.rand(2) * 12).alias("lon")).cache()
    sites = spark.range(40).select(F.col("id").alias("site"), (30 + F.rand(3) * 10).alias("site_lat"),
                                   (-90 + F.rand(4) * 12).alias("site_lon")).cache()
    got = {(r["id"], r["site"]) for r in radius_join(points, sites, 60.0, hot_cell_rows=hot).collect()}
    every = points.crossJoin(sites).filter(
        haversine_mi("site_lat", "site_lon", "lat", "lon") <= 60.0)
    assert got == {(r["id"], r["site"]) for r in every.collect()} and got


def test_radius_join_at_the_poles_and_the_date_line(spark):
    from hydrospark.functions.geo import haversine_mi

    points = spark.range(2000).select("id", (F.rand(5) * 180 - 90).alias("lat"), (F.rand(6) * 360 - 180).alias("lon")) \
        .unionByName(spark.createDataFrame([(9000, 90.0, 10.0), (9001, 85.0, 179.99), (9002, -89.9, 0.0), (9003, None, 1.0)],
                                           "id long, lat double, lon double")).cache()
    sites = spark.range(150).select(F.col("id").alias("site"), (F.rand(7) * 180 - 90).alias("site_lat"),
                                    (F.rand(8) * 360 - 180).alias("site_lon")) \
        .unionByName(spark.createDataFrame([(900, 89.9, -170.0), (901, 85.0, -179.99), (902, -90.0, 0.0), (903, 0.0, 180.0)],
                                           "site long, site_lat double, site_lon double")).cache()
    for miles in (120.0, 900.0, 7000.0):
        got = [(r["id"], r["site"]) for r in radius_join(points, sites, miles, hot_cell_rows=100).collect()]
        every = points.crossJoin(sites).filter(haversine_mi("site_lat", "site_lon", "lat", "lon") <= miles)
        assert sorted(got) == sorted((r["id"], r["site"]) for r in every.collect())


def test_sites_as_a_table(spark, storms):
    sites = spark.createDataFrame([("home", dims.HOME_LAT, dims.HOME_LON), ("sea", 20.0, -50.1)],
                                  "site_id string, site_lat double, site_lon double")
    assert {(r["site_id"], r["storm_id"]) for r in tracks.near(storms, 150.0, sites).collect()} == {
        ("home", "a"), ("home", "b"), ("sea", "far")}
    assert {r["site_id"]: r["n_storms"] for r in tracks.climatology(storms, 150.0, sites=sites).collect()} == {
        "home": 2, "sea": 1}
    listed = {r["storm_id"]: r.asDict() for r in tracks.terrain_score(storms).collect()}
    tabled = {r["storm_id"]: r.asDict() for r in tracks.terrain_score(storms, sites=sites).collect() if r["site_id"] == "home"}
    assert tabled == listed
    assert tracks.closest_fix(storms, sites, radius_mi=150.0).count() == 3
    assert {r["storm_id"] for r in tracks.whole_tracks_near(storms, 150.0, sites).collect()} == {"a", "b", "far"}


def test_a_rejected_grid_keeps_every_storm(spark, storms):
    none = spark.createDataFrame([], "grid_id string, i int, j int, dh_dlat double, dh_dlon double")
    rows = tracks.terrain_score(storms, none).collect()
    assert {r["storm_id"] for r in rows} == {"a", "b"} and {r["upslope_w_ms"] for r in rows} == {0.0}


def test_the_nearest_of_a_radius_join_equal_the_first_of_all_pairs(spark):
    from hydrospark.functions.geo import haversine_mi
    from hydrospark.plans.pick import top_rows

    # Scattered points, one town, copies at one place, a pole, the date line and a row without a place.
    points = spark.range(1500).select("id", (F.rand(5) * 180 - 90).alias("lat"), (F.rand(6) * 360 - 180).alias("lon")) \
        .unionByName(spark.range(2000, 2600).select("id", (35 + F.rand(7) / 100).alias("lat"), (-82 + F.rand(8) / 100).alias("lon"))) \
        .unionByName(spark.range(3000, 3100).select("id", F.lit(35.0).alias("lat"), F.lit(-82.0).alias("lon"))) \
        .unionByName(spark.createDataFrame([(9000, 90.0, 10.0), (9001, 85.0, 179.99), (9002, -89.9, 0.0), (9003, None, 1.0)],
                                           "id long, lat double, lon double")).cache()
    sites = spark.range(60).select(F.col("id").alias("site"), (F.rand(9) * 180 - 90).alias("site_lat"),
                                   (F.rand(10) * 360 - 180).alias("site_lon")) \
        .unionByName(spark.createDataFrame(
            [(900, 89.9, -170.0), (901, 85.0, -179.99), (902, -90.0, 0.0), (903, 35.0, -82.0), (904, 35.0, -82.0),
             (905, -35.0, 98.0), (906, 35.02, -82.01), (907, None, 1.0)], "site long, site_lat double, site_lon double")).cache()
    for k, miles in ((1, 13000.0), (7, 13000.0), (7, 400.0)):
        got = radius_join(points, sites, miles, nearest=k, tie=["id"])
        every = points.crossJoin(sites).withColumn("distance_mi", haversine_mi("site_lat", "site_lon", "lat", "lon")).filter(
            F.col("distance_mi") <= miles)
        want = top_rows(every, ["site"], k, F.round("distance_mi", 6), "id")
        assert sorted((r["site"], r["id"]) for r in got.collect()) == sorted((r["site"], r["id"]) for r in want.collect())


def test_far_sites_do_not_meet_every_point(spark):
    from hydrospark.plans import spatial

    points = spark.range(4000).select("id", (30 + F.rand(1) * 5).alias("lat"), (-90 + F.rand(2) * 5).alias("lon")).cache()
    sites = spark.range(30).select(F.col("id").alias("site"), (70 + F.rand(3)).alias("site_lat"), (10 + F.rand(4)).alias("site_lon")).cache()
    met, distance = spark.sparkContext.accumulator(0), spatial.haversine_mi

    def counted(lat1, lon1, lat2, lon2):
        if lat2 != "lat":
            return distance(lat1, lon1, lat2, lon2)

        def seen(x):
            met.add(1)
            return x
        return distance(lat1, lon1, F.udf(seen, "double")(F.col(lat2)), lon2)

    spatial.haversine_mi = counted
    try:
        assert spatial.nearest_of_sites(points, sites, ["site"], ["id"]).count() == 30
    finally:
        spatial.haversine_mi = distance
    assert 0 < met.value < 30 * 4000 / 4


def test_nearest_to_fixed_sites_sorts_nothing(spark):
    from hydrospark.operators import hazards

    storms = spark.createDataFrame([("b", 35.0, -82.0), ("a", 35.0, -82.0), ("c", 36.0, -80.0), ("d", None, 1.0)],
                                   "name string, lat double, lon double")
    sites = [{"area_type": "x", "area_id": i, "site_lat": lat, "site_lon": -82.0} for i, lat in (("1", 35.1), ("2", 36.0), ("1", 35.0))]
    found = hazards.nearest_storm(storms, sites)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "hashpartitioning" not in plan
    assert {(r["area_id"], r["name"], r["distance_mi"]) for r in found.collect()} == {("1", "a", 0.0), ("2", "a", round(3958.7613 * 3.141592653589793 / 180, 6))}
    assert hazards.nearest_storm(storms.limit(0), sites).count() == 0


def test_radius_join_neither_broadcasts_copies_nor_merges_its_tasks(spark, tmp_path):
    spark.range(2000).select("id", (F.rand(1) * 5 + 30).alias("lat"), (F.rand(2) * 5 - 90).alias("lon")).write.parquet(str(tmp_path / "p"))
    spark.range(50).select(F.col("id").alias("site"), (F.rand(3) * 5 + 30).alias("site_lat"), (F.rand(4) * 5 - 90).alias("site_lon")) \
        .write.parquet(str(tmp_path / "s"))
    pairs = radius_join(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "s")), 60.0, hot_cell_rows=20)
    assert "SortMergeJoin [_cy" in pairs._jdf.queryExecution().executedPlan().toString()
    tasks = pairs.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
