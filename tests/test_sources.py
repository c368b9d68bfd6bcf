import datetime as dt
import io
import zipfile

import pytest

from hydrospark import dims
from hydrospark.operators import gauges
from hydrospark.sources import documents, tracks, water, weather

BEST = """AL092023,            IDALIA,      2,
20230826, 1200,  , TD, 18.0N,  85.5W,  30, 1006, 0, 0,
20230830, 1145, L, HU, 29.8N,  83.4W, 100,  950, 0, 0,
AL102023,             NEXT,      3,
20230901, 0000,  , TS, 10.0S,  20.0E, -99, -999, 0, 0,
20239901, 0000,  , TS, 10.0S,  20.0E,  40,  990, 0, 0,
broken
"""


def check_best(df):
    rows = {(r["storm_id"], str(r["datetime"])): r for r in df.collect()}
    assert len(rows) == 3
    a = rows[("AL092023", "2023-08-30 11:45:00")]
    assert (a["name"], a["record_id"], a["status"], a["lat"], a["lon"], a["wind_kt"], a["pres_mb"]) == (
        "IDALIA", "L", "HU", 29.8, -83.4, 100, 950)
    b = rows[("AL102023", "2023-09-01 00:00:00")]
    assert (b["lat"], b["lon"], b["wind_kt"], b["pres_mb"], b["year"]) == (-10.0, 20.0, None, None, 2023)


def test_best_tracks(spark, docs, tmp_path):
    check_best(tracks.parse_best_tracks(docs(BEST)))
    (tmp_path / "best.txt").write_text(BEST)
    check_best(tracks.best_tracks(spark, str(tmp_path)))


def test_active_storms_keep_the_atlantic(docs):
    payload = {"activeStorms": [
        {"id": "AL09", "name": "T", "binNumber": "AT1", "intensity": "85", "latitudeNumeric": 30.0,
         "longitudeNumeric": -82.0, "publicAdvisory": {"url": "u"}},
        {"id": "EP01", "name": "P", "binNumber": "EP1", "latitudeNumeric": 15.0, "longitudeNumeric": -110.0}]}
    rows = tracks.active_storms(docs(payload)).collect()
    assert [(r["id"], r["intensity_kt"], r["public_advisory_url"]) for r in rows] == [("AL09", 85.0, "u")]
    assert 380 < rows[0]["distance_mi"] < 400


def mark(shape, pairs):
    return (f"<Placemark><{shape}><coordinates>\n" + " ".join(f"{x},{y},0" for x, y in pairs)
            + f"\n</coordinates></{shape}></Placemark>")


LINE = [(-61.0, 14.0), (-62.5, 15.25), (-64.0, 16.0), (-66.25, 17.5), (-68.0, 19.75)]


def test_graphics(spark, docs, tmp_path):
    track = "<kml>" + mark("LineString", LINE[:3]) + mark("LineString", LINE) + mark("Point", LINE[:1]) + "</kml>"
    bad = mark("LineString", [(-70.5, 21.0), (500, -400), (-71.5, 22.0)])
    for name, text in (("AL09_TRACK", track), ("AL10_TRACK", bad)):
        with zipfile.ZipFile(tmp_path / f"{name}_latest.kmz", "w") as z:
            z.writestr("storm.kml", text)
    (tmp_path / "AL11_TRACK_latest.kmz").write_bytes(b"not a zip")
    cone = io.BytesIO()
    with zipfile.ZipFile(cone, "w") as z:
        z.writestr("c.kml", "<coordinates>" + " ".join(f"{-80 - i / 100},{30 + i / 100},0" for i in range(500)) + "</coordinates>")
    (tmp_path / "AL09_CONE_latest.kmz").write_bytes(cone.getvalue())
    shapes = tracks.graphics(tracks.read_graphics(spark, str(tmp_path))).cache()
    got = {(r["storm_id"], r["product"]): r["points"] for r in shapes.collect()}
    assert len(got[("AL09", "TRACK")]) == 5 and tuple(got[("AL09", "TRACK")][0]) == (14.0, -61.0)
    assert len(got[("AL10", "TRACK")]) == 2 and got[("AL11", "TRACK")] == []
    thinned = got[("AL09", "CONE")]
    assert len(thinned) == 160 and thinned[0]["lat"] == 30.0 and thinned[-1]["lat"] == pytest.approx(34.99)
    storms = spark.createDataFrame([("al09",), ("zz",)], "id string")
    both = {r["id"]: r for r in tracks.attach_forecasts(storms, shapes).collect()}
    assert len(both["al09"]["cone"]) == 160 and both["zz"]["cone"] == []


def river(*series):
    return {"value": {"timeSeries": [
        {"sourceInfo": {"siteName": "RIVER"}, "variable": {"variableCode": [{"value": code}]},
         "values": [{"value": [{"value": v, "dateTime": t} for v, t in points]}]} for code, points in series]}}


def test_daily_values_drop_sentinels(spark, tmp_path):
    import json

    payload = river(("00065", [("2.10", "2024-09-25T00:00:00.000"), ("8.50", "2024-09-26T00:00:00.000"),
                               ("-999999", "2024-09-28T00:00:00.000"), ("1", None)]),
                    ("00060", [("750", "2024-09-25T00:00:00.000")]), ("99999", [("1", "2024-09-25T00:00:00.000")]))
    (tmp_path / "03451500.json").write_text(json.dumps(payload))
    (tmp_path / "03443000.json").write_text("{broken")
    out = water.daily_values(documents.read(spark, str(tmp_path), site_id=r"/(\d+)\.json$"))
    got = {(str(r["ts"])[:10], r["entity_id"], r["metric"], r["value"]) for r in out.collect()}
    assert got == {("2024-09-25", "03451500", "stage_ft", 2.1), ("2024-09-26", "03451500", "stage_ft", 8.5),
                   ("2024-09-25", "03451500", "discharge_cfs", 750.0)}


def test_hourly_maximum_with_offsets(docs):
    points = [(v, f"2024-09-27T17:{m}:00.000-04:00") for v, m in (("20.0", "00"), ("22.0", "15"), ("24.82", "30"), ("24.0", "45"))]
    rows = water.hourly_maxima(docs(river(("00065", points)), site_id="a")).collect()
    assert [(str(r["ts"]), r["value"], r["source"]) for r in rows] == [("2024-09-27 21:00:00", 24.82, "usgs_iv")]


def test_latest_reading(docs):
    payload = river(("00065", [("1.2", "2026-05-05T13:00:00.000-04:00"), ("1.6", "2026-05-05T13:30:00.000-04:00")]),
                    ("00060", [("-999999", "2026-05-05T13:30:00.000-04:00")]))
    r = water.latest_reading(docs(payload, site_id="a")).first()
    assert (r["stage_ft"], r["discharge_cfs"], r["pool_elevation_ft"], r["site_name"]) == (1.6, None, None, "RIVER")


def test_forecast_trace_keeps_zero_and_peaks_over_all(docs):
    points = [{"primary": 0.0, "stage": 9.0, "validTime": "t0"}] + [
        {"stage": i / 10, "time": f"t{i}"} for i in range(1, 200)] + [{"primary": "x", "validTime": "bad"}]
    r = water.forecast_trace(docs({"issuedTime": "now", "data": points}, site_id="a")).first()
    assert len(r["points"]) == 120 and r["points"][0]["ft"] == 0.0
    assert (r["peak_ft"], r["peak_t"]) == (19.9, "t199")


def test_buoys(docs):
    head = "#YY  MM DD hh mm WDIR WSPD GST  WVHT   DPD   APD MWD   PRES  ATMP  WTMP\n#yr  mo dy hr mn degT m/s m/s m sec sec degT hPa degC degC\n"
    gone = "2031 11 03 07 20   MM   MM   MM    MM    MM    MM  MM     MM    MM    MM\n"
    good = "2031 11 03 07 10  205  6.0  7.5   3.0   8.0   5.1 190  1009.2  17.5  19.0\n"
    r = water.buoys(docs(head + gone + good, station_id="b7")).first()
    assert (r["wind_dir_deg"], r["wind_kt"], r["wave_ht_ft"], r["pressure_mb"], r["water_temp_f"]) == (
        205.0, 11.7, 9.8, 1009.2, 66.2)
    assert r["obs_time"] == "2031 11 03 07 10" and r["seas"] == "ROUGH"
    assert water.buoys(docs(head + gone, station_id="x")).count() == 0


def test_tides(spark):
    rows = [("s", "water_level", '{"data":[{"t":"a","v":"9"},{"t":"b","v":"1.23"}]}'),
            ("s", "wind", '{"data":[{"t":"w","s":"10.5","g":"","d":"180"}]}'), ("q", "air_pressure", '{"data":[]}')]
    got = water.tides(spark.createDataFrame(rows, "station_id string, product string, value string")).collect()
    assert [(r["water_level_ft"], r["water_level_t"], r["wind_kt"], r["wind_gust_kt"]) for r in got] == [
        (1.23, "b", 10.5, None)]


def test_archive_and_soil(docs):
    daily = {"daily": {"time": ["2024-09-26", "2024-09-27"], "precipitation_sum": [25.4, None],
                       "temperature_2m_max": [25.0, 20.0]}}
    keys = {"entity_type": "point", "entity_id": "w"}
    got = {(str(r["ts"])[:10], r["metric"]): r["value"] for r in weather.archive_daily(docs(daily, **keys)).collect()}
    assert got == {("2024-09-26", "wx_precip_in_24h"): pytest.approx(1.0), ("2024-09-26", "wx_temp_max_f"): 77.0,
                   ("2024-09-27", "wx_temp_max_f"): 68.0}
    hourly = {"hourly": {"time": ["2024-09-27T00:00", "2024-09-27T06:00", "2024-09-27T12:00", "2024-09-28T00:00"],
                         "soil_moisture_0_to_7cm": [0.50, None, 0.54, 0.48]}}
    got = {str(r["ts"])[:10]: r["value"] for r in weather.soil_daily(docs(hourly, **keys)).collect()}
    assert got == {"2024-09-27": pytest.approx(0.52), "2024-09-28": pytest.approx(0.48)}


def test_current_payloads(docs):
    payload = {"current": {"time": "t", "temperature_2m": 72.5, "relative_humidity_2m": 55},
               "hourly": {"precipitation": [0.05] * 72 + [9.0] * 24, "temperature_2m": [70.0, None, 71.0],
                          "relative_humidity_2m": [50, 50, None], "time": ["a", "b", "c"]}}
    r = weather.current_weather(docs(payload)).first()
    assert (r["temp_f"], r["next_72h_precip_in"], r["max_6h_precip_in"], r["peak_hour_index"]) == (72.5, 3.6, 0.3, 0)
    assert len(r["hourly_temp_f"]) == 2 and len(r["hourly_wet_bulb_f"]) == 1
    empty = weather.current_weather(docs({})).first()
    assert empty["temp_f"] is None and empty["next_72h_precip_in"] == 0.0 and empty["heat_category"] == "Unknown"
    soil = weather.current_soil(docs({"current": {"soil_moisture_0_to_1cm": 0.42},
                                      "hourly": {"precipitation": [0.05] * 168 + [1.0] * 24}})).first()
    assert (soil["saturated"], soil["condition"], soil["past_7d_precip_in"]) == (True, "SATURATED", 8.4)
    assert weather.current_air(docs({"current": {"us_aqi": 160}})).first()["label"] == "UNHEALTHY"


def test_alerts_and_incidents(docs):
    a = weather.alerts(docs({"features": [{"properties": {"event": "Flood Watch"}}]})).first()
    assert (a["event"], a["severity"]) == ("Flood Watch", "")
    fires = {"features": [{"attributes": {"DailyAcres": 350.0}, "geometry": {"x": -82.3, "y": 35.78}},
                          {"attributes": {"IncidentName": "Gone"}, "geometry": {"x": None, "y": None}}]}
    assert [(r["name"], r["acres"]) for r in weather.fires(docs(fires)).collect()] == [("Unnamed", 350.0)]


def test_thresholds(spark, docs):
    table = {r["site_id"]: r for r in water.threshold_table(docs(
        {"sites": {"a": {"action": -9999, "minor": 15.0}, "b": {"action": 1.0}}})).collect()}
    assert table["a"]["action"] is None and table["a"]["minor"] == 15.0

    def published(site, returned, *stages):
        return {"usgsId": returned, "flood": {
            "categories": {n: {"stage": v} for n, v in zip(("action", "minor", "moderate", "major"), stages)},
            "crests": {"historic": [{"stage": -9999}, {"stage": 24.82}]}}}

    df = docs(published("a", "a", 6.5, 9.5, 13.0, 18.0), site_id="a").unionByName(
        docs(published("b", "z", 1.0, 2.0, 3.0, 4.0), site_id="b")).unionByName(
        docs(published("c", "c", 5.0, 2.0, -9999, 4.0), site_id="c")).unionByName(
        docs(published("d", "d", -9999, -9999, -9999, -9999), site_id="d"))
    good, bad = gauges.extract_thresholds(water.published_levels(df))
    assert [(r["site_id"], r["record"]) for r in good.collect()] == [("a", 24.82)]
    assert {r["site_id"]: r["reason"] for r in bad.collect()} == {
        "b": "other site", "c": "not ascending", "d": "no levels"}


def test_shipped_registry_is_clean(spark):
    from pyspark.sql import functions as F

    forests = dims.areas(spark).filter("area_type = 'forest'").select(F.col("area_id").alias("forest"), "lat", "lon")
    found = gauges.registry_checks(dims.gauges(spark), dims.forest_gauges(spark), forests, dims.thresholds(spark))
    kinds = {r["check"] for r in found.collect()}
    assert kinds <= {"label_conflict"}
    assert dims.upstream_edges(spark).count() == 4
    assert dims.weather_points(spark).count() == 13 and dims.stations(spark).count() == 14


def test_network_state(spark):
    start = dt.datetime(2026, 5, 5)
    rows = [("03451500", start + dt.timedelta(minutes=15 * i), "stage_ft", 1.0 + i / 8) for i in range(40)]
    rows += [("02087182", start, "pool_elevation_ft", 266.5), ("99", start, "stage_ft", 14.94)]
    history = spark.createDataFrame(rows, "entity_id string, ts timestamp, metric string, value double")
    sites = spark.createDataFrame(
        [("03451500", "A", 35.6, -82.6, "primary"), ("02087182", "L", 35.9, -78.6, "reservoir"),
         ("99", "N", 0.0, 0.0, "statewide"), ("none", "X", 0.0, 0.0, "statewide")],
        "site_id string, label string, lat double, lon double, role string")
    got = {r["site_id"]: r for r in gauges.network_state(history, sites, dims.thresholds(spark)).collect()}
    a = got["03451500"]
    assert a["rate_ft_per_hr"] == pytest.approx(0.5) and a["eta_minor_hr"] == pytest.approx((9.5 - 5.875) / 0.5)
    assert len(a["history"]) == 40 and a["flood_category"] == "below action"
    lake = got["02087182"]
    assert (lake["flood_category"], lake["display_units"], lake["eta_minor_hr"]) == ("MODERATE FLOOD", "ft pool elev", None)
    assert (got["99"]["flood_category"], got["none"]["flood_category"]) == ("no thresholds", "unknown")


def test_stage_history(spark):
    from pyspark.sql import functions as F

    first = dt.datetime(2021, 6, 1)
    n = 7581
    rows = spark.range(n).select(
        F.lit("03451500").alias("entity_id"), F.lit("usgs_iv").alias("source"),
        F.timestamp_seconds(F.lit(int(first.replace(tzinfo=dt.timezone.utc).timestamp())) + F.col("id") * 21600).alias("ts"),
        (1.5 + (F.col("id") % 24) * 0.01).alias("value"))
    spike = F.col("ts") == F.lit("2024-09-27 00:00:00").cast("timestamp")
    rows = rows.withColumn("value", F.when(spike, 18.47).otherwise(F.col("value")))
    current = spark.createDataFrame([("03451500", 1.7)], "entity_id string, current_ft double")
    r = gauges.stage_history(rows, current, dims.thresholds(spark), "2024-09-27").first()
    assert (r["event_ft"], str(r["event_day"]), r["n_observations"]) == (18.47, "2024-09-27", n)
    assert r["daily_mean_series"] and r["axis_max"] >= 24.82 and 0 < r["percentile"] <= 100


def test_forecast_shapes_are_not_broadcast(spark, tmp_path):
    """Spark takes the size of a small file for that of the long lists parsed from it."""
    kml = ("<kml><Placemark><LineString><coordinates>-80,30,0 -81,31,0</coordinates></LineString></Placemark>"
           "<Placemark><Point><coordinates>-80,30,0</coordinates></Point></Placemark></kml>")
    area = "<kml><Placemark><Point><coordinates>-70,20,0</coordinates></Point></Placemark></kml>"
    rows = [("AL1", "TRACK", kml), ("AL1", "CONE", area), ("AL2", None, kml.replace("LineString", "Polygon")), ("AL3", "CONE", None)]
    spark.createDataFrame(rows, "storm_id string, product string, value string").write.parquet(str(tmp_path / "docs"))
    storms = spark.createDataFrame([("al1",), ("AL4",)], "id string")
    shapes = tracks.graphics(spark.read.parquet(str(tmp_path / "docs")))
    got = {(r["storm_id"], r["product"]): [tuple(p) for p in r["points"]] for r in shapes.collect()}
    assert got == {("AL1", "TRACK"): [(30.0, -80.0), (31.0, -81.0)], ("AL1", "CONE"): [(20.0, -70.0)],
                   ("AL2", None): [(30.0, -80.0), (31.0, -81.0)], ("AL3", "CONE"): []}
    out = tracks.attach_forecasts(storms, shapes)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: (len(r["forecast_track"]), len(r["cone"])) for r in out.collect()} == {"al1": (2, 1), "AL4": (0, 0)}


def test_rows_of_one_small_file_are_rendered_and_parsed_by_all_tasks(spark, tmp_path):
    from pyspark.sql.functions import spark_partition_id

    from hydrospark.registry import load_all

    events = [(i, dt.datetime(2024, 1, 1), i % 7, "view", 1.0, "{}") for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    parts = [(i, "n", 10, 1.0) for i in range(1, 401)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double") \
        .coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("weather_parse", "buoy_parse", "forecast_trace_parse", "published_levels_parse"):
        out = load_all()[name].run(spark, str(tmp_path))
        before = out._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[-1]
        assert not [x for x in ("json", "split", "lambda") if x in before], name
        tasks = out.select(spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1, name
