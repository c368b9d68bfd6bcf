"""Parser queries: each row of a test table is rendered as a feed document and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.operators import gauges
from hydrospark.registry import query
from hydrospark.registry.tables import half_even_sql as he, miles_sql, plain_times, rounded, spread, table
from hydrospark.sources import tracks, water, weather


def events(spark, sf_dir):
    return spread(table(spark, sf_dir, "events"), "event_id", "ts", "user_id")


def parts(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice")


def text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def doc(*fields):
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def eid():
    return F.col("event_id")


def val():
    return F.col("value")


def uid():
    return F.col("user_id")


# ---- best tracks -----------------------------------------------------------------------------

@query("best_track_parse", """
SELECT 'AL' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '2024' AS storm_id, upper(event_type) AS name,
  date_trunc('minute', ts) AS datetime, CAST(year(ts) AS INTEGER) AS year, CASE WHEN event_id % 4 = 0 THEN 'L' ELSE '' END AS record_id, 'TS' AS status,
  (event_id % 400) / 10 * CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS lat,
  (event_id % 1500) / 10 * CASE WHEN event_id % 11 = 0 THEN 1 ELSE -1 END AS lon,
  CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 150 AS INTEGER) END AS wind_kt,
  CASE WHEN event_id % 6 > 0 THEN CAST(900 + event_id % 120 AS INTEGER) END AS pres_mb
FROM events""")
def best_track_parse(spark, sf_dir):
    lat = F.concat(text((eid() % 400) / 10), F.when(eid() % 7 == 0, "S").otherwise("N"))
    lon = F.concat(text((eid() % 1500) / 10), F.when(eid() % 11 == 0, "E").otherwise("W"))
    line = F.concat_ws(
        ", ", F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmm"),
        F.when(eid() % 4 == 0, "L").otherwise(" "), F.lit("TS"), lat, lon,
        F.when(eid() % 5 == 0, "-99").otherwise(text(eid() % 150)),
        F.when(eid() % 6 == 0, "-999").otherwise(text(900 + eid() % 120)), F.lit("-999,"))
    header = F.concat_ws(", ", F.concat(F.lit("AL"), F.lpad(text(uid() % 100), 2, "0"), F.lit("2024")),
                         F.upper("event_type"), F.lit("     2,"))
    block = F.concat_ws("\n", header, line, F.lit("20249999, bad line"),
                        F.lit("20240101, 9900,  , TS, x.0N, 85.5W, 30, 1000,"))
    return plain_times(tracks.parse_best_tracks(events(spark, sf_dir).select(block.alias("value"))))


HOME = ("35.5951", "-82.5515")


@query("active_storms_parse", f"""
SELECT event_id, 'AL' || CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS intensity_kt,
  round(20 + event_id % 30, 6)::DOUBLE AS lat, round(-90 + event_id % 40, 6)::DOUBLE AS lon,
  round({miles_sql(*HOME, '(20 + event_id % 30)', '(-90 + event_id % 40)')}, 6) AS distance_mi
FROM events WHERE event_type <> 'view'""")
def active_storms_parse(spark, sf_dir):
    lat, lon = (20 + eid() % 30).cast("double"), (-90 + eid() % 40).cast("double")
    storm = F.struct(
        F.concat(F.lit("AL"), text("user_id")).alias("id"), F.upper("event_type").alias("name"),
        F.when(F.col("event_type") == "view", "EP1").otherwise("AT1").alias("binNumber"),
        F.when(eid() % 3 == 0, "n/a").otherwise(text("value")).alias("intensity"),
        lat.alias("latitudeNumeric"), lon.alias("longitudeNumeric"))
    rows = events(spark, sf_dir).select("event_id", doc(F.array(storm).alias("activeStorms")).alias("value"))
    return rounded(tracks.active_storms(rows).select(
        "event_id", "id", "intensity_kt", "lat", "lon", "distance_mi"))


def _kml(shape, n, shift):
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(
        ",", text(-80.0 - (i + shift) / 8), text(30.0 + (i + shift) / 16), F.lit("0")))
    return F.concat(F.lit(f"<Placemark><styleUrl>#s</styleUrl><{shape}><coordinates>\n"),
                    F.array_join(points, " "), F.lit(f"\n</coordinates></{shape}></Placemark>"))


@query("kml_parse", """
SELECT event_id, 'AL' || CAST(event_id AS VARCHAR) AS id, CAST(least(40, 3 + user_id % 60) AS INTEGER) AS n_track,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE least(160, 5 + event_id % 200) END AS INTEGER) AS n_cone,
  30.0::DOUBLE AS first_lat, 30.0::DOUBLE + (2 + user_id % 60) / 16 AS last_lat
FROM events""")
def kml_parse(spark, sf_dir):
    """Two lines (the longer is the forecast) and, for two events in three, a cone."""
    e = events(spark, sf_dir).withColumn("id", F.concat(F.lit("AL"), text("event_id")))
    n = (uid() % 60 + 3).cast("int")
    track = F.concat(F.lit("<kml>"), _kml("LineString", F.lit(2), 9), _kml("LineString", n, 0),
                     _kml("Point", F.lit(1), 0), F.lit("</kml>"))
    cone = F.concat(F.lit("<kml>"), _kml("Polygon", (eid() % 200 + 5).cast("int"), 0), F.lit("</kml>"))
    docs = e.select(F.col("id").alias("storm_id"), F.explode(F.array(
        F.struct(F.lit("TRACK").alias("product"), track.alias("value")),
        F.struct(F.lit("CONE").alias("product"), F.when(eid() % 3 != 0, cone).alias("value")))
    ).alias("d")).select("storm_id", "d.*")
    out = tracks.attach_forecasts(e.select("event_id", "id"), tracks.graphics(docs))
    line = F.col("forecast_track")
    return out.select("event_id", "id", F.size(line).alias("n_track"), F.size("cone").alias("n_cone"),
                      line[0]["lat"].alias("first_lat"), F.element_at(line, -1)["lat"].alias("last_lat"))


@query("thin_points", """
WITH p AS (SELECT o_orderkey, range(1, o_custkey % 97 + 2) AS pts FROM orders)
SELECT o_orderkey, CASE WHEN len(pts) <= 40 THEN array_to_string(pts, ',')
  ELSE array_to_string(list_concat(list_transform(range(39), lambda i: pts[CAST(floor(i * (len(pts) / 40)) AS BIGINT) + 1]), [pts[-1]]), ',') END AS kept
FROM p""")
def thin_points(spark, sf_dir):
    points = F.sequence(F.lit(1), F.col("o_custkey") % 97 + 1)
    return table(spark, sf_dir, "orders").withColumn("pts", points).select(
        "o_orderkey", F.array_join(F.transform(tracks.thin(F.col("pts"), 40), text), ",").alias("kept"))


# ---- rivers ----------------------------------------------------------------------------------

def _series(code, values):
    return F.struct(
        F.struct(F.concat(F.lit("SITE "), text("user_id")).alias("siteName")).alias("sourceInfo"),
        F.struct(F.array(F.struct(F.lit(code).alias("value"))).alias("variableCode")).alias("variable"),
        F.array(F.struct(values.alias("value"))).alias("values"))


def _point(value, minutes):
    moment = F.date_format(F.timestamp_seconds(F.unix_timestamp("ts") + minutes * 60 - 4 * 3600),
                           "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.struct(value.alias("value"), F.concat(moment, F.lit("-04:00")).alias("dateTime"))


def river_documents(spark, sf_dir):
    """Per event a document with two stage readings, one of them a sentinel now and then, one flow
    and one unknown code."""
    second = F.when(eid() % 5 == 0, F.lit("-999999")).otherwise(text(val() + 1))
    series = F.array(
        _series("00065", F.array(_point(text("value"), 0), _point(second, 15))),
        _series("00060", F.array(_point(text(val() * 10), 0))),
        _series("00010", F.array(_point(F.lit("5"), 0))))
    e = events(spark, sf_dir)
    return e.select("event_id", text("user_id").alias("site_id"),
                    doc(F.struct(series.alias("timeSeries")).alias("value")).alias("value"))


@query("daily_values_parse", """
WITH r AS (SELECT date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS entity_id, 'stage_ft' AS metric, value FROM events
 UNION ALL SELECT date_trunc('second', ts) + INTERVAL 15 MINUTE, CAST(user_id AS VARCHAR), 'stage_ft', value + 1 FROM events WHERE event_id % 5 <> 0
 UNION ALL SELECT date_trunc('second', ts), CAST(user_id AS VARCHAR), 'discharge_cfs', value * 10 FROM events)
SELECT ts, 'usgs_dv' AS source, 'gauge' AS entity_type, entity_id, metric, round(value, 6) AS value FROM r""")
def daily_values_parse(spark, sf_dir):
    return rounded(water.daily_values(river_documents(spark, sf_dir)))


@query("instant_values_parse", """
WITH r AS (SELECT ts, user_id, value FROM events
 UNION ALL SELECT ts + INTERVAL 15 MINUTE, user_id, value + 1 FROM events WHERE event_id % 5 <> 0)
SELECT date_trunc('hour', ts) AS ts, 'usgs_iv' AS source, 'gauge' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id,
  'stage_ft' AS metric, round(max(value), 6) AS value FROM r GROUP BY 1, user_id""")
def instant_values_parse(spark, sf_dir):
    second = F.when(eid() % 5 == 0, F.lit("-999999")).otherwise(text(val() + 1))
    series = F.array(_series("00065", F.array(_point(text("value"), 0), _point(second, 15))))
    docs = events(spark, sf_dir).select(
        text("user_id").alias("site_id"), doc(F.struct(series.alias("timeSeries")).alias("value")).alias("value"))
    return rounded(water.hourly_maxima(docs))


@query("latest_reading_parse", """
SELECT event_id, CAST(user_id AS VARCHAR) AS site_id, 'SITE ' || CAST(user_id AS VARCHAR) AS site_name,
  date_trunc('second', ts) AS timestamp, CASE WHEN event_id % 5 <> 0 THEN round(value + 1, 6) END AS stage_ft,
  round(value * 10, 6) AS discharge_cfs, CAST(NULL AS DOUBLE) AS pool_elevation_ft FROM events""")
def latest_reading_parse(spark, sf_dir):
    return rounded(water.latest_reading(river_documents(spark, sf_dir)))


@query("history_trace_parse", """
SELECT CAST(user_id AS VARCHAR) AS site_id, date_trunc('second', ts) AS ts, round(value, 6) AS value FROM events
UNION ALL SELECT CAST(user_id AS VARCHAR), date_trunc('second', ts) + INTERVAL 15 MINUTE, round(value + 1, 6) FROM events WHERE event_id % 5 <> 0""")
def history_trace_parse(spark, sf_dir):
    return rounded(water.trace(river_documents(spark, sf_dir)))


@query("forecast_trace_parse", """
WITH n AS (SELECT event_id, 1 + event_id % 150 AS n, event_id % 13 AS k FROM events),
p AS (SELECT *, list_transform(range(n), lambda i: (i * 7 + k) % 40 / 4) AS ft FROM n)
SELECT event_id, 'now' AS issued, CAST(least(120, n) AS INTEGER) AS shown, list_max(ft) AS peak_ft,
  't' || CAST(list_position(ft, list_max(ft)) - 1 AS VARCHAR) AS peak_t FROM p""")
def forecast_trace_parse(spark, sf_dir):
    k = eid() % 13
    points = F.transform(F.sequence(F.lit(0).cast("bigint"), eid() % 150), lambda i: F.struct(
        F.when(i % 2 == 0, (i * 7 + k) % 40 / 4).alias("primary"), ((i * 7 + k) % 40 / 4).alias("stage"),
        F.concat(F.lit("t"), text(i)).alias("validTime")))
    docs = events(spark, sf_dir).select(
        "event_id", doc(F.lit("now").alias("issuedTime"), points.alias("data")).alias("value"))
    return water.forecast_trace(docs).select(
        "event_id", "issued", F.size("points").alias("shown"), "peak_ft", "peak_t")


@query("threshold_parse", """
SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_size > 5 THEN p_size::DOUBLE END AS action, 20.0::DOUBLE AS minor,
  p_retailprice AS record, p_name AS lid FROM part""")
def threshold_parse(spark, sf_dir):
    level = F.struct(
        F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).otherwise(-9999.0).alias("action"),
        F.lit(20.0).alias("minor"), F.col("p_retailprice").alias("record"), F.col("p_name").alias("lid"))
    docs = parts(spark, sf_dir).select(
        doc(F.create_map(text("p_partkey"), level).alias("sites")).alias("value"))
    return water.threshold_table(docs).select("site_id", "action", "minor", "record", "lid")


@query("threshold_defaults", """
SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_size > 5 THEN p_size::DOUBLE ELSE 6.5::DOUBLE END AS action, 20.0::DOUBLE AS minor,
  13.0::DOUBLE AS moderate, 18.0::DOUBLE AS major, p_retailprice AS record FROM part""")
def threshold_defaults(spark, sf_dir):
    """Published levels laid over the home site's, so that every level is present."""
    level = F.struct(
        F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).otherwise(-9999.0).alias("action"),
        F.lit(20.0).alias("minor"), F.col("p_retailprice").alias("record"))
    docs = parts(spark, sf_dir).select(
        doc(F.create_map(text("p_partkey"), level).alias("sites")).alias("value"))
    defaults = {"action": 6.5, "minor": 9.5, "moderate": 13.0, "major": 18.0, "record": 25.0}
    return gauges.with_defaults(water.threshold_table(docs), defaults).select("site_id", *defaults)


@query("threshold_rejects", """
SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_partkey % 9 = 0 THEN 'other site' ELSE 'not ascending' END AS reason
FROM part WHERE p_partkey % 9 = 0 OR p_size > 20""")
def threshold_rejects(spark, sf_dir):
    return gauges.extract_thresholds(water.published_levels(_published(spark, sf_dir)))[1]


@query("published_levels_parse", """
SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_size BETWEEN 6 AND 20 THEN p_size::DOUBLE END AS action, 20.0::DOUBLE AS minor,
  25.0::DOUBLE AS moderate, CAST(NULL AS DOUBLE) AS major, p_retailprice AS record FROM part WHERE p_partkey % 9 <> 0 AND NOT p_size > 20""")
def published_levels_parse(spark, sf_dir):
    return gauges.extract_thresholds(water.published_levels(_published(spark, sf_dir)))[0]


def _published(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    levels = F.struct(
        F.struct(F.when(size > 5, size.cast("double")).otherwise(-9999.0).alias("stage")).alias("action"),
        F.struct(F.lit(20.0).alias("stage")).alias("minor"),
        F.struct(F.lit(25.0).alias("stage")).alias("moderate"))
    crests = F.struct(F.array(F.struct(F.lit(-9999.0).alias("stage")),
                              F.struct(F.col("p_retailprice").alias("stage"))).alias("historic"))
    return parts(spark, sf_dir).select(
        text("p_partkey").alias("site_id"),
        doc(F.when(key % 9 == 0, "other").otherwise(text(key)).alias("usgsId"),
            F.struct(levels.alias("categories"), crests.alias("crests")).alias("flood")).alias("value"))


# ---- sea -------------------------------------------------------------------------------------

@query("buoy_parse", f"""
SELECT CAST(event_id AS VARCHAR) AS station_id, '2024 01 01 12 ' || CASE WHEN event_id % 4 = 0 THEN '40' ELSE '50' END AS obs_time,
  (event_id % 360)::DOUBLE AS wind_dir_deg, {he('(event_id % 40)::DOUBLE / 2 * 1.94384::DOUBLE', 1)} AS wind_kt,
  CASE WHEN event_id % 3 > 0 THEN {he('(user_id % 30)::DOUBLE / 4 * 3.28084::DOUBLE', 1)} END AS wave_ht_ft,
  1000 + (event_id % 40)::DOUBLE AS pressure_mb, {he('(event_id % 30)::DOUBLE * 9 / 5 + 32', 1)} AS water_temp_f
FROM events WHERE event_id % 10 > 0""")
def buoy_parse(spark, sf_dir):
    """Two observation rows; the newest is all missing for one event in four, both for one in ten."""
    gone = F.lit("MM MM MM MM MM MM MM MM MM MM MM")
    row = F.concat_ws(
        "  ", text(eid() % 360), text((eid() % 40) / 2), F.lit("MM"),
        F.when(eid() % 3 > 0, text((uid() % 30) / 4)).otherwise("MM"), F.lit("10.0 6.2 110"),
        text(1000 + eid() % 40), F.lit("22.0"), text(eid() % 30), F.lit("20.0"))
    first = F.when((eid() % 4 == 0) | (eid() % 10 == 0), gone).otherwise(row)
    second = F.when(eid() % 10 == 0, gone).otherwise(row)
    page = F.concat_ws(
        "\n", F.lit("#YY  MM DD hh mm WDIR WSPD GST  WVHT   DPD   APD MWD   PRES  ATMP  WTMP  DEWP"),
        F.lit("#yr  mo dy hr mn degT m/s  m/s     m   sec   sec degT   hPa  degC  degC  degC"),
        F.concat(F.lit("2024 01 01 12 50 "), first), F.lit(""),
        F.concat(F.lit("2024 01 01 12 40 "), second))
    docs = events(spark, sf_dir).select(text("event_id").alias("station_id"), page.alias("value"))
    return water.buoys(docs).select("station_id", "obs_time", "wind_dir_deg", "wind_kt",
                                    "wave_ht_ft", "pressure_mb", "water_temp_f")


@query("tide_parse", """
SELECT CAST(event_id AS VARCHAR) AS station_id, value AS water_level_ft, 'b' AS water_level_t,
  CASE WHEN event_id % 3 > 0 THEN round(1000 + value, 6) END AS air_pressure_mb, (user_id % 50)::DOUBLE AS wind_kt,
  CASE WHEN event_id % 2 = 0 THEN (user_id % 50)::DOUBLE + 5 END AS wind_gust_kt, 180.0::DOUBLE AS wind_dir_deg, 'w' AS wind_t FROM events""")
def tide_parse(spark, sf_dir):
    station = text("event_id").alias("station_id")
    level = doc(F.array(F.struct(F.lit("a").alias("t"), F.lit("9").alias("v")),
                        F.struct(F.lit("b").alias("t"), text("value").alias("v"))).alias("data"))
    pressure = doc(F.array(F.struct(F.lit("p").alias("t"), F.when(eid() % 3 > 0, text(val() + 1000))
                                    .otherwise("").alias("v"))).alias("data"))
    wind = doc(F.array(F.struct(
        F.lit("w").alias("t"), text(uid() % 50).alias("s"),
        F.when(eid() % 2 == 0, text(uid() % 50 + 5)).otherwise("").alias("g"), F.lit("180").alias("d"))).alias("data"))
    docs = events(spark, sf_dir).select(station, F.explode(F.create_map(
        F.lit("water_level"), level, F.lit("air_pressure"), pressure, F.lit("wind"), wind)).alias("product", "value"))
    out = water.tides(docs)
    return out.withColumn("air_pressure_mb", F.round("air_pressure_mb", 6))


# ---- weather ---------------------------------------------------------------------------------

@query("archive_parse", """
WITH d AS (SELECT event_id, value, DATE '2020-01-01' AS a FROM events),
r AS (SELECT event_id, CAST(a + CAST(i AS INTEGER) AS TIMESTAMP) AS ts, value, i FROM d, range(3) t(i))
SELECT ts, 'open_meteo_archive' AS source, 'point' AS entity_type, CAST(event_id AS VARCHAR) AS entity_id, m AS metric, round(v + 1e-9, 6) AS value FROM (
  SELECT event_id, ts, 'wx_precip_in_24h' AS m, (value + i) / 25.4::DOUBLE AS v FROM r WHERE i <> 1
  UNION ALL SELECT event_id, ts, 'wx_temp_max_f', value * 9 / 5 + 32 FROM r
  UNION ALL SELECT event_id, ts, 'wx_wind_max_mph', value * 0.621371::DOUBLE FROM r)""")
def archive_parse(spark, sf_dir):
    days = F.array(*[F.lit(f"2020-01-0{i + 1}") for i in range(3)])
    daily = F.struct(
        days.alias("time"),
        F.array(val(), F.lit(None).cast("double"), val() + 2).alias("precipitation_sum"),
        F.array(val(), val(), val()).alias("temperature_2m_max"),
        F.array(val(), val(), val()).alias("wind_speed_10m_max"))
    docs = events(spark, sf_dir).select(F.lit("point").alias("entity_type"), text("event_id").alias("entity_id"),
                                        doc(daily.alias("daily")).alias("value"))
    return rounded(weather.archive_daily(docs), nudge=1e-9)


@query("soil_daily_parse", """
SELECT TIMESTAMP '2024-09-27' + INTERVAL 1 DAY * d AS ts, 'open_meteo_archive' AS source, 'point' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id,
  'soil_era5_0_7cm' AS metric, round(avg(value / 1000 + h / 100), 6) AS value
FROM events, (VALUES (0, 0), (0, 2), (1, 3)) t(d, h) GROUP BY 1, user_id""")
def soil_daily_parse(spark, sf_dir):
    base = val() / 1000
    hourly = F.struct(
        F.array(*[F.lit(t) for t in ("2024-09-27T00:00", "2024-09-27T06:00", "2024-09-27T12:00",
                                     "2024-09-28T00:00")]).alias("time"),
        F.array(base, F.lit(None).cast("double"), base + 0.02, base + 0.03).alias("soil_moisture_0_to_7cm"))
    docs = events(spark, sf_dir).select(F.lit("point").alias("entity_type"), text("user_id").alias("entity_id"),
                                        doc(hourly.alias("hourly")).alias("value"))
    return rounded(weather.soil_daily(docs))


RAIN = "list_transform(range(96), lambda i: (event_id * 7 + i * 13) % 50 / 100)"
SUM = "list_reduce({}, lambda a, b: a + b)"


@query("weather_parse", f"""
WITH a AS (SELECT event_id, value, {RAIN}[1:72] AS rain FROM events)
SELECT event_id, value AS temp_f, (event_id % 100)::DOUBLE AS humidity_pct, {he(SUM.format('rain'), 2)} AS next_72h_precip_in,
  {he('list_max(list_transform(range(67), lambda i: ' + SUM.format('rain[i+1:i+6]') + '))', 2)} AS max_6h_precip_in,
  {he('list_max(list_transform(range(49), lambda i: ' + SUM.format('rain[i+1:i+24]') + '))', 2)} AS max_24h_precip_in,
  {he('list_max(rain)', 2)} AS peak_hour_precip_in, CAST(CASE WHEN list_max(rain) > 0 THEN list_position(rain, list_max(rain)) - 1 END AS INTEGER) AS peak_hour_index,
  CAST(24 AS INTEGER) AS n_times FROM a""")
def weather_parse(spark, sf_dir):
    hours = F.sequence(F.lit(0), F.lit(95))
    rain = F.transform(hours, lambda i: (eid() * 7 + i * 13) % 50 / 100)
    docs = events(spark, sf_dir).select("event_id", doc(
        F.struct(F.lit("t0").alias("time"), val().alias("temperature_2m"),
                 (eid() % 100).alias("relative_humidity_2m")).alias("current"),
        F.struct(F.transform(hours, lambda i: F.concat(F.lit("h"), text(i))).alias("time"),
                 rain.alias("precipitation")).alias("hourly")).alias("value"))
    return weather.current_weather(docs).select(
        "event_id", "temp_f", "humidity_pct", "next_72h_precip_in", "max_6h_precip_in",
        "max_24h_precip_in", "peak_hour_precip_in", "peak_hour_index",
        F.size("hourly_times").alias("n_times"))


@query("soil_air_parse", f"""
WITH s AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN (event_id % 60) / 100 END AS top, (user_id % 50) / 100 AS shallow,
    list_transform(range(192), lambda i: (event_id + i) % 9 / 100)[1:168] AS rain, event_id % 350 AS aqi FROM events)
SELECT event_id, {he('top', 3)} AS soil_moisture_top, {he('shallow', 3)} AS soil_moisture_shallow, {he(SUM.format('rain'), 2)} AS past_7d_precip_in,
  coalesce(top, shallow) >= 0.4::DOUBLE AS saturated, coalesce(top, shallow) < 0.15::DOUBLE AS very_dry,
  CASE WHEN coalesce(top, shallow) >= 0.4::DOUBLE THEN 'SATURATED' WHEN coalesce(top, shallow) >= 0.3::DOUBLE THEN 'wet'
       WHEN coalesce(top, shallow) >= 0.2::DOUBLE THEN 'moist' WHEN coalesce(top, shallow) < 0.15::DOUBLE THEN 'very dry' ELSE 'normal' END AS condition,
  CASE WHEN aqi >= 300 THEN 'HAZARDOUS' WHEN aqi >= 200 THEN 'VERY UNHEALTHY' WHEN aqi >= 150 THEN 'UNHEALTHY' WHEN aqi >= 100 THEN 'UNHEALTHY SENS.'
       WHEN aqi >= 50 THEN 'MODERATE' ELSE 'GOOD' END AS label
FROM s""")
def soil_air_parse(spark, sf_dir):
    rain = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: (eid() + i) % 9 / 100)
    e = events(spark, sf_dir)
    soil = weather.current_soil(e.select("event_id", doc(
        F.struct(F.when(eid() % 4 > 0, (eid() % 60) / 100).alias("soil_moisture_0_to_1cm"),
                 ((uid() % 50) / 100).alias("soil_moisture_1_to_3cm")).alias("current"),
        F.struct(rain.alias("precipitation")).alias("hourly")).alias("value")))
    air = weather.current_air(e.select("event_id", doc(
        F.struct((eid() % 350).alias("us_aqi")).alias("current")).alias("value")))
    return soil.join(air.select("event_id", "label"), "event_id").select(
        "event_id", "soil_moisture_top", "soil_moisture_shallow", "past_7d_precip_in", "saturated",
        "very_dry", "condition", "label")


@query("alerts_parse", """
SELECT event_id, event_type AS event, 'Severe' AS severity, '' AS headline FROM events
UNION ALL SELECT event_id, 'Flood Watch', '', 'h' || CAST(user_id AS VARCHAR) FROM events WHERE event_id % 3 = 0""")
def alerts_parse(spark, sf_dir):
    def feature(event, severity, headline):
        return F.struct(F.struct(event.alias("event"), severity.alias("severity"),
                                 headline.alias("headline")).alias("properties"))

    none = F.lit(None).cast("string")
    one = feature(F.col("event_type"), F.lit("Severe"), none)
    two = feature(F.lit("Flood Watch"), none, F.concat(F.lit("h"), text("user_id")))
    listed = F.when(eid() % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    docs = events(spark, sf_dir).select("event_id", doc(listed.alias("features")).alias("value"))
    return weather.alerts(docs).select("event_id", "event", "severity", "headline")


@query("incident_parse", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Unnamed' ELSE event_type END AS name, value AS acres,
  CASE WHEN event_id % 2 = 0 THEN (user_id % 100)::DOUBLE END AS contained_pct, 35.0::DOUBLE + event_id % 3 AS lat, -82.0::DOUBLE AS lon,
  CASE WHEN event_id % 3 > 0 THEN CAST(2000 + user_id % 25 AS INTEGER) END AS year FROM events WHERE event_id % 7 > 0""")
def incident_parse(spark, sf_dir):
    where = F.struct(F.when(eid() % 7 > 0, F.lit(-82.0)).alias("x"), (eid() % 3 + 35.0).alias("y"))
    fire = F.struct(
        F.struct(F.when(eid() % 5 > 0, F.col("event_type")).alias("IncidentName"), val().alias("DailyAcres"),
                 F.when(eid() % 2 == 0, uid() % 100).alias("PercentContained")).alias("attributes"),
        where.alias("geometry"))
    slide = F.struct(F.struct(F.when(eid() % 3 > 0, 2000 + uid() % 25).alias("Year")).alias("attributes"),
                     where.alias("geometry"))
    e = events(spark, sf_dir)
    fires = weather.fires(e.select("event_id", doc(F.array(fire).alias("features")).alias("value")))
    slides = weather.landslides(e.select("event_id", doc(F.array(slide).alias("features")).alias("value")))
    return fires.join(slides.select("event_id", "year"), "event_id").select(
        "event_id", "name", "acres", "contained_pct", "lat", "lon", "year")
