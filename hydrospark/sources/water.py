"""River, tide and buoy feeds, published thresholds and forecast traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.base import number
from hydrospark.functions.hazard import c_to_f, m_to_ft, ms_to_kt, sea_state
from hydrospark.functions.base import half_even
from hydrospark.operators.timeseries import bucket_max
from hydrospark.schema import HISTORY_COLS, THRESHOLD_LEVELS
from hydrospark.sources.documents import parsed

# Parameter codes and their metrics.
CODES = {"00065": "stage_ft", "00060": "discharge_cfs", "00062": "pool_elevation_ft"}
SERIES = """value struct<timeSeries: array<struct<
  sourceInfo: struct<siteName: string>,
  variable: struct<variableCode: array<struct<value: string>>>,
  values: array<struct<value: array<struct<value: string, dateTime: string>>>>>>>"""


def _metric(code: Column) -> Column:
    pairs = [F.lit(x) for pair in CODES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), code)


def _series(df: DataFrame) -> DataFrame:
    keys = [c for c in df.columns if c != "value"]
    return parsed(df, SERIES).select(*keys, F.posexplode("doc.value.timeSeries").alias("pos", "s"))


def _readings(df: DataFrame) -> DataFrame:
    """Every reading of every series with its code, time and value; sentinels dropped."""
    keys = [c for c in df.columns if c != "value"]
    s = _series(df).select(*keys, "pos", F.get(F.col("s.variable.variableCode"), F.lit(0))["value"]
                           .alias("code"), F.get(F.col("s.values"), F.lit(0))["value"].alias("points"))
    out = s.select(*keys, "pos", "code", F.posexplode("points").alias("row", "p"))
    return out.select(*keys, "pos", "code", "row", F.try_to_timestamp("p.dateTime").alias("ts"),
                      number("p.value").alias("value"))


def daily_values(df: DataFrame, source: str = "usgs_dv") -> DataFrame:
    """History rows from daily-value documents (`site_id`, `value`)."""
    rows = _readings(df).withColumn("metric", _metric(F.col("code")))
    return rows.dropna(subset=["metric", "ts", "value"]).select(
        "ts", F.lit(source).alias("source"), F.lit("gauge").alias("entity_type"),
        F.col("site_id").alias("entity_id"), "metric", "value").select(*HISTORY_COLS)


def instant_points(df: DataFrame) -> DataFrame:
    """All readings of fifteen-minute documents, whatever their series."""
    return _readings(df).dropna(subset=["ts", "value"]).select("site_id", "ts", "value")


def hourly_maxima(df: DataFrame, source: str = "usgs_iv") -> DataFrame:
    """History rows with one hourly maximum per site, so that a crest is kept."""
    points = instant_points(df).withColumnRenamed("site_id", "entity_id")
    return bucket_max(points, 3600, ["entity_id"]).select(
        "ts", F.lit(source).alias("source"), F.lit("gauge").alias("entity_type"), "entity_id",
        F.lit("stage_ft").alias("metric"), "value").select(*HISTORY_COLS)


def trace(df: DataFrame) -> DataFrame:
    """Readings of the first series only, for the recent trace."""
    return _readings(df).filter(F.col("pos") == 0).dropna(subset=["ts", "value"]).select(
        "site_id", "ts", "value")


def latest_reading(df: DataFrame) -> DataFrame:
    """One row per document: site name, time and the last value of each code (sentinel to null)."""
    keys = [c for c in df.columns if c != "value"]
    doc = parsed(df, SERIES).select(*keys, F.col("doc.value.timeSeries").alias("s")).filter(
        F.size("s") > 0)
    last = F.transform("s", lambda t: F.struct(
        F.get(t["variable"]["variableCode"], F.lit(0))["value"].alias("code"),
        F.try_element_at(F.get(t["values"], F.lit(0))["value"], F.lit(-1)).alias("p")))
    usable = F.filter(last, lambda x: x["p"]["value"].try_cast("double").isNotNull())

    def of(code: str) -> Column:
        hits = F.filter("_last", lambda x: x["code"] == code)
        return number(F.try_element_at(hits, F.lit(-1))["p"]["value"])

    out = doc.withColumn("_last", usable)
    return out.select(
        *keys, F.get("s", F.lit(0))["sourceInfo"]["siteName"].alias("site_name"),
        F.try_to_timestamp(F.try_element_at("_last", F.lit(-1))["p"]["dateTime"]).alias("timestamp"),
        *[of(code).alias(metric) for code, metric in CODES.items()])


# ---- published levels and traces -------------------------------------------------------------

LEVELS = "struct<" + ", ".join(f"{c}: double" for c in THRESHOLD_LEVELS) + (
    ", lid: string, nws_name: string, units: string, usgs_label: string>")


def threshold_table(df: DataFrame) -> DataFrame:
    """Threshold rows from documents that map site ids to levels; undefined levels become null."""
    from hydrospark.operators.gauges import clean_levels

    sites = parsed(df, f"sites map<string, {LEVELS}>").select(
        F.explode("doc.sites").alias("site_id", "t"))
    return clean_levels(sites.select("site_id", "t.*"))


PUBLISHED = """usgsId string, lid string, name string, flood struct<stageUnits: string,
  categories: struct<action: struct<stage: double>, minor: struct<stage: double>,
    moderate: struct<stage: double>, major: struct<stage: double>>,
  crests: struct<historic: array<struct<stage: double>>>>"""


def published_levels(df: DataFrame) -> DataFrame:
    """Level payloads per site, ready for `gauges.extract_thresholds`."""
    d = parsed(df, PUBLISHED)
    return d.select(
        "site_id", F.col("doc.usgsId").alias("returned_id"), F.col("doc.lid").alias("lid"),
        F.coalesce("doc.flood.stageUnits", F.lit("ft")).alias("units"),
        *[F.col(f"doc.flood.categories.{c}.stage").alias(c) for c in THRESHOLD_LEVELS[:4]],
        F.col("doc.flood.crests.historic.stage").alias("crests"))


POINT = """array<struct<primary: string, stage: string, value: string, validTime: string,
  time: string, timestamp: string>>"""


def forecast_trace(df: DataFrame, shown: int = 120) -> DataFrame:
    """Official forecast per site: the first `shown` points and the peak over all of them."""
    d = parsed(df, f"issuedTime string, issued string, data {POINT}, forecast {POINT}")
    given = F.when(F.size("doc.data") > 0, F.col("doc.data")).otherwise(F.col("doc.forecast"))
    points = F.filter(F.transform(given, lambda p: F.struct(
        F.coalesce(p["validTime"], p["time"], p["timestamp"]).alias("t"),
        F.coalesce(number(p["primary"]), number(p["stage"]), number(p["value"])).alias("ft"))),
        lambda p: p["ft"].isNotNull() & (F.length(p["t"]) > 0))
    peak = F.aggregate("_p", F.lit(None).cast("struct<t: string, ft: double>"),
                       lambda best, p: F.when(best.isNull() | (p["ft"] > best["ft"]), p)
                       .otherwise(best))
    keys = [c for c in df.columns if c != "value"]
    return d.withColumn("_p", points).select(
        *keys, F.coalesce("doc.issuedTime", "doc.issued").alias("issued"),
        F.slice("_p", 1, shown).alias("points"), peak.alias("_peak")).select(
        *keys, "issued", "points", F.col("_peak.ft").alias("peak_ft"),
        F.col("_peak.t").alias("peak_t"))


# ---- buoys and tides -------------------------------------------------------------------------

def buoys(df: DataFrame) -> DataFrame:
    """Newest usable observation per station document (`station_id`, `value`).

    The first line names the columns, the second holds units, then rows run from the newest. A row
    counts if wave height, wind speed or pressure is known.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.length(F.trim(s)) > 0)
    d = df.withColumn("_lines", lines)
    d = d.withColumn("_head", F.split(F.trim(F.regexp_replace(F.get("_lines", F.lit(0)), "^#+", "")),
                                      r"\s+"))
    rows = F.transform(F.slice("_lines", 3, F.greatest(F.size("_lines") - 2, F.lit(0))),
                       lambda s: F.split(F.trim(s), r"\s+"))

    def at(parts: Column, name: str) -> Column:
        return number(F.get(parts, F.array_position("_head", name).cast("int") - 1))

    usable = F.filter("_rows", lambda p: (F.size(p) >= F.size("_head")) & F.coalesce(
        at(p, "WVHT"), at(p, "WSPD"), at(p, "PRES")).isNotNull())
    keys = [c for c in df.columns if c != "value"]
    # A filter on `_p` itself would be moved ahead of the columns it needs, and parse them anew for each of its uses.
    first = (d.withColumn("_rows", rows).withColumn("_usable", F.slice(usable, 1, 1))
             .withColumn("_p", F.explode_outer("_usable")).filter(F.col("_p").isNotNull()))
    raw = first.select(
        *keys, F.array_join(F.slice("_p", 1, 5), " ").alias("obs_time"),
        *[at(F.col("_p"), name).alias(column) for name, column in (
            ("WDIR", "wind_dir_deg"), ("WSPD", "wind_kt"), ("GST", "wind_gust_kt"),
            ("WVHT", "wave_ht_ft"), ("DPD", "dominant_period_s"), ("APD", "avg_period_s"),
            ("MWD", "wave_dir_deg"), ("PRES", "pressure_mb"), ("ATMP", "air_temp_f"),
            ("WTMP", "water_temp_f"))])
    return raw.withColumns({
        "wind_kt": ms_to_kt("wind_kt"), "wind_gust_kt": ms_to_kt("wind_gust_kt"),
        "wave_ht_ft": m_to_ft("wave_ht_ft"), "air_temp_f": half_even(c_to_f("air_temp_f"), 1),
        "water_temp_f": half_even(c_to_f("water_temp_f"), 1),
    }).withColumn("seas", sea_state("wave_ht_ft", "wind_kt"))


TIDE = "data array<struct<t: string, v: string, s: string, g: string, d: string>>"


def tides(df: DataFrame) -> DataFrame:
    """One row per station from its water level, pressure and wind documents (`station_id`,
    `product`, `value`), the last row of each."""
    last = parsed(df, TIDE).select(
        "station_id", "product", F.try_element_at("doc.data", F.lit(-1)).alias("r")).filter(
        F.col("r").isNotNull())

    def of(product: str, value: Column) -> Column:
        """From the newest of a station's documents of the product, whole."""
        return F.max_by(value, F.when(F.col("product") == product, F.coalesce("r.t", F.lit(""))))

    def timed(product: str) -> Column:
        return of(product, F.when(number("r.v").isNotNull(), F.col("r.t")))

    return last.groupBy("station_id").agg(
        of("water_level", number("r.v")).alias("water_level_ft"),
        timed("water_level").alias("water_level_t"),
        of("air_pressure", number("r.v")).alias("air_pressure_mb"),
        of("wind", number("r.s")).alias("wind_kt"), of("wind", number("r.g")).alias("wind_gust_kt"),
        of("wind", number("r.d")).alias("wind_dir_deg"), of("wind", F.col("r.t")).alias("wind_t"))
