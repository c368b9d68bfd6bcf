"""Fixed schemas and the metric vocabulary."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField,
    StructType, TimestampType,
)


def _fields(names: str, dtype) -> list[StructField]:
    return [StructField(n, dtype) for n in names.split()]


HISTORY = StructType([
    StructField("ts", TimestampType(), False),
    StructField("source", StringType(), False),
    StructField("entity_type", StringType(), False),
    StructField("entity_id", StringType(), False),
    StructField("metric", StringType(), False),
    StructField("value", DoubleType(), False),
])
HISTORY_COLS = HISTORY.fieldNames()
HISTORY_KEY = ["ts", "source", "entity_type", "entity_id", "metric"]
SERIES_KEY = ["entity_type", "entity_id", "metric"]

TRACK = StructType([
    StructField("storm_id", StringType()),
    StructField("name", StringType()),
    StructField("datetime", TimestampType()),
    StructField("year", IntegerType()),
    StructField("record_id", StringType()),
    StructField("status", StringType()),
    StructField("lat", DoubleType()),
    StructField("lon", DoubleType()),
    StructField("wind_kt", IntegerType()),
    StructField("pres_mb", IntegerType()),
])

THRESHOLD_LEVELS = ["action", "minor", "moderate", "major", "record"]
THRESHOLDS = StructType(
    [StructField("site_id", StringType())]
    + _fields(" ".join(THRESHOLD_LEVELS), DoubleType())
    + [StructField("lid", StringType()), StructField("units", StringType())]
)

# Best resolution first: a daily mean and an hourly maximum are different quantities.
SOURCE_PREFERENCE = ["usgs_iv", "snapshot", "usgs_dv", "open_meteo_archive"]

PRECIP_METRICS = ["wx_precip_in_24h", "wx_precip_in", "precip_in_24h"]
SOIL_TOP_METRICS = ["soil_era5_0_7cm", "soil_soil_moisture_top"]
SOIL_DEEP_METRICS = ["soil_era5_7_28cm", "soil_soil_moisture_root"]

# Numeric fields kept from each block of a nested snapshot.
GAUGE_FIELDS = ["stage_ft", "discharge_cfs", "rate_ft_per_hr", "pct_to_minor", "pct_to_major",
                "pool_elevation_ft"]
WEATHER_FIELDS = ["temp_f", "humidity_pct", "wind_mph", "wind_dir_deg", "pressure_mb", "precip_in",
                  "next_72h_precip_in"]
SOIL_FIELDS = ["soil_moisture_top", "soil_moisture_shallow", "soil_moisture_mid",
               "soil_moisture_root", "past_7d_precip_in"]
HAZARD_BLOCKS = {"fire_weather": "fire", "landslide": "landslide", "air_quality": "aqi"}
HAZARD_FIELDS = ["score", "us_aqi", "pm2_5", "pm10", "ozone"]
BUOY_FIELDS = ["wind_kt", "wind_gust_kt", "wind_dir_deg", "wave_ht_ft", "dominant_period_s",
               "avg_period_s", "pressure_mb", "air_temp_f", "water_temp_f"]
COASTAL_FIELDS = ["water_level_ft", "wind_kt", "wind_gust_kt", "wind_dir_deg", "air_pressure_mb"]


# A block of a snapshot: leaves stay text, so that numbers, quoted numbers and junk all reach the same coercion.
_BLOCK = MapType(StringType(), StringType())
_PLACE = [StructField(k, _BLOCK) for k in ("weather", "soil", *HAZARD_BLOCKS)]

SNAPSHOT = StructType([
    StructField("as_of_epoch", LongType()),
    StructField("index", StructType([
        StructField("score", StringType()),
        StructField("label", StringType()),
        StructField("components", MapType(StringType(), StringType())),
        StructField("triggers", MapType(StringType(), BooleanType())),
    ])),
    StructField("weather", _BLOCK),
    StructField("soil", _BLOCK),
    StructField("gauges", ArrayType(_BLOCK)),
    StructField("coastal", ArrayType(_BLOCK)),
    StructField("buoys", ArrayType(_BLOCK)),
    StructField("forests", ArrayType(StructType(
        [StructField("short", StringType())] + _PLACE
        + [StructField("districts_data", ArrayType(StructType(
            [StructField("name", StringType())] + _PLACE)))]))),
])
