"""Weather, soil and air payloads, archives, alerts and incident features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import hazard
from hydrospark.functions.base import half_even, number, settle
from hydrospark.operators.hazards import first_sum, hourly_slices
from hydrospark.schema import HISTORY_COLS
from hydrospark.sources.documents import parsed

ARCHIVE_VARIABLES = {
    "precipitation_sum": ("wx_precip_in_24h", hazard.mm_to_in),
    "temperature_2m_max": ("wx_temp_max_f", hazard.c_to_f),
    "temperature_2m_min": ("wx_temp_min_f", hazard.c_to_f),
    "wind_speed_10m_max": ("wx_wind_max_mph", hazard.kmh_to_mph),
}
SOIL_VARIABLES = {"soil_moisture_0_to_7cm": "soil_era5_0_7cm",
                  "soil_moisture_7_to_28cm": "soil_era5_7_28cm"}
SOURCE = "open_meteo_archive"


def _arrays(names, lead: str = "time: array<string>") -> str:
    return f"struct<{lead}, " + ", ".join(f"{n}: array<string>" for n in names) + ">"


def _zipped(block: str, names) -> Column:
    """Parallel arrays as one array of rows; an absent array gives nulls, not an absent result."""
    none = F.array().cast("array<string>")
    return F.arrays_zip(*[F.coalesce(F.col(f"doc.{block}.{c}"), none).alias(c)
                          for c in ("time", *names)])


def archive_daily(df: DataFrame) -> DataFrame:
    """History rows from daily archive documents (`entity_type`, `entity_id`, `value`), converted to
    feet-and-Fahrenheit units. Parallel arrays are zipped and exploded once."""
    d = parsed(df, "daily " + _arrays(ARCHIVE_VARIABLES))
    rows = d.select("entity_type", "entity_id",
                    F.explode(_zipped("daily", ARCHIVE_VARIABLES)).alias("r"))
    cells = F.array(*[F.struct(F.lit(metric).alias("metric"), convert(number(f"r.{name}")).alias("value"))
                      for name, (metric, convert) in ARCHIVE_VARIABLES.items()])
    out = rows.select(F.try_to_timestamp("r.time").alias("ts"), F.lit(SOURCE).alias("source"),
                      "entity_type", "entity_id", F.explode(cells).alias("c"))
    return out.select("ts", "source", "entity_type", "entity_id", "c.*").dropna(
        subset=["ts", "value"]).select(*HISTORY_COLS)


def soil_daily(df: DataFrame) -> DataFrame:
    """History rows with the daily mean of hourly soil documents."""
    d = parsed(df, "hourly " + _arrays(SOIL_VARIABLES))
    rows = d.select("entity_type", "entity_id",
                    F.explode(_zipped("hourly", SOIL_VARIABLES)).alias("r"))
    cells = F.array(*[F.struct(F.lit(metric).alias("metric"), number(f"r.{name}").alias("value"))
                      for name, metric in SOIL_VARIABLES.items()])
    day = F.try_to_timestamp(F.substring("r.time", 1, 10))
    out = rows.select(day.alias("ts"), "entity_type", "entity_id", F.explode(cells).alias("c"))
    means = (out.select("ts", "entity_type", "entity_id", "c.*").dropna(subset=["ts", "value"])
             .groupBy("ts", "entity_type", "entity_id", "metric").agg(F.avg("value").alias("value")))
    return means.withColumn("source", F.lit(SOURCE)).select(*HISTORY_COLS)


CURRENT = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m",
           "wind_direction_10m", "pressure_msl", "weather_code", "dew_point_2m",
           "apparent_temperature"]
HOURLY = ["precipitation", "temperature_2m", "apparent_temperature", "relative_humidity_2m"]


def _largest_totals(values: Column, widths: Sequence[int]) -> Column:
    """For each width the largest sum of so many neighbouring elements, or the sum of a shorter list; lists of one
    length are added up together, each sum from its first element on."""
    @F.pandas_udf("array<double>")
    def totals(lists: pd.Series) -> pd.Series:
        sizes = lists.map(len).to_numpy()
        out = np.empty((len(lists), len(widths)))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            table = np.array([lists.iloc[i] for i in rows], dtype=float).reshape(len(rows), size)
            for at, width in enumerate(widths):
                wide = min(width, int(size))
                sums = np.zeros((len(rows), int(size) - wide + 1))
                for i in range(wide):
                    sums = sums + table[:, i:i + sums.shape[1]]
                out[rows, at] = sums.max(axis=1)
        return pd.Series(list(out), dtype=object)

    return totals(values)


def current_weather(df: DataFrame) -> DataFrame:
    """One row per weather document: present values, heat stress, rain totals and hourly slices."""
    fields = ", ".join(f"{c}: string" for c in CURRENT)
    d = parsed(df, f"current struct<time: string, {fields}>, hourly {_arrays(HOURLY)}")
    keys = [c for c in df.columns if c != "value"]

    def numbers(name: str) -> Column:
        # Texts become numbers once each, since `number` names its value several times.
        read = F.transform(F.col(f"doc.hourly.{name}"), lambda v: v.try_cast("double"))
        return F.coalesce(F.transform(read, number),
                          F.array().cast("array<double>"))

    rain = F.transform(F.slice(numbers("precipitation"), 1, 72), lambda v: F.coalesce(v, F.lit(0.0)))
    named = dict(zip(CURRENT, ["temp_f", "humidity_pct", "precip_in", "wind_mph", "wind_dir_deg",
                               "pressure_mb", "weather_code", "dew_point_f", "apparent_temp_f"]))
    out = d.select(
        *keys, F.col("doc.current.time").alias("as_of"),
        *[number(f"doc.current.{c}").alias(n) for c, n in named.items()],
        F.coalesce("doc.hourly.time", F.array().cast("array<string>")).alias("_times"),
        numbers("temperature_2m").alias("_temp"), numbers("relative_humidity_2m").alias("_rh"),
        rain.alias("hourly_precip_in"))
    rain = F.col("hourly_precip_in")
    peak = F.array_max(rain)
    out = out.withColumn("_totals", _largest_totals(rain, (6, 24))).withColumns({
        "next_72h_precip_in": first_sum(rain, 72),
        **{f"max_{h}h_precip_in": F.coalesce(
            half_even(F.get("_totals", F.lit(i)), 2), F.lit(0.0)) for i, h in enumerate((6, 24))},
        "peak_hour_precip_in": F.coalesce(half_even(peak, 2), F.lit(0.0)),
        "peak_hour_index": F.when(peak > 0, F.array_position(rain, peak).cast("int") - 1),
        **hourly_slices(F.col("_times"), F.col("_temp"), F.col("_rh")),
    }).drop("_times", "_temp", "_rh", "_totals")
    out = settle(out, 1, {"heat_index_f": hazard.heat_index_f("temp_f", "humidity_pct"),
                          "wet_bulb_f": hazard.wet_bulb_f("temp_f", "humidity_pct")})
    return out.withColumn("heat_category", hazard.heat_category("heat_index_f"))


SOIL_NOW = {"soil_moisture_0_to_1cm": "soil_moisture_top", "soil_moisture_1_to_3cm": "soil_moisture_shallow",
            "soil_moisture_3_to_9cm": "soil_moisture_mid", "soil_moisture_9_to_27cm": "soil_moisture_root"}


def current_soil(df: DataFrame) -> DataFrame:
    """One row per soil document: moistures, the past week's rain, condition and flags."""
    fields = ", ".join(f"{c}: string" for c in SOIL_NOW)
    d = parsed(df, f"current struct<time: string, {fields}>, hourly struct<precipitation: array<string>>")
    keys = [c for c in df.columns if c != "value"]
    rain = F.transform("doc.hourly.precipitation", number)
    out = d.select(*keys, F.col("doc.current.time").alias("as_of"),
                   *[number(f"doc.current.{c}").alias(n) for c, n in SOIL_NOW.items()],
                   first_sum(rain, 168).alias("past_7d_precip_in"))
    top = F.coalesce("soil_moisture_top", "soil_moisture_shallow")
    out = out.withColumns({
        "saturated": F.coalesce(top >= 0.40, F.lit(False)),
        "very_dry": F.coalesce(top < 0.15, F.lit(False)), "condition": hazard.soil_condition(top)})
    return out.withColumns({n: half_even(n, 3) for n in SOIL_NOW.values()})


def current_air(df: DataFrame) -> DataFrame:
    names = ["pm2_5", "pm10", "ozone", "carbon_monoxide", "us_aqi", "us_aqi_pm2_5", "us_aqi_ozone"]
    d = parsed(df, "current struct<time: string, " + ", ".join(f"{n}: string" for n in names) + ">")
    keys = [c for c in df.columns if c != "value"]
    out = d.select(*keys, F.col("doc.current.time").alias("as_of"),
                   *[number(f"doc.current.{n}").alias(n) for n in names])
    return out.withColumnRenamed("carbon_monoxide", "co").withColumn(
        "label", hazard.air_band("us_aqi"))


def alerts(df: DataFrame) -> DataFrame:
    """One row per alert feature, missing texts empty."""
    names = ["event", "severity", "headline", "onset", "ends"]
    d = parsed(df, "features array<struct<properties: struct<"
               + ", ".join(f"{n}: string" for n in names) + ">>>")
    keys = [c for c in df.columns if c != "value"]
    return d.select(*keys, F.explode("doc.features.properties").alias("p")).select(
        *keys, *[F.coalesce(f"p.{n}", F.lit("")).alias(n) for n in names])


def fires(df: DataFrame) -> DataFrame:
    """Incidents with a position; a missing name becomes "Unnamed"."""
    d = parsed(df, """features array<struct<attributes: struct<IncidentName: string,
      DailyAcres: double, PercentContained: double, FireCause: string,
      FireDiscoveryDateTime: string, IrwinID: string>, geometry: struct<x: double, y: double>>>""")
    keys = [c for c in df.columns if c != "value"]
    f = d.select(*keys, F.explode("doc.features").alias("f"))
    a = "f.attributes."
    return f.select(
        *keys, F.coalesce(F.nullif(F.col(a + "IncidentName"), F.lit("")), F.lit("Unnamed")).alias("name"),
        F.col(a + "DailyAcres").alias("acres"), F.col(a + "PercentContained").alias("contained_pct"),
        F.col(a + "FireCause").alias("cause"), F.col(a + "FireDiscoveryDateTime").alias("discovered"),
        F.col(a + "IrwinID").alias("irwin_id"), F.col("f.geometry.y").alias("lat"),
        F.col("f.geometry.x").alias("lon")).dropna(subset=["lat", "lon"])


def landslides(df: DataFrame) -> DataFrame:
    d = parsed(df, """features array<struct<attributes: struct<Name: string, Type: string,
      Conf: string, Date: string, Year: int, County: string, State: string>,
      geometry: struct<x: double, y: double>>>""")
    keys = [c for c in df.columns if c != "value"]
    f = d.select(*keys, F.explode("doc.features").alias("f"))
    named = {"Name": "name", "Type": "type", "Conf": "confidence", "Date": "date", "Year": "year",
             "County": "county", "State": "state"}
    return f.select(*keys, *[F.col(f"f.attributes.{c}").alias(n) for c, n in named.items()],
                    F.col("f.geometry.y").alias("lat"), F.col("f.geometry.x").alias("lon"))
