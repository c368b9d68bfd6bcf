"""Hazards per area: fires, slides, storms and weather rolled up over forests and districts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions import hazard
from hydrospark.functions.base import half_even, once, settle
from hydrospark.plans.pick import top_rows
from hydrospark.plans.spatial import nearest_of_sites, nearest_to_fixed_sites, within_sites

FOREST_FIRE_MI, DISTRICT_FIRE_MI, SLIDE_MI = 50.0, 25.0, 25.0
FIRES_SHOWN, SLIDES_SHOWN = 6, 25


def area_sites(fire_miles: bool = True) -> list[dict]:
    """The fixed list of forests and districts with the radius each is searched in."""
    region = {short: r for short, _, _, _, r in dims.FORESTS}
    out = [("forest", s, lat, lon, r, FOREST_FIRE_MI) for s, _, lat, lon, r in dims.FORESTS]
    out += [("district", f"{f}/{d}", lat, lon, region[f], DISTRICT_FIRE_MI)
            for f, d, _, lat, lon in dims.DISTRICTS]
    return [{"area_type": t, "area_id": a, "site_lat": lat, "site_lon": lon, "region": r,
             "site_radius_mi": mi if fire_miles else SLIDE_MI} for t, a, lat, lon, r, mi in out]


AREA = ["area_type", "area_id"]


def fires_near(fires: DataFrame, sites: Sequence[dict] | DataFrame | None = None) -> DataFrame:
    """(area, fire) pairs inside each area's radius, with the rounded distance."""
    located = fires.dropna(subset=["lat", "lon"])
    pairs = within_sites(located, area_sites() if sites is None else sites,
                         FOREST_FIRE_MI if isinstance(sites, DataFrame) else None)
    return pairs.withColumn("distance_mi", half_even("distance_mi", 1)).drop(
        "site_lat", "site_lon", "site_radius_mi")


def fire_totals(pairs: DataFrame, keys: Sequence[str] = tuple(AREA)) -> DataFrame:
    """Count, acres and containment; unusable numbers are skipped."""
    acres, contained = F.col("acres").cast("double"), F.col("contained_pct").cast("double")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("fires"),
        half_even(F.coalesce(F.sum(acres), F.lit(0.0)), 1).alias("total_acres"),
        half_even(F.coalesce(F.max(acres), F.lit(0.0)), 1).alias("max_acres"),
        F.min(contained).alias("min_contained_pct"))


def slide_inventory(events: DataFrame, sites: Sequence[dict] | DataFrame | None = None,
                    shown: int = SLIDES_SHOWN) -> tuple[DataFrame, DataFrame]:
    """(count and newest year per area, the newest events per area)."""
    pairs = within_sites(events.dropna(subset=["lat", "lon"]), area_sites(False) if sites is None else sites,
                         SLIDE_MI if isinstance(sites, DataFrame) else None)
    summary = pairs.groupBy(*AREA).agg(
        F.count("*").alias("slides"), F.max("year").alias("most_recent_year"))
    newest = top_rows(pairs, AREA, shown, F.desc_nulls_last("year"), "distance_mi",
                      *[c for c in events.columns if c not in ("year", "lat", "lon")])
    return summary, newest


def nearest_storm(storms: DataFrame, sites: Sequence[dict] | DataFrame | None = None,
                  carry: Sequence[str] = ("name",)) -> DataFrame:
    """The closest storm to each area; `sites` may be a table of any length."""
    located = storms.dropna(subset=["lat", "lon"])
    if isinstance(sites, DataFrame):
        return nearest_of_sites(located, sites, AREA, list(carry))
    return nearest_to_fixed_sites(located, area_sites() if sites is None else sites, AREA, list(carry))


def alert_flags(alerts: DataFrame, keys: Sequence[str] = tuple(AREA)) -> DataFrame:
    return alerts.groupBy(*keys).agg(
        F.max(hazard.is_red_flag("event")).alias("red_flag"),
        F.max(hazard.is_fire_alert("event")).alias("fire_alert"),
        F.max(hazard.is_flood_alert("event")).alias("flood_alert"))


def fire_weather(df: DataFrame) -> DataFrame:
    """Fire index, score and label from weather columns and alert flags."""
    false = F.lit(False)
    fuel = df.withColumn("fuel_moisture_pct", hazard.fuel_moisture_pct("temp_f", "humidity_pct"))
    indexed = settle(fuel, 1, {"fwi": hazard.fire_index("fuel_moisture_pct", "wind_mph")})
    scored = settle(indexed, 1, {"fire_score": hazard.fire_score(
        "fwi", "region", F.coalesce("red_flag", false), F.coalesce("fire_alert", false))})
    return scored.withColumn("fire_label", hazard.fire_label("fire_score"))


def landslide(df: DataFrame) -> DataFrame:
    """Slide score and label from soil and rain columns."""
    moisture = F.coalesce("soil_moisture_top", "soil_moisture_shallow")
    scored = settle(df, 1, {"slide_score": hazard.slide_score(
        "region", moisture, "saturated", "past_7d_precip_in", "next_72h_precip_in")})
    return scored.withColumn("slide_label", hazard.slide_label("slide_score"))


def rollup(weather: DataFrame, alerts: DataFrame, fires: DataFrame, slides: DataFrame,
           storms: DataFrame, sites: Sequence[dict] | DataFrame | None = None) -> DataFrame:
    """One row per forest and district. `weather` holds one row per area with its weather and soil
    columns. Every feed is reduced to one row per area before the joins."""
    sites = area_sites() if sites is None else sites
    spark = weather.sparkSession
    areas = spark.createDataFrame(
        [(s["area_type"], s["area_id"], s["region"]) for s in sites],
        "area_type string, area_id string, region string")
    slide_sites = [{**s, "site_radius_mi": SLIDE_MI} for s in sites]
    summary, _ = slide_inventory(slides, slide_sites)
    out = (areas.join(weather, AREA, "left").join(alert_flags(alerts), AREA, "left")
           .join(fire_totals(fires_near(fires, sites)), AREA, "left")
           .join(summary, AREA, "left")
           .join(nearest_storm(storms, sites).withColumnsRenamed(
               {"name": "nearest_storm", "distance_mi": "nearest_storm_mi"}), AREA, "left"))
    zero = {"fires": 0, "slides": 0, "total_acres": 0.0, "max_acres": 0.0}
    return landslide(fire_weather(out.fillna(zero)))


def top_fires(pairs: DataFrame, k: int = FIRES_SHOWN, tie: str = "name") -> DataFrame:
    return top_rows(pairs, AREA, k, "distance_mi", tie)


def hourly_slices(times: Column, temp: Column, rh: Column, hours: int = 24) -> dict[str, Column]:
    """Arrays for the coming hours: values without gaps, and wet bulb where both inputs exist."""
    def known(values: Column) -> Column:
        return F.filter(F.slice(values, 1, hours), lambda v: v.isNotNull())

    both = F.filter(F.slice(F.arrays_zip(temp.alias("t"), rh.alias("h")), 1, hours),
                    lambda p: p["t"].isNotNull() & p["h"].isNotNull())
    return {
        "hourly_times": F.slice(times, 1, hours), "hourly_temp_f": known(temp),
        "hourly_rh": known(rh),
        "hourly_wet_bulb_f": F.transform(
            F.transform(both, lambda p: hazard.wet_bulb_f(p["t"], p["h"])),
            lambda v: half_even(v, 1)),
    }


def heat_stress(df: DataFrame) -> DataFrame:
    """Heat index, wet bulb and their bands from `temp_f` and `humidity_pct`."""
    out = settle(df, 1, {"heat_index_f": hazard.heat_index_f("temp_f", "humidity_pct"),
                         "wet_bulb_f": hazard.wet_bulb_f("temp_f", "humidity_pct")})
    return out.withColumns({
        "heat_category": hazard.heat_category("heat_index_f"),
        "wet_bulb_band": hazard.wet_bulb_band("wet_bulb_f"),
        "heat_band": hazard.heat_band("heat_index_f")})


def first_sum(values: Column, n: int, digits: int = 2) -> Column:
    """Sum of the first `n` array elements, missing ones as 0."""
    total = F.aggregate(F.slice(values, 1, n), F.lit(0.0),
                        lambda acc, v: acc + F.coalesce(v.cast("double"), F.lit(0.0)))
    return once(F.coalesce(total, F.lit(0.0)), lambda v: half_even(v, digits))
