"""Terrain-aware storm factors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.functions.base import ColumnLike, clamp, col

# Monthly mean precipitable water in mm, January first, and its saturation level.
PRECIPITABLE_WATER_MM = [14, 15, 19, 24, 32, 41, 47, 48, 41, 28, 20, 15]
SATURATED_MM = 65.0

KNOT_MS = 0.5144
METERS_PER_DEGREE = 111320.0


def orographic_factor(lon: ColumnLike, lat: ColumnLike, motion_deg: ColumnLike,
                      site_lon: ColumnLike) -> Column:
    """1..3: how far terrain lifts the rain of a storm west of the site that moves north."""
    miles_west = (col(site_lon) - col(lon)) * 69.0 * F.cos(F.radians(col(lat)))
    side = 0.2 + 0.8 / (1.0 + F.exp(-miles_west / 25.0))
    motion = col(motion_deg)
    northward = F.when(motion.isNull(), 0.5).otherwise(
        F.greatest(F.lit(0.0), F.cos(F.radians(motion))))
    return 1.0 + 2.0 * side * northward


def decayed_wind_kt(miles_inland: ColumnLike, peak_kt: ColumnLike) -> Column:
    """Exponential decay toward 26 kt at 0.18 per hour, at 12 mph forward speed."""
    peak = F.coalesce(col(peak_kt).cast("double"), F.lit(0.0))
    hours = F.greatest(F.lit(0.0), col(miles_inland)) / 12.0
    return F.when(peak <= 26.0, peak).otherwise(26.0 + (peak - 26.0) * F.exp(-0.18 * hours))


def moisture_factor(lat: ColumnLike, wind_kt: ColumnLike, month: ColumnLike,
                    site_lat: ColumnLike) -> Column:
    """0.3..1.5 from monthly moisture plus the surge of an intense storm south of the site."""
    monthly = F.element_at(F.array(*[F.lit(float(v)) for v in PRECIPITABLE_WATER_MM]),
                           col(month).cast("int"))
    south = 1.0 - F.exp(-F.greatest(F.lit(0.0), col(site_lat) - col(lat)) / 3.0)
    strength = clamp((col(wind_kt) - 25.0) / 75.0, 0.0, 1.0)
    effective = F.least(F.lit(SATURATED_MM), monthly + 18.0 * south * strength)
    return 0.3 + 1.2 * (effective / SATURATED_MM)


def upslope_ms(dh_dlat: ColumnLike, dh_dlon: ColumnLike, lat: ColumnLike, wind_from: ColumnLike,
               wind_kt: ColumnLike) -> Column:
    """Vertical speed forced by wind over a slope given in metres per degree; 0 off the grid."""
    toward = F.radians(col(wind_from) + 180.0)
    speed = col(wind_kt) * KNOT_MS
    east_slope = col(dh_dlon) / (METERS_PER_DEGREE * F.cos(F.radians(col(lat))))
    north_slope = col(dh_dlat) / METERS_PER_DEGREE
    return F.coalesce(
        speed * (F.sin(toward) * east_slope + F.cos(toward) * north_slope), F.lit(0.0))


def rainfall_score(peak_kt: ColumnLike, distance_mi: ColumnLike, orographic: ColumnLike,
                   moisture: ColumnLike, upslope: ColumnLike, proximity: ColumnLike,
                   track_fraction: ColumnLike) -> Column:
    intensity = F.coalesce(F.nullif(col(peak_kt).cast("double"), F.lit(0.0)), F.lit(25.0))
    basin = 0.5 + 0.5 * col(proximity) + 0.5 * col(track_fraction)
    lift = 1.0 + 5.0 * F.greatest(F.lit(0.0), col(upslope))
    return (intensity * F.exp(-col(distance_mi) / 75.0) * col(orographic) * col(moisture)
            * lift * basin / 2.0)


def poisson_any(rate: ColumnLike) -> Column:
    return 1.0 - F.exp(-col(rate))


def season_scale(season: dict | None, climo_ace: float) -> float:
    """Ratio of forecast to mean season energy; 1 without a forecast."""
    ace = (season or {}).get("ace")
    return 1.0 if ace is None else float(ace) / climo_ace

