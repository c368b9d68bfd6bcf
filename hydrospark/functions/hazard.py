"""Weather, fire, slide, sea, soil and air rules.

Scores come unrounded; `base.settle` rounds them to the published one decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.functions.base import ColumnLike, below_step, clamp, col, first_step, half_even

# Fixed values: (lower bound, label), highest first.
HEAT_LEVELS = [(125.0, "Extreme Danger"), (103.0, "Danger"), (90.0, "Extreme Caution"),
               (80.0, "Caution")]
SLIDE_LEVELS = [(80.0, "EXTREME"), (60.0, "HIGH"), (35.0, "ELEVATED")]
FIRE_LEVELS = [(75.0, "EXTREME"), (55.0, "HIGH"), (30.0, "ELEVATED")]
AIR_LEVELS = [(300.0, "HAZARDOUS"), (200.0, "VERY UNHEALTHY"), (150.0, "UNHEALTHY"),
              (100.0, "UNHEALTHY SENS."), (50.0, "MODERATE")]
RAIN_CLASSES = [(0.5, "extreme"), (0.25, "heavy")]
# Fixed values: (upper bound, label), lowest first.
WET_BULB_BANDS = [(65.0, "Low Risk"), (72.0, "Caution"), (78.0, "High Risk"), (83.0, "Danger")]
HEAT_BANDS = [(80.0, "Normal"), (90.0, "Caution"), (103.0, "Ext. Caution"), (124.0, "Danger")]
FRESHNESS = [(75.0, "fresh"), (150.0, "aging"), (360.0, "stale")]
# Slide score steps (lower bound, points) and (base, cap) by terrain.
SLIDE_SOIL = [(0.35, 22.0), (0.30, 14.0), (0.20, 6.0)]
SLIDE_PAST = [(8.0, 20.0), (5.0, 14.0), (3.0, 8.0), (1.5, 3.0)]
SLIDE_AHEAD = [(6.0, 35.0), (4.0, 25.0), (2.0, 14.0), (1.0, 6.0)]
SLIDE_TERRAIN = {"mountain": (18.0, 100.0), "piedmont": (6.0, 65.0)}
SLIDE_ELSEWHERE = (0.0, 30.0)


def mm_to_in(v: ColumnLike) -> Column:
    return col(v) / 25.4


def c_to_f(v: ColumnLike) -> Column:
    return col(v) * 9 / 5 + 32


def kmh_to_mph(v: ColumnLike) -> Column:
    return col(v) * 0.621371


def ms_to_kt(v: ColumnLike) -> Column:
    return half_even(col(v) * 1.94384, 1)


def m_to_ft(v: ColumnLike) -> Column:
    return half_even(col(v) * 3.28084, 1)


def wet_bulb_f(temp_f: ColumnLike, rh: ColumnLike) -> Column:
    rh = col(rh).cast("double")
    t = (col(temp_f) - 32.0) * 5.0 / 9.0
    tw = (t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331)
          + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035)
    return tw * 9.0 / 5.0 + 32.0


def heat_index_f(temp_f: ColumnLike, rh: ColumnLike) -> Column:
    t, rh = col(temp_f).cast("double"), col(rh).cast("double")
    mild = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094)
    # The published regression.
    hot = (-42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh
           - 0.00683783 * t * t - 0.05391553 * rh * rh + 0.00122874 * t * t * rh
           + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh)
    dry = (13.0 - rh) / 4.0 * F.sqrt(F.greatest(F.lit(0.0), 17.0 - F.abs(t - 95.0)) / 17.0)
    humid = (rh - 85.0) / 10.0 * (87.0 - t) / 5.0
    hot = (F.when((rh < 13.0) & t.between(80.0, 112.0), hot - dry)
           .when((rh > 85.0) & t.between(80.0, 87.0), hot + humid).otherwise(hot))
    return F.when(t < 80.0, mild).otherwise(hot)


def heat_category(hi: ColumnLike) -> Column:
    return F.when(col(hi).isNull(), F.lit("Unknown")).otherwise(
        first_step(hi, HEAT_LEVELS, "Normal"))


def wet_bulb_band(v: ColumnLike) -> Column:
    return F.when(col(v).isNull(), F.lit("Low Risk")).otherwise(
        below_step(v, WET_BULB_BANDS, "Extreme"))


def heat_band(v: ColumnLike) -> Column:
    return F.when(col(v).isNotNull(), below_step(v, HEAT_BANDS, "Extreme"))


def fuel_moisture_pct(temp_f: ColumnLike, rh: ColumnLike) -> Column:
    t, h = col(temp_f), clamp(col(rh).cast("double"), 0.0, 100.0)
    dry = 0.03229 + 0.281073 * h - 0.000578 * h * t
    mid = 2.22749 + 0.160107 * h - 0.014784 * t
    damp = 21.0606 + 0.005565 * h * h - 0.00035 * h * t - 0.483199 * h
    bounded = clamp(F.when(h < 10.0, dry).when(h < 50.0, mid).otherwise(damp), 1.0, 40.0)
    return F.when(t.isNotNull() & col(rh).isNotNull(), bounded)


def fire_index(fuel_pct: ColumnLike, wind_mph: ColumnLike) -> Column:
    """0..100 from fuel moisture and wind; null when an input is missing. Fuel moisture appears
    several times, so it should be a column of its own."""
    x, wind = col(fuel_pct) / 30.0, col(wind_mph).cast("double")
    damping = clamp(1.0 - 2.0 * x + 1.5 * x * x - 0.5 * x * x * x, 0.0, 1.0)
    score = clamp(damping * F.sqrt(1.0 + wind * wind) / 0.3002, 0.0, 100.0)
    return F.when(x.isNotNull() & wind.isNotNull(), score)


def is_red_flag(event: ColumnLike) -> Column:
    return F.coalesce(F.lower(col(event)).contains("red flag"), F.lit(False))


def is_fire_alert(event: ColumnLike) -> Column:
    return is_red_flag(event) | F.coalesce(
        F.lower(col(event)).contains("fire weather"), F.lit(False))


def is_flood_alert(event: ColumnLike) -> Column:
    return F.coalesce(col(event).rlike("Tropical|Hurricane|Flood"), F.lit(False))


def fire_score(fwi: ColumnLike, region: ColumnLike, red_flag: ColumnLike,
               any_alert: ColumnLike) -> Column:
    """Index with the coastal ceiling, lifted to the floor an active alert sets."""
    raw = F.coalesce(col(fwi), F.lit(0.0))
    capped = F.when((col(region) == "coastal") & ~col(any_alert),
                    F.least(raw, F.lit(65.0))).otherwise(raw)
    floor = F.when(col(red_flag), 70.0).when(col(any_alert), 45.0).otherwise(0.0)
    return F.greatest(capped, floor)


def fire_label(score: ColumnLike) -> Column:
    return first_step(score, FIRE_LEVELS, "CALM")


def slide_score(region: ColumnLike, soil: ColumnLike, saturated: ColumnLike, past_7d_in: ColumnLike,
                next_72h_in: ColumnLike) -> Column:
    soil, past, ahead = (F.coalesce(col(c), F.lit(0.0)) for c in (soil, past_7d_in, next_72h_in))
    saturated = F.coalesce(col(saturated), F.lit(False))

    def by_terrain(i: int) -> Column:
        out = F.when(F.lit(False), 0.0)
        for name, pair in SLIDE_TERRAIN.items():
            out = out.when(col(region) == name, pair[i])
        return out.otherwise(SLIDE_ELSEWHERE[i])

    points = (by_terrain(0)
              + F.when(saturated, 30.0).otherwise(first_step(soil, SLIDE_SOIL, 0.0))
              + first_step(past, SLIDE_PAST, 0.0) + first_step(ahead, SLIDE_AHEAD, 0.0))
    compound = saturated & (ahead >= 3.0) & (col(region) == "mountain")
    points = points * F.when(compound, 1.15).otherwise(1.0)
    return clamp(points, 0.0, by_terrain(1))


def slide_label(score: ColumnLike) -> Column:
    return first_step(score, SLIDE_LEVELS, "CALM")


def sea_state(wave_ft: ColumnLike, wind_kt: ColumnLike) -> Column:
    wave, wind = col(wave_ft), col(wind_kt)
    # Fixed values: (wave ft, wind kt, label), highest first.
    limits = [(25.0, 64.0, "PHENOMENAL"), (13.0, 48.0, "VERY ROUGH"), (8.0, 34.0, "ROUGH"),
              (4.0, 22.0, "MODERATE")]
    out = F.when(wave.isNull() & wind.isNull(), "unknown")
    for wave_min, wind_min, label in limits:
        out = out.when((F.coalesce(wave, F.lit(0.0)) >= wave_min)
                       | (F.coalesce(wind, F.lit(0.0)) >= wind_min), label)
    return out.otherwise("CALM")


def soil_condition(moisture: ColumnLike) -> Column:
    m = col(moisture)
    return (F.when(m >= 0.40, "SATURATED").when(m >= 0.30, "wet").when(m >= 0.20, "moist")
            .when(m < 0.15, "very dry").otherwise("normal"))


def soil_amplifier(moisture: ColumnLike, saturated: ColumnLike) -> Column:
    return (F.when(F.coalesce(col(saturated), F.lit(False)), 1.25)
            .when(col(moisture) >= 0.30, 1.10).otherwise(1.0))


def soil_saturation_pct(moisture: ColumnLike) -> Column:
    return F.least(F.lit(100.0), F.coalesce(col(moisture), F.lit(0.0)) / 0.45 * 100.0)


def air_band(aqi: ColumnLike) -> Column:
    return F.when(col(aqi).isNull(), "n/a").otherwise(first_step(aqi, AIR_LEVELS, "GOOD"))


def rain_class(inches: ColumnLike) -> Column:
    return first_step(inches, RAIN_CLASSES, "")


def freshness(as_of_epoch: ColumnLike, now_epoch: ColumnLike) -> tuple[Column, Column]:
    """(age in minutes, band); a feed without a time stamp is frozen with unknown age."""
    known = F.coalesce(col(as_of_epoch) > 0, F.lit(False))
    age = F.greatest(F.lit(0.0), (col(now_epoch) - col(as_of_epoch)) / 60.0)
    band = F.when(known, below_step(age, FRESHNESS, "frozen")).otherwise("frozen")
    return F.when(known, age), band


def probability_severity(pct: ColumnLike) -> Column:
    return first_step(pct, [(50, "high"), (25, "med")], "low")


def direction(delta: ColumnLike) -> Column:
    d = F.coalesce(col(delta), F.lit(0.0))
    return F.when(d > 0.05, "up").when(d < -0.05, "down").otherwise("flat")
