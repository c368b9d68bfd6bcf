"""The 0..100 flood index: six components, an amplifier, a label and ten triggers.

Components and total come unrounded; `flood_index.score` rounds each in its own projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.dims import INDEX_STAGES
from hydrospark.functions.base import ColumnLike, clamp, col, first_step
from hydrospark.functions.hazard import soil_amplifier

COMPONENTS = ["stage", "qpf", "storm", "rise", "alert", "soil"]
LABELS = [(80, "EMERGENCY"), (60, "WARNING"), (40, "ALERT"), (20, "ELEVATED")]
LEVELS = {"CALM": "calm", "ELEVATED": "watch", "ALERT": "alert", "WARNING": "warning",
          "EMERGENCY": "emergency"}
TRIGGERS = ["stage_above_action", "stage_above_minor", "qpf_over_1in", "qpf_over_3in",
            "storm_within_1000mi", "storm_within_500mi", "river_rising_fast",
            "nws_flood_or_tropical", "soil_saturated", "wet_week"]


def _zero(value: ColumnLike) -> Column:
    return F.coalesce(col(value), F.lit(0.0))


def components(stage_ft: ColumnLike, qpf_in: ColumnLike, storm_mi: ColumnLike, rate: ColumnLike,
               alert: ColumnLike, soil: ColumnLike, past_7d_in: ColumnLike,
               major_ft: ColumnLike = INDEX_STAGES["major"]) -> dict[str, Column]:
    dry_to_wet = F.coalesce(clamp((col(soil) - 0.15) / 0.30 * 5.0, 0.0, 5.0), F.lit(0.0))
    return {
        "stage": clamp(_zero(stage_ft) / col(major_ft) * 35.0, 0.0, 35.0),
        "qpf": F.least(F.lit(20.0), _zero(qpf_in) / 5.0 * 20.0),
        "storm": F.coalesce(clamp(20.0 * (1500.0 - col(storm_mi)) / 1300.0, 0.0, 20.0),
                            F.lit(0.0)),
        "rise": clamp(_zero(rate) * 10.0, 0.0, 10.0),
        "alert": F.when(F.coalesce(col(alert), F.lit(False)), 10.0).otherwise(0.0),
        "soil": F.greatest(dry_to_wet, F.least(F.lit(5.0), _zero(past_7d_in) / 4.0 * 5.0)),
    }


def triggers(stage_ft: ColumnLike, qpf_in: ColumnLike, storm_mi: ColumnLike, rate: ColumnLike,
             alert: ColumnLike, saturated: ColumnLike, past_7d_in: ColumnLike,
             action_ft: ColumnLike = INDEX_STAGES["action"],
             minor_ft: ColumnLike = INDEX_STAGES["minor"]) -> dict[str, Column]:
    fired = {
        "stage_above_action": col(stage_ft) >= col(action_ft),
        "stage_above_minor": col(stage_ft) >= col(minor_ft),
        "qpf_over_1in": _zero(qpf_in) >= 1.0,
        "qpf_over_3in": _zero(qpf_in) >= 3.0,
        "storm_within_1000mi": col(storm_mi) < 1000.0,
        "storm_within_500mi": col(storm_mi) < 500.0,
        "river_rising_fast": _zero(rate) >= 0.3,
        "nws_flood_or_tropical": col(alert),
        "soil_saturated": col(saturated),
        "wet_week": _zero(past_7d_in) >= 3.0,
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in fired.items()}


def total(parts: dict[str, Column], soil: ColumnLike, saturated: ColumnLike) -> Column:
    """Amplified sum of already rounded components, at most 100."""
    raw = sum((parts[name] for name in COMPONENTS[1:]), parts[COMPONENTS[0]])
    return F.least(F.lit(100.0), raw * soil_amplifier(soil, saturated))


def label(score: ColumnLike) -> Column:
    return first_step(score, LABELS, "CALM")


def level(label_col: ColumnLike) -> Column:
    pairs = [F.lit(x) for pair in LEVELS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(col(label_col))), F.lit("calm"))
