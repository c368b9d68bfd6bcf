"""River-stage rules for one reading against its own site's levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.functions.base import ColumnLike, col

# Level and its category, highest first.
CATEGORIES = [("major", "MAJOR FLOOD"), ("moderate", "MODERATE FLOOD"), ("minor", "MINOR FLOOD"),
              ("action", "action stage")]


def category(stage_ft: ColumnLike, pool_ft: ColumnLike, role: ColumnLike,
             has_levels: ColumnLike) -> Column:
    """Flood category from the level columns of the site's own threshold row."""
    reading = F.coalesce(col(stage_ft), col(pool_ft))
    out = (F.when(reading.isNull(), "unknown")
           .when(~col(has_levels) & ((F.coalesce(col(role), F.lit("")) == "reservoir")
                                     | col(stage_ft).isNull()), "pool stage")
           .when(~col(has_levels), "no thresholds"))
    for level, label in CATEGORIES:
        out = out.when(reading >= F.col(level), label)
    return out.otherwise("below action")


def percent_of(stage_ft: ColumnLike, level: ColumnLike) -> Column:
    return 100.0 * col(stage_ft) / F.nullif(col(level), F.lit(0.0))


def eta_hours(stage_ft: ColumnLike, target_ft: ColumnLike, rate_ft_per_hr: ColumnLike) -> Column:
    """Hours until the target at the present rate; null when not rising, 0 when already there."""
    rate = col(rate_ft_per_hr)
    gap = col(target_ft) - col(stage_ft)
    return F.when(rate > 0.05, F.when(gap <= 0, 0.0).otherwise(gap / rate))


def display_value(stage_ft: ColumnLike, pool_ft: ColumnLike) -> tuple[Column, Column]:
    pool_shown = col(stage_ft).isNull() & col(pool_ft).isNotNull()
    return (F.coalesce(col(stage_ft), col(pool_ft)),
            F.when(pool_shown, "ft pool elev").otherwise("ft"))


def level_from_rise(predicted_rise: ColumnLike, current_ft: ColumnLike) -> Column:
    """A crest over a coming window cannot lie below the present level."""
    rise = col(predicted_rise)
    return F.when(rise > 0.0, rise + col(current_ft)).when(rise <= 0.0, col(current_ft))


def network(role: ColumnLike) -> Column:
    from hydrospark.dims import NETWORKS

    out = F.when(F.lit(False), "")
    for name, roles in NETWORKS.items():
        out = out.when(col(role).isin(roles), name)
    return out.otherwise("other")
