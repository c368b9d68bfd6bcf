"""The forecast card: forecasts beside their site's gauge, flood stages and model figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.functions.hazard import direction, probability_severity
from hydrospark.functions.stage import CATEGORIES
from hydrospark.operators.evaluation import percent

#: Level names, lowest first, in which a threshold is looked for.
LEVELS = [level for level, _ in reversed(CATEGORIES)]
#: Top of the axis where a site has no major stage, and the share by which the axis goes beyond it.
AXIS_FT, AXIS_OVER = 20.0, 1.25


def in_order(threshold: Column) -> list[Column]:
    """Order of a site's forecasts: by horizon, then by threshold, a missing one as 0."""
    return [F.col("horizon_h"), F.coalesce(threshold, F.lit(0.0))]


def _share(value: str) -> Column:
    return F.when(F.col(value).isNotNull() & (F.col("axis_max") != 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(value) / F.col("axis_max") * 100)))


def card(forecasts: DataFrame, gauges: DataFrame, stages: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each forecast, in the order of its site's card (`place`, for each kind by itself).

    `forecasts` has target_id, kind, horizon_h, threshold, prediction; `gauges` site_id, stage_ft; `stages` site_id and the
    levels; `records` is what `evaluation.trust` gives. A site without a gauge, a stage or a record keeps its rows with
    nulls there; a forecast without a horizon or a prediction has no row. A threshold is named after the
    first level that it equals to a hundredth of a foot.
    """
    known = forecasts.filter(F.col("horizon_h").isNotNull() & F.col("prediction").isNotNull())
    levels = stages.select(F.col("site_id").alias("target_id"), *LEVELS)
    now = gauges.select(F.col("site_id").alias("target_id"), F.col("stage_ft").alias("current_ft"))
    figures = records.select(
        F.col("target_id").alias("_t"), F.col("kind").alias("_k"), F.col("horizon_h").alias("_h"), F.col("threshold").alias("_thr"),
        "mae", "event_mae", "event_baseline_mae", F.col("beats_baseline_overall").alias("beats_overall"), "auc", "positive_events",
        "folds_with_events", "n_folds", "trustworthy")
    same = ((F.col("target_id") == F.col("_t")) & (F.col("kind") == F.col("_k")) & (F.col("horizon_h") == F.col("_h"))
            & F.col("threshold").eqNullSafe(F.col("_thr")))
    rows = (known.join(now, "target_id", "left").join(levels, "target_id", "left").join(figures, same, "left")
            .withColumn("axis_max", F.coalesce(F.nullif("major", F.lit(0.0)), F.lit(AXIS_FT)) * AXIS_OVER))
    rise, chance = F.col("kind") == "regression", F.col("kind") == "classification"
    name = F.lit("")
    for level in reversed(LEVELS):
        name = F.when(F.abs(F.col(level) - F.col("threshold")) < 0.01, level).otherwise(name)
    rows = rows.withColumns({"predicted_ft": F.when(rise, F.col("prediction")), "pct": F.when(chance, percent("prediction"))})
    place = F.row_number().over(Window.partitionBy("target_id", "kind").orderBy(*in_order(F.col("threshold"))))
    of = lambda test, *names: [F.when(test, F.col(n)).alias(n) for n in names]
    return rows.select(
        "target_id", "kind", place.alias("place"), "horizon_h", "threshold", "current_ft", "predicted_ft", "axis_max",
        F.when(rise, F.col("predicted_ft") - F.col("current_ft")).alias("delta"),
        F.when(rise, direction(F.col("predicted_ft") - F.col("current_ft"))).alias("direction"),
        _share("current_ft").alias("now_pct"), _share("predicted_ft").alias("pred_pct"),
        F.when(rise, F.coalesce((F.col("minor") != 0) & (F.col("predicted_ft") >= F.col("minor")), F.lit(False))).alias("above_minor"),
        *of(rise, "mae", "event_mae", "event_baseline_mae", "beats_overall"), "pct",
        F.when(chance, probability_severity("pct")).alias("severity"), F.when(chance, name).alias("threshold_label"),
        *of(chance, "auc", "positive_events", "folds_with_events", "n_folds"),
        F.when(chance, F.coalesce("trustworthy", F.lit(False))).alias("trustworthy"))


def summary(cards: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each site with a card: how many forecasts of either kind, whether any is not to be trusted, and the
    horizons withheld because the model loses to its naive rule."""
    lost = (records.filter((F.col("kind") == "regression") & (F.col("beats_baseline") == F.lit(False)))
            .groupBy("target_id").agg(F.sort_array(F.collect_set("horizon_h")).alias("withheld")))
    shown = cards.groupBy("target_id").agg(
        F.count_if(F.col("kind") == "regression").alias("n_levels"), F.count_if(F.col("kind") == "classification").alias("n_chances"),
        F.coalesce(F.bool_or(~F.col("trustworthy")), F.lit(False)).alias("any_untrustworthy"))
    return shown.join(lost, "target_id", "left").withColumn("withheld", F.coalesce("withheld", F.array().cast("array<int>")))
