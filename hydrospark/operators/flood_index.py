"""The flood index over a table of inputs, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import index
from hydrospark.functions.base import half_even, settle
from hydrospark.functions.hazard import is_flood_alert

INPUTS = ["stage_ft", "qpf_in", "storm_mi", "rate_ft_per_hr", "alert", "soil", "saturated",
          "past_7d_in"]


def score(df: DataFrame) -> DataFrame:
    """Adds a rounded column per component, `score`, `label` and a boolean per trigger."""
    parts = index.components("stage_ft", "qpf_in", "storm_mi", "rate_ft_per_hr", "alert", "soil",
                             "past_7d_in")
    named = settle(df, 1, {f"index_{n}": part for n, part in parts.items()})
    total = index.total({n: F.col(f"index_{n}") for n in index.COMPONENTS}, "soil", "saturated")
    fired = index.triggers("stage_ft", "qpf_in", "storm_mi", "rate_ft_per_hr", "alert",
                           "saturated", "past_7d_in")
    return (named.withColumn("_raw", total)
            .withColumn("score", half_even("_raw", 0).cast("int")).drop("_raw")
            .withColumn("label", index.label("score")).withColumns(fired))


def component_map() -> Column:
    pairs = [x for n in index.COMPONENTS for x in (F.lit(n), F.col(f"index_{n}"))]
    return F.create_map(*pairs)


def trigger_map() -> Column:
    return F.create_map(*[x for n in index.TRIGGERS for x in (F.lit(n), F.col(n))])


def fired_first() -> Column:
    """All trigger names, fired ones first, each group in its fixed order."""
    on = [F.when(F.col(n), F.lit(n)) for n in index.TRIGGERS]
    off = [F.when(~F.col(n), F.lit(n)) for n in index.TRIGGERS]
    return F.array_compact(F.array(*on, *off))


def fired_count() -> Column:
    return sum((F.col(n).cast("int") for n in index.TRIGGERS[1:]),
               F.col(index.TRIGGERS[0]).cast("int"))


def gather_inputs(gauges: DataFrame, weather: DataFrame, soil: DataFrame, storms: DataFrame,
                  alerts: DataFrame, key: str = "site_id") -> DataFrame:
    """Index inputs per site from per-site feeds; storms and alerts are reduced to one row first."""
    nearest = storms.groupBy(key).agg(F.min("distance_mi").alias("storm_mi"))
    warned = alerts.groupBy(key).agg(F.max(is_flood_alert("event")).alias("alert"))
    ground = soil.select(key, F.coalesce("soil_moisture_top", "soil_moisture_shallow").alias("soil"),
                         "saturated", F.col("past_7d_precip_in").alias("past_7d_in"))
    return (gauges.select(key, "stage_ft", "rate_ft_per_hr")
            .join(weather.select(key, F.col("next_72h_precip_in").alias("qpf_in")), key, "left")
            .join(ground, key, "left").join(nearest, key, "left").join(warned, key, "left"))


def situation(df: DataFrame, shown: int = 4) -> DataFrame:
    """Severity level and the first `shown` facts worth stating, in fixed order of weight."""

    def fact(name: str, test: Column, value: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("fact"),
                                     value.cast("double").alias("value")))

    ranked = F.array(
        fact("stage", F.col("stage_ft").isNotNull(), F.col("stage_ft")),
        fact("rate", F.abs("rate_ft_per_hr") >= 0.05, F.col("rate_ft_per_hr")),
        fact("rain_72h", F.col("qpf_in") >= 0.5, F.col("qpf_in")),
        fact("storm", F.col("storm_mi") < 1000.0, F.col("storm_mi")),
        fact("soil", F.col("saturation_pct") >= 80.0, F.col("saturation_pct")),
        fact("forecast", F.col("predicted_ft").isNotNull(), F.col("predicted_ft")),
        fact("probability", F.col("flood_probability") >= 0.25, F.col("flood_probability")),
        fact("alert", F.col("alert"), F.lit(1.0)),
    )
    return df.withColumn("level", index.level("label")).withColumn(
        "key_facts", F.slice(F.array_compact(ranked), 1, shown))
