"""Gauge networks: state, thresholds, long-run stage picture and registry checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import stage
from hydrospark.functions.base import defined_level, half_even
from hydrospark.functions.geo import haversine_mi
from hydrospark.operators.timeseries import best_source, recent_rate
from hydrospark.plans.pick import best_row, top_rows
from hydrospark.schema import THRESHOLD_LEVELS

FLOOD_LEVELS = THRESHOLD_LEVELS[:4]


def clean_levels(thresholds: DataFrame) -> DataFrame:
    return thresholds.withColumns({level: defined_level(level) for level in THRESHOLD_LEVELS})


def with_defaults(thresholds: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Published levels laid over defaults, so that every level is present."""
    return thresholds.withColumns(
        {level: F.coalesce(F.col(level), F.lit(defaults[level])) for level in THRESHOLD_LEVELS})


def with_thresholds(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings beside their own site's levels; another site's levels are never borrowed.

    A plain left join on the site: the adaptive planner broadcasts the levels once it has measured
    them to be small, and splits a hot site otherwise.
    """
    levels = clean_levels(thresholds).select("site_id", *THRESHOLD_LEVELS).withColumn(
        "has_levels", F.lit(True))
    return (readings.join(levels, "site_id", "left")
            .withColumn("has_levels", F.coalesce("has_levels", F.lit(False))))


def classify(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Category, share of two levels and display value per reading (`stage_ft`,
    `pool_elevation_ft`, `role`)."""
    value, units = stage.display_value("stage_ft", "pool_elevation_ft")
    category = stage.category("stage_ft", "pool_elevation_ft", "role", "has_levels")
    return with_thresholds(readings, thresholds).withColumns({
        "flood_category": category,
        "pct_to_minor": stage.percent_of("stage_ft", "minor"),
        "pct_to_major": stage.percent_of("stage_ft", "major"),
        "display_ft": value, "display_units": units,
    })


def with_etas(classified: DataFrame) -> DataFrame:
    """Hours to each flood level at the present rate; never against a pool elevation."""
    river = F.coalesce(F.col("role"), F.lit("")) != "reservoir"
    return classified.withColumns({
        f"eta_{level}_hr": F.when(river, stage.eta_hours("stage_ft", level, "rate_ft_per_hr"))
        for level in ("minor", "moderate", "major")})


def network_state(history: DataFrame, sites: DataFrame, thresholds: DataFrame,
                  readings: int = 12, history_rows: int = 96) -> DataFrame:
    """Latest readings, rate of rise, category, ETAs and the recent trace of every site.

    Rivers use `stage_ft` for rate and trace, reservoirs `pool_elevation_ft`. Latest values are
    max-by aggregates, the rate and the trace keep a fixed number of rows per site and task.
    """
    rows = history.filter(F.col("metric").isin("stage_ft", "discharge_cfs", "pool_elevation_ft"))
    rows = rows.withColumnRenamed("entity_id", "site_id")

    def last(metric: str) -> Column:
        return F.max_by(F.when(F.col("metric") == metric, F.col("value")),
                        F.when(F.col("metric") == metric, F.col("ts"))).alias(metric)

    latest = rows.groupBy("site_id").agg(
        last("stage_ft"), last("discharge_cfs"), last("pool_elevation_ft"),
        F.max("ts").alias("timestamp"))
    level = rows.filter(F.col("metric") != "discharge_cfs")
    rates = recent_rate(level, readings, keys=["site_id", "metric"]).select(
        "site_id", "metric", "rate_ft_per_hr")
    recent = top_rows(level.select("site_id", "metric", "ts", "value"), ["site_id", "metric"],
                      history_rows, F.desc("ts"), F.desc("value"))
    trace = recent.groupBy("site_id", "metric").agg(
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("history"))
    own = sites.select("site_id", "label", "lat", "lon", "role").withColumn(
        "metric", F.when(F.col("role") == "reservoir", "pool_elevation_ft").otherwise("stage_ft"))
    state = (own.join(latest, "site_id", "left").join(rates, ["site_id", "metric"], "left")
             .join(trace, ["site_id", "metric"], "left").drop("metric"))
    return with_etas(classify(state, thresholds))


def network_counts(sites: DataFrame) -> DataFrame:
    """Sites per network, with a grand total; empty networks do not appear."""
    return (sites.withColumn("network", stage.network("role")).rollup("network")
            .agg(F.count("*").alias("n")).withColumn("network", F.coalesce("network", F.lit("all"))))


def near_level(values: DataFrame, thresholds: DataFrame, value: str, tolerance: float = 0.01
               ) -> DataFrame:
    """Name of the first level within `tolerance` of a value at the same site, or empty.

    The site is an equality key, so the nearness test only compares a row with its own levels.
    """
    out = F.when(F.lit(False), "")
    for level in FLOOD_LEVELS:
        out = out.when(F.abs(F.col(level) - F.col(value)) < tolerance, level)
    return with_thresholds(values, thresholds).withColumn("level", out.otherwise(""))


# ---- long-run stage picture ------------------------------------------------------------------

def daily_peaks(history: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Daily maxima, which keep a crest that a mean would flatten."""
    return history.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.max("value").alias("ft"))


def year_starts(peaks: DataFrame, keys=("entity_id",)) -> DataFrame:
    return peaks.groupBy(*keys, F.year("day").alias("year")).agg(F.min("day").alias("first_day"))


def month_percentile(history: DataFrame, current: DataFrame, keys=("entity_id",),
                     min_rows: int = 30) -> DataFrame:
    """Share of readings in the month of the latest reading that do not exceed `current_ft`."""
    keys = list(keys)
    latest = history.groupBy(*keys).agg(F.month(F.max("ts")).alias("month"))
    # Counts per month and value side are small, so the join back runs on them, not on readings.
    asked = current.join(latest, keys)
    counts = (history.withColumn("month", F.month("ts")).join(asked, [*keys, "month"])
              .groupBy(*keys, "month", "current_ft")
              .agg(F.count("*").alias("n"),
                   F.count_if(F.col("value") <= F.col("current_ft")).alias("below")))
    share = half_even(F.col("below") / F.col("n") * 100.0, 1)
    return counts.select(
        *keys, "current_ft", "month", F.when(F.col("n") >= min_rows, share).alias("percentile"))


def stage_history(history: DataFrame, current: DataFrame, thresholds: DataFrame,
                  event_day: str, days: int = 3, compat: bool = False) -> DataFrame:
    """One row per site: span, peak, the crest near an event, axis limit and month percentile.

    `compat` mixes all sources; otherwise the best source of each site is used alone.
    """
    keys = ["entity_id"]
    rows = history if compat else best_source(history, keys)
    peaks = daily_peaks(rows)
    day = F.lit(event_day).cast("date")
    near = F.col("day").between(F.date_sub(day, days), F.date_add(day, days))
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("n_observations"), F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"))
    crests = peaks.groupBy(*keys).agg(
        F.max("ft").alias("peak_ft"), F.max(F.when(near, F.col("ft"))).alias("event_ft"),
        F.max_by(F.when(near, F.col("day")),
                 F.when(near, F.struct("ft", (-F.datediff("day", F.lit("1970-01-01"))).alias("d")))
                 ).alias("event_day"))
    record = clean_levels(thresholds).select(F.col("site_id").alias("entity_id"),
                                             F.col("record").alias("record_ft"))
    ranked = month_percentile(rows, current).select(*keys, "month", "percentile")
    out = (totals.join(crests, keys).join(current, keys, "left").join(record, keys, "left")
           .join(ranked, keys, "left"))
    top = F.greatest("peak_ft", F.coalesce("record_ft", F.lit(0.0)),
                     F.coalesce("current_ft", F.lit(0.0)))
    return out.withColumns({
        "axis_max": top * 1.05,
        "daily_mean_series": F.coalesce(F.col("record_ft") - F.col("event_ft") > 1.0,
                                        F.lit(False))})


# ---- checks ----------------------------------------------------------------------------------

def ascending(levels: list[str]) -> Column:
    """Whether the defined levels rise."""
    given = F.filter(F.array(*levels), lambda v: v.isNotNull())
    return given == F.array_sort(given)


def registry_checks(gauges: DataFrame, forest_gauges: DataFrame, forests: DataFrame,
                    thresholds: DataFrame, authority: DataFrame | None = None,
                    drift_deg: float = 0.05, reach_mi: float = 75.0) -> DataFrame:
    """One row per violation: (check, key, detail)."""

    def report(name: str, df: DataFrame, key: str, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"),
                         detail.cast("string").alias("detail"))

    found = [
        report("duplicate_site", gauges.groupBy("site_id").count().filter("count > 1"), "site_id",
               F.col("count")),
        report("primary_count",
               gauges.agg(F.count_if(F.col("role") == "primary").alias("n")).filter("n <> 1")
               .withColumn("k", F.lit("primary")), "k", F.col("n")),
        report("thresholds_order",
               clean_levels(thresholds).filter(~ascending(FLOOD_LEVELS)), "site_id",
               F.concat_ws(",", *FLOOD_LEVELS)),
        report("forest_gauge_far",
               forest_gauges.join(
                   forests.select("forest", F.col("lat").alias("flat"), F.col("lon").alias("flon")),
                   "forest")
               .withColumn("mi", haversine_mi("lat", "lon", "flat", "flon"))
               .filter(F.col("mi") >= reach_mi), "site_id", F.round("mi", 1)),
    ]
    both = gauges.select("site_id", "label", "lat", "lon").unionByName(
        forest_gauges.select("site_id", "label", "lat", "lon"))
    conflict = both.groupBy("site_id").agg(
        F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    found.append(report("label_conflict", conflict, "site_id", F.concat_ws(" / ", "a", "b")))
    if authority is not None:
        given = authority.select("site_id", F.col("lat").alias("alat"), F.col("lon").alias("alon"))
        off = both.join(given, "site_id").filter(
            (F.abs(F.col("lat") - F.col("alat")) >= drift_deg)
            | (F.abs(F.col("lon") - F.col("alon")) >= drift_deg))
        found.append(report("coordinate_drift", off, "site_id", F.concat_ws(",", "lat", "lon")))
    return reduce(DataFrame.unionByName, found)


def extract_thresholds(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) level rows of published site payloads.

    A payload for another site, without any level, or with levels out of order is set aside.
    """
    cleaned = payloads.withColumns({level: defined_level(level) for level in FLOOD_LEVELS})
    crest = F.array_max(F.filter(F.transform("crests", defined_level), lambda v: v.isNotNull()))
    none = reduce(lambda a, b: a & b, [F.col(level).isNull() for level in FLOOD_LEVELS])
    other = (F.length("returned_id") > 0) & (F.col("returned_id") != F.col("site_id"))
    reason = (F.when(F.coalesce(other, F.lit(False)), "other site").when(none, "no levels")
              .when(~ascending(FLOOD_LEVELS), "not ascending"))
    marked = cleaned.withColumn("record", crest).withColumn("reason", reason)
    return (marked.filter(F.col("reason").isNull()).select("site_id", *THRESHOLD_LEVELS),
            marked.filter(F.col("reason").isNotNull()).select("site_id", "reason"))


def distinct_sites(*registries: DataFrame) -> DataFrame:
    """All sites of several registries, the first registry's label winning."""
    numbered = [r.select("site_id", "label").withColumn("_rank", F.lit(i))
                for i, r in enumerate(registries)]
    return best_row(reduce(DataFrame.unionByName, numbered), ["site_id"], "_rank", "label").drop(
        "_rank")
