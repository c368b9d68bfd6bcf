"""The flood index replayed over the historical record, and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions import index
from hydrospark.functions.geo import haversine_mi
from hydrospark.functions.base import settle
from hydrospark.operators import flood_index
from hydrospark.operators.timeseries import forward_sum, hourly_rate, past_sum
from hydrospark.session import run_dir

STAGE, PRECIP, SOIL = "stage_ft", "wx_precip_in_24h", "soil_era5_0_7cm"
ALERT_SCORE = 40


def daily_inputs(history: DataFrame, sites: DataFrame, sources: list[str] | None = None
                 ) -> DataFrame:
    """Daily maxima of stage, rain and soil per site, side by side.

    `sites` maps `site_id` to its `weather_entity`. Readings are reduced to one row per entity,
    metric and day before they meet the site table.
    """
    rows = history.filter(F.col("metric").isin(STAGE, PRECIP, SOIL))
    if sources:
        rows = rows.filter(F.col("source").isin(sources))
    daily = rows.groupBy("entity_id", "metric", F.to_date("ts").alias("day")).agg(
        F.max("value").alias("value"))
    own = sites.select("site_id", F.col("site_id").alias("entity_id"),
                       F.array(F.lit(STAGE)).alias("wanted"))
    sky = sites.select("site_id", F.col("weather_entity").alias("entity_id"),
                       F.array(F.lit(PRECIP), F.lit(SOIL)).alias("wanted"))
    used = own.unionByName(sky).select("site_id", "entity_id",
                                       F.explode("wanted").alias("metric"))
    named = {STAGE: "stage_ft", PRECIP: "rain_in", SOIL: "soil"}
    return daily.join(used, ["entity_id", "metric"]).groupBy("site_id", "day").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("value"))).alias(n) for m, n in named.items()])


def day_spine(daily: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every day between the first and last stage day, and likewise for rain, per site."""
    def span(column: str) -> DataFrame:
        seen = daily.filter(F.col(column).isNotNull()).groupBy("site_id").agg(
            F.min("day").alias("a"), F.max("day").alias("b"))
        return seen.select("site_id", F.explode(F.sequence("a", "b")).alias("day"))

    # A site without stage has nothing to replay.
    staged = daily.filter(F.col("stage_ft").isNotNull()).select("site_id").distinct()
    days = span("stage_ft").unionByName(
        span("rain_in").join(staged, "site_id", "left_semi")).distinct()
    if start:
        days = days.filter(F.col("day") >= F.lit(start).cast("date"))
    if end:
        days = days.filter(F.col("day") <= F.lit(end).cast("date"))
    return days


def storm_days(days: DataFrame, tracks: DataFrame, sites: DataFrame, max_mi: float | None = None
               ) -> DataFrame:
    """Closest storm of each site and day. Fixes are reduced to distinct positions per day first;
    a site meets only the positions of its own days, and the minimum is a partial aggregate."""
    fixes = tracks.groupBy(F.to_date("datetime").alias("day"), "lat", "lon").agg(
        F.min_by("name", F.struct("datetime", "name")).alias("name"),
        F.min("datetime").alias("at"))
    placed = days.join(sites.select("site_id", "lat", "lon").withColumnsRenamed(
        {"lat": "site_lat", "lon": "site_lon"}), "site_id")
    pairs = placed.join(fixes, "day").withColumn(
        "mi", haversine_mi("site_lat", "site_lon", "lat", "lon"))
    if max_mi is not None:
        pairs = pairs.filter(F.col("mi") <= max_mi)
    best = F.min(F.struct(F.round("mi", 9).alias("mi"), "at", "name")).alias("_best")
    return pairs.groupBy("site_id", "day").agg(best).select(
        "site_id", "day", F.col("_best.mi").alias("storm_mi"),
        F.col("_best.name").alias("storm_name"))


def days(history: DataFrame, tracks: DataFrame, sites: DataFrame, *, start: str | None = None,
         end: str | None = None, sources: list[str] | None = None, max_mi: float | None = None
         ) -> DataFrame:
    """One scored row per site and day.

    Windows run over at most one row per site and calendar day. Rain after the day stands in for
    the forecast, and alerts are not part of the record.
    """
    daily = daily_inputs(history, sites, sources)
    spine = day_spine(daily, start, end)
    storms = storm_days(spine, tracks, sites, max_mi)
    has = daily.groupBy("site_id").agg(F.count("rain_in").alias("_rain_days"))
    w = Window.partitionBy("site_id").orderBy("day")
    rain_known = F.col("_rain_days") > 0
    framed = (
        spine.join(daily, ["site_id", "day"], "left").join(has, "site_id", "left")
        .withColumn("rain_in", F.when(rain_known, F.coalesce("rain_in", F.lit(0.0))))
        .withColumns({
            "qpf_in": forward_sum("rain_in", 3, w), "past_7d_in": past_sum("rain_in", 7, w),
            "rate_ft_per_hr": hourly_rate("stage_ft", w)})
        .drop("_rain_days", "rain_in")
        .join(storms, ["site_id", "day"], "left")
        .withColumn("saturated", F.coalesce(F.col("soil") >= 0.40, F.lit(False)))
        .withColumn("alert", F.lit(False))
    )
    return flood_index.score(framed)


def as_report(scored: DataFrame) -> DataFrame:
    """The replay table with component and trigger maps."""
    return scored.select(
        "site_id", F.col("day").alias("date"), "score", "label",
        flood_index.component_map().alias("components"),
        flood_index.trigger_map().alias("triggers"), "stage_ft",
        F.col("qpf_in").alias("precip_72h_in"), F.col("soil").alias("soil_moisture"),
        F.col("storm_mi").alias("nearest_storm_mi"), "storm_name")


# ---- validation ------------------------------------------------------------------------------

def alert_runs(scored: DataFrame, threshold: int = ALERT_SCORE, keys=("site_id",)) -> DataFrame:
    """Unbroken runs of days at or above the threshold; a missing day ends a run."""
    w = Window.partitionBy(*keys).orderBy("day")
    high = scored.filter(F.col("score") >= threshold).select(*keys, "day")
    island = F.date_sub("day", F.row_number().over(w))
    return (high.withColumn("_island", island).groupBy(*keys, "_island")
            .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                 F.count("*").alias("run_days")).drop("_island"))


def lead_days(scored: DataFrame, events: DataFrame, threshold: int = ALERT_SCORE) -> DataFrame:
    """Days of unbroken warning that end the day before each event (`site_id`, `event_day`)."""
    runs = alert_runs(scored, threshold)
    eve = F.date_sub("event_day", 1)
    hit = events.join(runs, "site_id").filter(eve.between(F.col("first_day"), F.col("last_day")))
    lead = hit.select(*events.columns, (F.datediff(eve, "first_day") + 1).alias("lead_days"))
    return events.join(lead, events.columns, "left").fillna({"lead_days": 0})


def event_window(scored: DataFrame, events: DataFrame, days_each_side: int = 3) -> DataFrame:
    """Replayed days around each event."""
    near = F.col("day").between(F.date_sub("event_day", days_each_side),
                                F.date_add("event_day", days_each_side))
    return scored.join(events, "site_id").filter(near)


def peak_day(scored: DataFrame, keys=("site_id",)) -> DataFrame:
    """Highest score per key, earliest day on ties."""
    rest = [c for c in scored.columns if c not in keys]
    rank = F.struct((-F.col("score")).alias("s"), F.col("day"))
    return (scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_peak"))
            .select(*keys, "_peak.*"))


def label_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("site_id", "label").agg(F.count("*").alias("days"))


def base_rate(scored: DataFrame, threshold: int = ALERT_SCORE) -> DataFrame:
    high = F.col("score") >= threshold
    counted = scored.groupBy("site_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count("*").alias("total_days"), F.count_if(high).alias("alert_days"),
        F.count_if(high & F.col("storm_name").isNotNull()).alias("with_named_storm"),
        *[F.count_if(F.col("label") == name).alias(name.lower())
          for name in (*[n for _, n in index.LABELS], "CALM")])
    return settle(counted, 2, {"alert_pct": F.col("alert_days") / F.col("total_days") * 100.0})


def stored(scored: DataFrame) -> DataFrame:
    """The replay as a written table in the shared folder, so that several reports read it without
    replaying again. It holds one row per site and day."""
    path = run_dir(scored.sparkSession, "replay")
    scored.write.parquet(path)
    return scored.sparkSession.read.schema(scored.schema).parquet(path)


def validate(scored: DataFrame, events: DataFrame, threshold: int = ALERT_SCORE,
             days_each_side: int = 2) -> DataFrame:
    """One row per event: its peak, the warning before it, and how often the index fires."""
    keys = list(events.columns)
    peaks = peak_day(event_window(scored, events, days_each_side), keys)
    parts = [f"index_{n}" for n in index.COMPONENTS]
    peaks = peaks.select(*keys, F.col("day").alias("peak_day"), F.col("score").alias("peak_score"),
                         F.col("label").alias("peak_label"), F.col("stage_ft").alias("peak_stage_ft"),
                         *parts)
    return (lead_days(scored, events, threshold).join(peaks, keys, "left")
            .join(base_rate(scored, threshold), "site_id", "left"))


def elevated_days(scored: DataFrame, threshold: int = ALERT_SCORE) -> DataFrame:
    return scored.filter(F.col("score") >= threshold).select(
        "site_id", "day", "score", "label", "storm_name", "stage_ft")


def write_validation(summary: DataFrame, path: str) -> None:
    """The summary as JSON lines, one per event."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def read_validation(spark, path: str) -> DataFrame | None:
    """The stored summary, or nothing where none was written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.json(path) if found else None


def home_site(spark) -> DataFrame:
    return spark.createDataFrame(
        [(dims.PRIMARY_SITE, dims.HOME_POINT, dims.HOME_LAT, dims.HOME_LON)],
        "site_id string, weather_entity string, lat double, lon double")
