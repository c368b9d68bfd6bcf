"""Streaming queries: the event table read as a stream and run to its end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hydrospark.operators import store
from hydrospark.registry import query
from hydrospark.registry.gauges import RATE_SQL
from hydrospark.registry.history import SNAP_SQL, documents_of
from hydrospark.registry.index import (
    LABEL, PARTS, TOTAL, parts_sql,
)
from hydrospark.registry.tables import H_SQL, plain_times, rounded, spread, table
from hydrospark.schema import HISTORY_COLS
from hydrospark.session import configure, run_dir
from hydrospark.sources import snapshots
from hydrospark.streaming import live

COLS = ", ".join(HISTORY_COLS)


def stream(spark, sf_dir, name="events"):
    configure(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir))
    times = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in times})


def history_rows(events):
    source = (F.when(F.col("event_id") % 3 == 0, "usgs_iv").when(F.col("event_id") % 3 == 1, "snapshot")
              .otherwise("usgs_dv"))
    return events.select("ts", source.alias("source"), F.lit("user").alias("entity_type"),
                         F.col("user_id").cast("string").alias("entity_id"),
                         F.col("event_type").alias("metric"), "value")


@query("stream_hourly_max", f"""WITH {H_SQL}
SELECT date_trunc('hour', ts) AS ts, source, entity_type, entity_id, metric, max(value) AS value FROM h GROUP BY ALL""")
def stream_hourly_max(spark, sf_dir):
    path = run_dir(spark, "stream")
    rolled = live.hourly_maxima(history_rows(stream(spark, sf_dir)))
    live.keep_rolled_up(rolled, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return plain_times(store.load(spark, f"{path}/store"))


@query("stream_dedupe", f"WITH {H_SQL} SELECT {COLS} FROM h")
def stream_dedupe(spark, sf_dir):
    """Every event is sent twice; each key arrives once."""
    path = run_dir(spark, "stream")
    twice = history_rows(stream(spark, sf_dir)).withColumn(
        "_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    live.write_rows(live.deduplicated(twice), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return plain_times(spark.read.parquet(f"{path}/rows").select(*HISTORY_COLS))


@query("stream_rate_of_rise", f"""WITH {RATE_SQL}
SELECT entity_id, first_value, last_value, first_ts, last_ts, n, round(rate, 6) AS rate_ft_per_hr FROM ra""")
def stream_rate_of_rise(spark, sf_dir):
    path = run_dir(spark, "stream")
    readings = stream(spark, sf_dir).select(F.col("event_type").alias("entity_id"), "ts", "value")
    live.track_rates(readings, f"{path}/rates", f"{path}/checkpoint").awaitTermination()
    return rounded(live.current_rates(spark, f"{path}/rates"))


@query("stream_snapshots", SNAP_SQL + f""",
rows AS (SELECT make_timestamp(sec * 1000000) AS ts, 'snapshot' AS source, entity_type, entity_id, metric, round(value, 6) AS value FROM cells)
SELECT ts, source, entity_type, entity_id, metric, max(value) AS value FROM rows GROUP BY ALL""")
def stream_snapshots(spark, sf_dir):
    """Snapshot documents flattened into the store as they arrive; of documents with the same time
    and key the store keeps the largest value, the last by its tie rule."""
    path = run_dir(spark, "stream")
    docs = snapshots.parse(documents_of(spread(stream(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")))
    live.ingest_snapshots(docs, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return rounded(store.load(spark, f"{path}/store"))


@query("stream_last_seen", """
SELECT event_type AS feed, max(ts) AS last_ts FROM events GROUP BY 1""")
def stream_last_seen(spark, sf_dir):
    """Newest time per feed, kept up to date batch by batch."""
    path = run_dir(spark, "stream")
    rows = stream(spark, sf_dir).select(F.col("event_type").alias("feed"), "ts")
    live.keep_last_seen(rows, f"{path}/feeds", f"{path}/checkpoint").awaitTermination()
    return plain_times(live.current_feeds(spark, f"{path}/feeds"))


def _in_batches(spark, rows, parts, label):
    """The rows as a stream of one batch for each part (a condition), in order."""
    path = run_dir(spark, label)
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_feed_alarm", """
WITH e AS (SELECT event_type || (user_id % 10) AS feed, ts FROM events),
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 75 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY feed ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY feed ORDER BY ts) AS stretch FROM g)
SELECT feed, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(ts) + INTERVAL 75 MINUTE AS silent_at FROM s GROUP BY feed, stretch
HAVING max(ts) + INTERVAL 75 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 2 HOUR""")
def stream_feed_alarm(spark, sf_dir):
    """Feeds that fell silent and returned, over three batches in order of time."""
    events = table(spark, sf_dir, "events").select(
        F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("feed"), F.col("ts").cast("timestamp").alias("ts"))
    day = "day(ts) {} 10 and day(ts) {} 20"
    rows = _in_batches(spark, events, [day.format("<", "<"), day.format(">=", "<"), day.format(">=", ">=")], "feeds")
    path = run_dir(spark, "stream")
    live.write_rows(live.silences(rows), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return plain_times(spark.read.parquet(f"{path}/rows"))


@query("stream_live_index", f"""WITH e AS (
  SELECT CAST(user_id % 50 AS VARCHAR) AS site_id, event_type, event_id, value,
    CASE WHEN event_type IN ('purchase', 'signup') THEN date_trunc('day', ts) ELSE ts END AS ts FROM events),
n AS (SELECT *, max(ts) OVER (PARTITION BY site_id, event_type) AS newest FROM e),
i AS (SELECT site_id, max(value) FILTER (event_type = 'view') / 20 AS stage_ft, max(value) FILTER (event_type = 'view') / 500 - 0.1::DOUBLE AS rate,
    max(value) FILTER (event_type = 'click') / 60 AS qpf_in, max(value) FILTER (event_type = 'error') / 300 AS soil,
    max(value) FILTER (event_type = 'error') / 300 >= 0.4::DOUBLE AS saturated, max(value) FILTER (event_type = 'error') / 50 AS past,
    min(value) FILTER (event_type = 'purchase') * 50 AS storm_mi, bool_or(event_id % 2 = 0) FILTER (event_type = 'signup') AS alert
  FROM n WHERE ts = newest GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0),
c AS (SELECT *, {parts_sql('stage_ft', 'qpf_in', 'storm_mi', 'rate', 'alert', 'soil', 'past')} FROM i),
s AS (SELECT *, {TOTAL} AS score FROM c)
SELECT site_id, {PARTS}, score, {LABEL} AS label FROM s""")
def stream_live_index(spark, sf_dir):
    """The index over the newest report of five feeds, which come in batches of their own: gauges and rain, then soil, then the
    lists of storms and alerts of a day."""
    v, kind = F.col("value"), F.col("event_type")
    events = table(spark, sf_dir, "events").withColumns({
        "site_id": (F.col("user_id") % 50).cast("string"), "entity": F.when(kind.isin("purchase", "signup"), F.col("event_id")).otherwise(0)})
    daily = F.date_trunc("day", "ts").alias("ts")
    feeds = [live.reports(events.where(kind == of).select("site_id", "entity", at, *columns), feed) for of, feed, at, columns in (
        ("view", "gauge", "ts", [(v / 20).alias("stage_ft"), (v / 500 - 0.1).alias("rate_ft_per_hr")]),
        ("click", "weather", "ts", [(v / 60).alias("next_72h_precip_in")]),
        ("error", "soil", "ts", [(v / 300).alias("soil_moisture_top"), F.lit(None).cast("double").alias("soil_moisture_shallow"),
                                 (v / 300 >= 0.4).alias("saturated"), (v / 50).alias("past_7d_precip_in")]),
        ("purchase", "storm", daily, [(v * 50).alias("distance_mi")]),
        ("signup", "alert", daily, [F.when(F.col("event_id") % 2 == 0, "Flood Warning").otherwise("Wind Advisory").alias("event")]))]
    rows = reduce(lambda a, b: a.unionByName(b), feeds)
    stream_ = _in_batches(spark, rows, ["feed in ('gauge', 'weather')", "feed = 'soil'", "feed in ('storm', 'alert')"], "feeds")
    path = run_dir(spark, "stream")
    live.score_live(stream_, f"{path}/scores", f"{path}/checkpoint").awaitTermination()
    return live.current_scores(spark, f"{path}/scores").select(
        "site_id", *[c.strip() for c in PARTS.split(",")], "score", "label")
