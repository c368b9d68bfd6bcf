"""Live ingest, roll-ups, rate of rise, staleness and index."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hydrospark.operators import flood_index, store
from hydrospark.schema import HISTORY_COLS, HISTORY_KEY, SNAPSHOT
from hydrospark.sources import snapshots

WATERMARK = "2 hours"


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once
            else writer.trigger(processingTime="1 minute")).start()


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files as they land."""
    return spark.readStream.schema(SNAPSHOT).option("multiLine", True).json(path)


def ingest_snapshots(documents: DataFrame, store_path: str, checkpoint: str, once: bool = True
                     ) -> StreamingQuery:
    """Flatten snapshots and merge them into the store; a repeated batch changes nothing.

    Undated documents take the time of their batch, which the stream records, so that it is the same
    when the batch is repeated.
    """
    documents = documents.withColumn("arrived", F.current_timestamp())

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.append(snapshots.flatten(batch), store_path)

    return _start(documents.writeStream.foreachBatch(merge), checkpoint, once)


def deduplicated(rows: DataFrame, watermark: str = WATERMARK, key: Sequence[str] = HISTORY_KEY
                 ) -> DataFrame:
    """First arrival per key within the watermark. Event time must be a zoned timestamp."""
    return (rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(list(key)))


def hourly_maxima(rows: DataFrame, watermark: str = WATERMARK,
                  keys: Sequence[str] = ("source", "entity_type", "entity_id", "metric")
                  ) -> DataFrame:
    """Tumbling hourly maximum per series, with a map-side part before the state shuffle."""
    return (rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 hour").alias("_w"), *keys)
            .agg(F.max("value").alias("value"))
            .select(F.col("_w.start").alias("ts"), *keys, "value"))


def keep_rolled_up(rolled: DataFrame, store_path: str, checkpoint: str, once: bool = True
                   ) -> StreamingQuery:
    """Upsert every changed hour into the store, so that open hours are visible at once."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.append(batch.select(*HISTORY_COLS), store_path)

    return _start(rolled.writeStream.outputMode("update").foreachBatch(upsert), checkpoint, once)


def write_rows(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append-only file sink."""
    return _start(rows.writeStream.outputMode("append").format("parquet").option("path", path),
                  checkpoint, once)


# ---- tables of the latest rows -------------------------------------------------------------------

def _generations(spark: SparkSession, path: str) -> list[int]:
    """Complete generations of a table, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("generation=")]
    done = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().split("=")[1]) for f in done)


def upsert(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str]) -> None:
    """Replace the rows of a batch's keys in a table of one row (or one list of rows) for each key.

    A batch writes a generation of its own from the one before, so that a repeated batch gives the same
    table, readers never see half of one, and a failed one loses nothing. Two generations stay. The table holds the
    latest rows alone, so it grows with the keys and not with the stream.
    """
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    older = [g for g in _generations(spark, path) if g < batch_id]
    rows = batch
    if older:
        before = spark.read.schema(batch.schema).parquet(f"{path}/generation={older[-1]}")
        rows = batch.unionByName(before.join(batch.select(*keys).distinct(), list(keys), "left_anti"))
    rows.write.mode("overwrite").parquet(f"{path}/generation={batch_id}")
    for old in older[:-1]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete generation of a table."""
    return spark.read.parquet(f"{path}/generation={_generations(spark, path)[-1]}")


# ---- rate of rise ----------------------------------------------------------------------------

RATES = ("entity_id string, first_value double, last_value double, first_ts timestamp, last_ts timestamp, "
         "n bigint, rate_ft_per_hr double")


def _newest(last: int):
    """The newest readings of every site in a task's batch: all that can matter to its rate."""
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["us", "value"], ascending=False).groupby("entity_id").head(last)

    return keep


def _rate(last: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in json.loads(state.get[0])] if state.exists else []
        for batch in batches:
            rows += zip(batch["us"].tolist(), batch["value"].tolist())
        rows = sorted(rows, reverse=True)[:last]
        state.update((json.dumps(rows),))
        (newest, high), (oldest, low) = rows[0], rows[-1]
        hours = (newest - oldest) / 3.6e9
        yield pd.DataFrame({
            "entity_id": [key[0]], "first_value": [low], "last_value": [high],
            "first_ts": [pd.Timestamp(oldest, unit="us", tz="UTC")],
            "last_ts": [pd.Timestamp(newest, unit="us", tz="UTC")], "n": [len(rows)],
            "rate_ft_per_hr": [(high - low) / hours if len(rows) > 1 and hours > 0 else None]})

    return step


def rates(readings: DataFrame, last: int = 12) -> DataFrame:
    """Rate of rise per site over its last readings, a row whenever the site reports.

    A stateful operator: Spark's state store carries `last` readings of each site from batch to
    batch. Each task keeps its newest rows per site before anything is shuffled, so one busy site costs
    no more than any other. Readings without a time or a value are left out.
    """
    rows = readings.select("entity_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
                           "value").where("entity_id is not null and us is not null and value is not null")
    kept = rows.mapInPandas(_newest(last), "entity_id string, us bigint, value double")
    return kept.groupBy("entity_id").applyInPandasWithState(
        _rate(last), RATES, "readings string", "update", GroupStateTimeout.NoTimeout)


def track_rates(readings: DataFrame, out_path: str, checkpoint: str, last: int = 12,
                once: bool = True) -> StreamingQuery:
    """One table of the sites' rates, brought up to date by every batch."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, out_path, ["entity_id"])

    return _start(rates(readings, last).writeStream.outputMode("update").foreachBatch(keep),
                  checkpoint, once)


def current_rates(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest rate of every site."""
    return latest(spark, out_path)


# ---- staleness -------------------------------------------------------------------------------

ALARM = "feed string, last_ts timestamp, silent boolean"


def _watch(limit_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        silent = state.hasTimedOut
        for batch in batches:
            known = batch["ms"].dropna()  # a timeout comes with an empty batch
            if len(known):
                newest = int(known.max())
                seen = newest if seen is None else max(seen, newest)
        state.update((seen,))
        state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame({"feed": [key[0]], "last_ts": [pd.Timestamp(seen, unit="ms", tz="UTC")],
                            "silent": [silent]})

    return step


def watch_feeds(rows: DataFrame, limit_minutes: float = 75) -> DataFrame:
    """A row per feed whenever it reports, and one marked silent once nothing came for the limit.

    Runs on a clock, so use it with a processing-time trigger: a run-to-the-end trigger never ends.
    """
    feeds = rows.select("feed", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return feeds.groupBy("feed").applyInPandasWithState(
        _watch(int(limit_minutes * 60_000)), ALARM, "seen bigint", "update",
        GroupStateTimeout.ProcessingTimeTimeout)


def last_seen(rows: DataFrame) -> DataFrame:
    """Newest time per feed as a streaming aggregate, pre-aggregated before the shuffle."""
    return rows.groupBy("feed").agg(F.max(F.col("ts").cast("timestamp")).alias("last_ts"))


def keep_last_seen(rows: DataFrame, out_path: str, checkpoint: str, once: bool = True
                   ) -> StreamingQuery:
    def keep(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, out_path, ["feed"])

    return _start(last_seen(rows).writeStream.outputMode("update").foreachBatch(keep), checkpoint,
                  once)


def current_feeds(spark: SparkSession, out_path: str) -> DataFrame:
    return latest(spark, out_path)


def silences(rows: DataFrame, limit: str = "75 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Alarms on event time: a row for each stretch of reports of a feed that ended in silence.

    (feed, first_ts, last_ts, n, silent_at.) Reports less than the limit apart are one stretch, a session window whose
    timer the watermark drives: when it has passed last_ts by the limit, the feed fell silent at that time and the row is
    given, once. A feed that returns starts a new stretch, its `first_ts`. Reports that come late within the watermark join the
    stretch they belong to. The stream's own time decides, so a run to the end stops; stretches that are still
    open have no row. Sessions are merged within tasks before the shuffle, so a busy feed costs a row for each task.
    """
    return (rows.select("feed", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
            .groupBy("feed", F.session_window("ts", limit).alias("w"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
            .select("feed", "first_ts", "last_ts", "n", F.col("w.end").alias("silent_at")))


# ---- live index ------------------------------------------------------------------------------

#: What a report of each feed holds; storms and alerts are lists, of which a newer report replaces the whole.
FEEDS = {
    "gauge": "stage_ft double, rate_ft_per_hr double",
    "weather": "next_72h_precip_in double",
    "soil": "soil_moisture_top double, soil_moisture_shallow double, saturated boolean, past_7d_precip_in double",
    "storm": "distance_mi double",
    "alert": "event string",
}
REPORTS = "site_id string, feed string, entity string, us bigint, payload string"


def reports(rows: DataFrame, feed: str) -> DataFrame:
    """Rows (site_id, entity, ts and the feed's columns) as reports; a null entity says that a list is empty."""
    fields = [c.split()[0] for c in FEEDS[feed].split(", ")]
    return rows.select("site_id", F.lit(feed).alias("feed"), F.col("entity").cast("string").alias("entity"),
                       F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.to_json(F.struct(*fields)).alias("payload"))


def _newest_reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each site and feed the newest report in a task's batch."""
    for batch in batches:
        yield batch[batch["us"] == batch.groupby(["site_id", "feed"])["us"].transform("max")]


def _hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A site's newest report of every feed, by entity; all of them are given whenever the site reports."""
    held = json.loads(state.get[0]) if state.exists else {}
    for batch in batches:
        for feed, entity, us, payload in zip(*(batch[c].tolist() for c in ("feed", "entity", "us", "payload")), strict=True):
            newest = held.get(feed)
            if newest is None or us > newest[0]:
                newest = held[feed] = [us, {}]
            if us == newest[0] and entity is not None:
                newest[1][entity] = max(payload, newest[1].get(entity, ""))
    state.update((json.dumps(held, sort_keys=True),))
    rows = [(key[0], feed, entity, us, payload) for feed, (us, entries) in sorted(held.items()) for entity, payload in sorted(entries.items())]
    yield pd.DataFrame(rows, columns=["site_id", "feed", "entity", "us", "payload"])


def newest_reports(feeds: DataFrame) -> DataFrame:
    """The present reports of every site that a batch brought something for: all feeds, whichever of them came.

    Spark's state store holds a map by feed and entity for each site. Of reports with one time the entities add up;
    for one entity twice the larger payload counts. Each task passes its newest reports alone. Reports
    without a site, feed or time are left out.
    """
    known = feeds.where("site_id is not null and feed is not null and us is not null")
    return known.mapInPandas(_newest_reports, REPORTS).groupBy("site_id").applyInPandasWithState(
        _hold, REPORTS, "held string", "update", GroupStateTimeout.NoTimeout)


def index_inputs(present: DataFrame) -> DataFrame:
    """Index inputs of every site that has a gauge, from the present reports of its feeds."""
    def of(feed: str) -> DataFrame:
        return present.filter(F.col("feed") == feed).select("site_id", F.from_json("payload", FEEDS[feed]).alias("p")).select("site_id", "p.*")

    return flood_index.gather_inputs(*[of(f) for f in ("gauge", "weather", "soil", "storm", "alert")])


def score_live(feeds: DataFrame, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The flood index of every site over the newest report of each feed, brought up to date by every batch."""
    def score(batch: DataFrame, batch_id: int) -> None:
        upsert(flood_index.score(index_inputs(batch.persist())), batch_id, out_path, ["site_id"])
        batch.unpersist()

    return _start(newest_reports(feeds).writeStream.outputMode("update").foreachBatch(score), checkpoint, once)


def current_scores(spark: SparkSession, out_path: str) -> DataFrame:
    return latest(spark, out_path)
