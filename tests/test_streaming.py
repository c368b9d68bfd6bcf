import datetime as dt
import json
import time

from pyspark.sql import functions as F

from hydrospark.operators import store
from hydrospark.streaming import live

HIST = "ts timestamp, source string, entity_type string, entity_id string, metric string, value double"


def land(spark, path, name, rows, schema=HIST):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def row(minute, value, entity="a"):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), "snapshot", "gauge", entity, "stage_ft", float(value))


def read(spark, path, schema=HIST):
    return (spark.readStream.schema(schema).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(path))


def test_snapshot_ingest_is_idempotent(spark, tmp_path):
    landed, path = tmp_path / "in", str(tmp_path / "store")
    landed.mkdir()
    doc = {"as_of_epoch": 1727395200, "gauges": [{"site_id": "03451500", "stage_ft": 18.47}]}
    (landed / "a.json").write_text(json.dumps(doc))
    (landed / "b.json").write_text(json.dumps(doc))
    for _ in range(2):
        live.ingest_snapshots(live.snapshot_stream(spark, str(landed)), path, str(tmp_path / "cp")).awaitTermination(60)
    assert [(r["entity_id"], r["value"]) for r in store.load(spark, path).collect()] == [("03451500", 18.47)]


def test_dedupe_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, "one", [row(0, 1), row(15, 2)])
    land(spark, src, "two", [row(15, 9), row(30, 3)])
    live.write_rows(live.deduplicated(read(spark, src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and out.select("ts").distinct().count() == 3


def test_hourly_maximum_is_upserted(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "store")
    land(spark, src, "one", [row(0, 1), row(70, 5)])
    land(spark, src, "two", [row(30, 4), row(80, 2)])
    live.keep_rolled_up(live.hourly_maxima(read(spark, src)), path, str(tmp_path / "cp")).awaitTermination(120)
    got = {str(r["ts"]): r["value"] for r in store.load(spark, path).collect()}
    assert got == {"2024-01-01 00:00:00": 4.0, "2024-01-01 01:00:00": 5.0}


def test_rates_carry_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "entity_id string, ts timestamp, value double"
    start = dt.datetime(2024, 1, 1)
    points = [("a", start + dt.timedelta(minutes=15 * i), 1.0 + i * i / 100) for i in range(20)]
    land(spark, src, "one", points[:9], schema)
    land(spark, src, "two", points[9:] + [("b", start, 3.0)], schema)
    live.track_rates(read(spark, src, schema), str(tmp_path / "rates"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["entity_id"]: r for r in live.current_rates(spark, str(tmp_path / "rates")).collect()}
    hours = 11 * 0.25
    assert abs(got["a"]["rate_ft_per_hr"] - (points[19][2] - points[8][2]) / hours) < 1e-9
    assert got["a"]["n"] == 12 and got["b"]["rate_ft_per_hr"] is None


def test_silences_on_event_time(spark, tmp_path):
    src, schema, day = str(tmp_path / "in"), "feed string, ts timestamp", dt.datetime(2024, 1, 1)
    at = lambda feed, *minutes: [(feed, day + dt.timedelta(minutes=m)) for m in minutes]
    land(spark, src, "one", at("x", 0, 30, 60) + at("y", 0, 60, 120, 180), schema)
    land(spark, src, "two", at("x", 130) + at("y", 240, 300, 350), schema)  # x 130 is late, within the watermark
    land(spark, src, "three", at("x", 400) + at("y", 410, 470, 530, 600) + at("z", 610, 900), schema)
    live.write_rows(live.silences(read(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(((r["feed"], *((r[c] - day).seconds // 60 for c in ("first_ts", "last_ts", "silent_at")), r["n"])
                  for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("x", 0, 130, 205, 4), ("x", 400, 400, 475, 1), ("y", 0, 600, 675, 11), ("z", 610, 610, 685, 1)]


def test_live_index_over_feeds_and_batches(spark, tmp_path):
    src, out, day = str(tmp_path / "in"), str(tmp_path / "out"), dt.datetime(2024, 1, 1)

    def report(feed, hour, *rows):
        fields = live.FEEDS[feed].split(", ")
        schema = "site_id string, entity string, ts timestamp, " + ", ".join(fields)
        return live.reports(spark.createDataFrame([(s, e, day + dt.timedelta(hours=hour), *v) for s, e, *v in rows], schema), feed)

    def batch(name, *parts):
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows.coalesce(1).write.parquet(f"{src}/{name}")

    def run():
        live.score_live(read(spark, src, live.REPORTS), out, str(tmp_path / "cp")).awaitTermination(120)
        return {r["site_id"]: r for r in live.current_scores(spark, out).collect()}

    batch("one", report("gauge", 2, ("a", "g", 18.0, 0.5), ("b", "g", 0.0, 0.0)), report("storm", 2, ("a", "s1", 400.0), ("a", "s2", 200.0)))
    got = run()
    assert (got["a"]["index_stage"], got["a"]["index_storm"], got["a"]["index_rise"], got["b"]["score"]) == (35.0, 20.0, 5.0, 0)
    batch("two", report("weather", 3, ("a", "w", 5.0)), report("gauge", 1, ("b", "g", 18.0, 9.0)), report("alert", 3, ("a", "1", "Flood Warning")))
    got = run()  # an older report changes nothing, other feeds are remembered
    assert (got["a"]["index_stage"], got["a"]["index_qpf"], got["a"]["alert"], got["b"]["index_stage"]) == (35.0, 20.0, True, 0.0)
    batch("three", report("storm", 4, ("a", "s1", 1500.0)), report("alert", 4, ("a", None, None)), report("soil", 4, ("c", "p", 0.3, None, False, 1.0)))
    got = run()  # a newer list replaces the whole list; a site without a gauge has no index
    assert (got["a"]["index_storm"], got["a"]["index_alert"], got["a"]["index_qpf"]) == (0.0, 0.0, 20.0) and set(got) == {"a", "b"}


def test_a_repeated_or_failed_batch_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    for number, batch in enumerate([rows(("a", 1), ("b", 1)), rows(("b", 2)), rows(("b", 2)), rows(("c", 3))]):
        live.upsert(batch, min(number, 2) if number < 3 else 3, path, ["k"])
    live.upsert(rows(("c", 3)), 3, path, ["k"])
    (tmp_path / "t" / "generation=9").mkdir()  # a batch that did not come to its end
    assert sorted(map(tuple, live.latest(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["generation=2", "generation=3", "generation=9"]


def test_silent_feed_raises_an_alarm(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "feed string, ts timestamp"
    land(spark, src, "one", [("x", dt.datetime(2024, 1, 1))], schema)

    def keep(batch, batch_id):
        batch.write.mode("append").parquet(out)

    q = (live.watch_feeds(read(spark, src, schema), limit_minutes=0.02).writeStream.outputMode("update")
         .foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(processingTime="1 second").start())
    try:
        for _ in range(40):
            time.sleep(1)
            try:
                if spark.read.parquet(out).filter(F.col("silent")).count():
                    break
            except Exception:  # noqa: BLE001 - nothing written yet
                continue
        seen = spark.read.parquet(out)
        assert seen.filter(~F.col("silent")).count() and seen.filter(F.col("silent")).count()
    finally:
        q.stop()
