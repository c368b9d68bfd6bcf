import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import store
from hydrospark.sources import snapshots

COLS = "ts timestamp, source string, entity_type string, entity_id string, metric string, value double"


@pytest.fixture
def rows(spark):
    def make(*items):
        return spark.createDataFrame(
            [(dt.datetime.fromisoformat(t), s, "gauge", e, "stage_ft", v) for t, s, e, v in items], COLS)
    return make


def test_append_is_idempotent_and_last_wins(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    first = rows(("2024-09-27T00:00:00", "snapshot", "a", 1.0), ("2024-10-01T00:00:00", "snapshot", "a", 2.0),
                 ("2024-09-27T00:00:00", "snapshot", "a", 1.0))
    assert store.append(first, path) == ["2024-09", "2024-10"]
    assert store.load(spark, path).count() == 2
    again = rows(("2024-09-27T00:00:00", "snapshot", "a", 5.0), ("2024-09-27T01:00:00", "snapshot", "b", None))
    assert store.append(again, path) == ["2024-09"]
    got = {(str(r["ts"]), r["value"]) for r in store.load(spark, path).collect()}
    assert got == {("2024-09-27 00:00:00", 5.0), ("2024-10-01 00:00:00", 2.0)}


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_appends_only_add_files(spark, rows, tmp_path):
    path = tmp_path / "s"
    store.append(rows(("2024-09-27T00:00:00", "snapshot", "a", 1.0), ("2024-09-28T00:00:00", "snapshot", "a", 2.0)), str(path))
    before = files_of(path)
    store.append(rows(("2024-09-27T00:00:00", "snapshot", "a", 5.0), ("2024-10-01T00:00:00", "snapshot", "b", 7.0)), str(path))
    after = files_of(path)
    assert before.items() <= after.items() and len(after) == len(before) + 2
    want = [("a", 2.0), ("a", 5.0), ("b", 7.0)]
    read = lambda: sorted((r["entity_id"], r["value"]) for r in store.load(spark, str(path)).collect())
    assert read() == want
    assert store.compact(spark, str(path)) == ["2024-09"] and read() == want
    assert len(files_of(path)) == 2 and store.compact(spark, str(path)) == []
    store.append(rows(("2024-09-27T00:00:00", "snapshot", "a", 6.0)), str(path))
    assert read() == [("a", 2.0), ("a", 6.0), ("b", 7.0)]
    store.rewrite(rows(("2024-09-01T00:00:00", "snapshot", "c", 9.0)), str(path))
    assert read() == [("b", 7.0), ("c", 9.0)]


def test_a_failed_append_loses_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store.append(rows(("2024-09-27T00:00:00", "snapshot", "a", 1.0)), path)
    breaks = rows(("2024-09-27T00:00:00", "snapshot", "a", 2.0), ("2024-09-28T00:00:00", "snapshot", "a", 3.0)).withColumn(
        "value", F.when(F.col("value") > 2, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        store.append(breaks, path)
    # a rewrite that stopped after it moved its month in, before the older folders were gone
    store.append(rows(("2024-09-27T05:00:00", "snapshot", "b", 4.0)), path)
    assert sorted(r["value"] for r in store.load(spark, path).collect()) == [1.0, 4.0]
    kept = store.read(spark, path).filter("entity_id = 'b'")
    kept.drop(store.MONTH).write.parquet(f"{path}/year_month=2024-09/append_no=5")
    assert [r["value"] for r in store.load(spark, path).collect()] == [4.0]


def test_months_open_no_data_file(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store.append(rows(("2024-09-27T00:00:00", "snapshot", "a", 1.0), ("2024-11-27T00:00:00", "snapshot", "a", 1.0)), path)
    months = store.partitions(spark, path)
    assert [r[0] for r in months.collect()] == ["2024-09", "2024-11"]
    assert "FileScan" not in months._jdf.queryExecution().executedPlan().toString()
    assert store.partitions(spark, str(tmp_path / "nothing")).count() == 0


def test_filters_are_inclusive_and_prune_months(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store.append(rows(*[(f"2024-{m:02d}-15T00:00:00", "snapshot", "a", float(m)) for m in range(1, 7)]), path)
    out = store.load(spark, path, start="2024-02-15", end="2024-04-15", source="snapshot")
    assert sorted(r["value"] for r in out.collect()) == [2.0, 3.0, 4.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan
    assert store.load(spark, str(tmp_path / "nothing")).count() == 0


def test_two_stores_read_as_one(spark, rows, tmp_path):
    a, b = str(tmp_path / "snapshots"), str(tmp_path / "backfill")
    store.append(rows(("2024-09-27T00:00:00", "snapshot", "a", 1.0)), a)
    store.rewrite(rows(("2023-09-27T00:00:00", "usgs_dv", "a", 2.0)), b)
    assert store.load(spark, a, b).count() == 2
    assert sorted(r[0] for r in store.partitions(spark, a, b).collect()) == ["2023-09", "2024-09"]


def test_delete_only_touches_matching_months(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store.append(rows(("2024-01-01T00:00:00", "snapshot", "a", 1.0), ("2024-01-02T00:00:00", "snapshot", "b", 1.0),
                      ("2024-02-01T00:00:00", "snapshot", "b", 1.0), ("2024-03-01T00:00:00", "snapshot", "a", 1.0)), path)
    gone = spark.createDataFrame([("a",)], "entity_id string")
    dry = store.delete(spark, path, gone, dry_run=True)
    assert {(r[0], r[1], r[2]) for r in dry.collect()} == {("2024-01", 2, 1), ("2024-02", 1, 0), ("2024-03", 1, 1)}
    assert store.load(spark, path).count() == 4
    store.delete(spark, path, gone)
    assert {r["entity_id"] for r in store.load(spark, path).collect()} == {"b"}
    assert store.load(spark, path).count() == 2


def test_audit(rows):
    got = {r["entity_type"]: r for r in store.audit(rows(
        ("2024-01-01T00:00:00", "snapshot", "a", 1.0), ("2024-02-01T00:00:00", "usgs_dv", "b", 1.0))).collect()}
    assert got["all"]["rows"] == 2 and got["gauge"]["entities"] == 2 and got["all"]["partitions"] == 2


SNAP = {
    "as_of_epoch": 1727395200,
    "index": {"score": 96, "components": {"stage": 35.0, "bad": "x"}},
    "weather": {"temp_f": "72.5", "humidity_pct": True, "next_72h_precip_in": 3.6},
    "soil": {"error": "down", "soil_moisture_top": 0.4},
    "gauges": [{"site_id": "03451500", "stage_ft": 18.47, "discharge_cfs": -999999}, {"stage_ft": 1.0}],
    "buoys": [{"station_id": "41025", "wave_ht_ft": 10.5}],
    "coastal": [{"station_id": "8651370", "water_level_ft": 1.2}],
    "forests": [{"short": "Pisgah", "fire_weather": {"score": 12.0}, "air_quality": {"us_aqi": 42},
                 "districts_data": [{"name": "Grandfather", "landslide": {"score": 70.0},
                                     "soil": {"soil_moisture_top": 0.3}}, {"landslide": {"score": 1.0}}]}],
}


def test_flatten_snapshot(docs):
    out = snapshots.flatten(snapshots.parse(docs(SNAP)))
    got = {(r["entity_type"], r["entity_id"], r["metric"]): r["value"] for r in out.collect()}
    assert got == {
        ("point", "asheville", "flood_index_score"): 96.0, ("point", "asheville", "flood_index_stage"): 35.0,
        ("point", "asheville", "wx_temp_f"): 72.5, ("point", "asheville", "wx_next_72h_precip_in"): 3.6,
        ("gauge", "03451500", "stage_ft"): 18.47, ("buoy", "41025", "wave_ht_ft"): 10.5,
        ("coastal", "8651370", "water_level_ft"): 1.2, ("forest", "Pisgah", "fire_score"): 12.0,
        ("forest", "Pisgah", "aqi_us_aqi"): 42.0, ("district", "Pisgah/Grandfather", "landslide_score"): 70.0,
        ("district", "Pisgah/Grandfather", "soil_soil_moisture_top"): 0.3}
    assert {str(r["ts"]) for r in out.select(F.col("ts").cast("string").alias("ts")).collect()} == {
        "2024-09-27 00:00:00"}


def test_a_batch_without_an_order_is_hashed_and_not_sorted(spark, rows, tmp_path):
    batch = rows(("2024-09-27T00:00:00", "snapshot", "a", 1.0), ("2024-09-27T00:00:00", "snapshot", "a", 7.0),
                 ("2024-09-27T00:00:00", "snapshot", "a", float("nan")), ("2024-09-27T00:00:00", "snapshot", "b", -3.0))
    plan = store._batch(batch, None)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    store.append(batch, str(tmp_path / "s"))
    assert {(r["entity_id"], r["value"]) for r in store.load(spark, str(tmp_path / "s")).collect()} == {("a", 7.0), ("b", -3.0)}


def test_flatten_is_compiled_and_reads_each_text_once(docs):
    plan = store._batch(snapshots.flatten(snapshots.parse(docs(SNAP))), None)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("try_cast(text") == 1


def test_flatten_of_missing_parts(docs):
    doc = {"as_of_epoch": 1727395200, "index": None, "weather": None, "soil": {"error": "", "soil_moisture_top": 0.4},
           "gauges": [None, {"site_id": "", "stage_ft": 1.0}, {"site_id": 7, "stage_ft": "n/a", "discharge_cfs": "2"}], "buoys": [],
           "forests": [None, {"districts_data": [None, {"name": "Alone", "landslide": {"score": "5"}}, {"name": "", "landslide": {"score": 6}}],
                              "fire_weather": {"score": 1.0}}, {"short": "Uwharrie", "fire_weather": {"error": "down", "score": 2.0}, "air_quality": {"pm10": 3}}]}
    out = snapshots.flatten(snapshots.parse(docs(doc, "{", "null"))).collect()
    assert sorted((r["entity_type"], r["entity_id"], r["metric"], r["value"]) for r in out) == [
        ("district", "Alone", "landslide_score", 5.0), ("forest", "Uwharrie", "aqi_pm10", 3.0), ("gauge", "7", "discharge_cfs", 2.0),
        ("point", "asheville", "soil_soil_moisture_top", 0.4)]


def test_a_hot_month_is_cut_and_its_rows_are_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    made = spark.range(40_000).select(
        F.timestamp_seconds(F.lit(1727395200) + F.col("id") % 1000).alias("ts"), F.lit("snapshot").alias("source"), F.lit("gauge").alias("entity_type"),
        (F.col("id") * 7919 % 40_009).cast("string").alias("entity_id"), F.lit("stage_ft").alias("metric"), F.col("id").cast("double").alias("value"))
    path, name = tmp_path / "s", "spark.sql.maxConcurrentOutputFileWriters"
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "50k"}
    for conf, size in sizes.items():
        spark.conf.set(conf, size)
    try:
        store.append(made.mapInPandas(look, COLS), str(path))
    finally:
        for conf in sizes:
            spark.conf.unset(conf)
    assert seen.value == 40_000 and not spark.conf.get(name, None)
    files = [spark.read.parquet(str(p)).coalesce(1).collect() for p in path.rglob("*.parquet")]
    assert len(files) > 2 and all([r["entity_id"] for r in f] == sorted(r["entity_id"] for r in f) for f in files)
    assert max(map(len, files)) < 30_000 and store.load(spark, str(path)).distinct().count() == 40_000
    assert "REBALANCE" in store._laid_out(store._batch(made, None))._jdf.queryExecution().executedPlan().toString()


def test_more_months_than_open_writers_and_no_adaptive_execution(spark, rows, tmp_path):
    many = rows(*[(f"{1990 + i // 12}-{i % 12 + 1:02d}-15T00:00:00", "snapshot", e, float(i)) for i in range(store.WRITERS + 5) for e in "ba"])
    assert len(store.append(many.coalesce(1), str(tmp_path / "s"))) == store.WRITERS + 5
    assert store.load(spark, str(tmp_path / "s")).count() == 2 * store.WRITERS + 10
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = store._laid_out(store._batch(many, None))._jdf.queryExecution().executedPlan().toString()
        assert store.append(many.where("ts < '1990-03-01'"), str(tmp_path / "t")) == ["1990-01", "1990-02"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "rangepartitioning" in plan and "REBALANCE" not in plan
    assert store.load(spark, str(tmp_path / "t")).count() == 4
