"""History-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.operators import store, timeseries
from hydrospark.registry import query
from hydrospark.registry.tables import H_SQL, history, plain_times, rounded, spread, table
from hydrospark.schema import HISTORY_COLS
from hydrospark.session import run_dir
from hydrospark.sources import snapshots

COLS = ", ".join(HISTORY_COLS)


@query("history_filter", f"""WITH {H_SQL}
SELECT {COLS} FROM h
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
  AND source = 'usgs_iv' AND metric = 'view'""")
def history_filter(spark, sf_dir):
    return plain_times(store.in_range(
        history(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-20 12:00:00", source="usgs_iv",
        metric="view").select(*HISTORY_COLS))


KEEP_SQL = f"""{H_SQL},
hour AS (SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM h),
again AS (SELECT * FROM hour UNION ALL
          SELECT ts, source, entity_type, entity_id, metric, value + 1 AS value, seq + 1000000000 AS seq
          FROM hour WHERE source = 'snapshot'),
kept AS (SELECT {COLS} FROM again
         QUALIFY row_number() OVER (PARTITION BY ts, source, entity_type, entity_id, metric ORDER BY seq DESC) = 1)"""


def _twice(spark, sf_dir):
    hour = history(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    again = (hour.filter(F.col("source") == "snapshot")
             .withColumn("value", F.col("value") + 1)
             .withColumn("seq", F.col("seq") + 1_000_000_000))
    return hour, again


@query("history_keep_last", f"WITH {KEEP_SQL} SELECT {COLS} FROM kept")
def history_keep_last(spark, sf_dir):
    hour, again = _twice(spark, sf_dir)
    return plain_times(store.keep_last(hour.unionByName(again), "seq").select(*HISTORY_COLS))


@query("history_store_append", f"WITH {KEEP_SQL} SELECT {COLS} FROM kept")
def history_store_append(spark, sf_dir):
    """Two appends to a store on disk, the second overlapping the first, then a read."""
    hour, again = _twice(spark, sf_dir)
    path = run_dir(spark, "store")
    store.append(hour, path, "seq")
    store.append(again, path, "seq")
    return plain_times(store.load(spark, path))


@query("history_store_compact", f"WITH {KEEP_SQL} SELECT {COLS} FROM kept")
def history_store_compact(spark, sf_dir):
    """The same appends, merged month by month: the rows stay the same."""
    hour, again = _twice(spark, sf_dir)
    path = run_dir(spark, "store")
    store.append(hour, path, "seq")
    store.append(again, path, "seq")
    store.compact(spark, path)
    return plain_times(store.load(spark, path))


@query("history_months", """
SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS year_month FROM lineitem""")
def history_months(spark, sf_dir):
    """Months of a store, from its folders' names."""
    path, line = run_dir(spark, "store"), table(spark, sf_dir, "lineitem")
    store.append(line.select(F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("snapshot").alias("source"), F.lit("gauge").alias("entity_type"),
                             F.col("l_suppkey").cast("string").alias("entity_id"), F.lit("stage_ft").alias("metric"),
                             F.col("l_quantity").cast("double").alias("value"), F.col("l_orderkey").alias("seq")), path, "seq")
    return store.partitions(spark, path)


@query("history_audit", f"""WITH {H_SQL}
SELECT coalesce(entity_type, 'all') AS entity_type, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
  count(DISTINCT entity_id) AS entities, count(DISTINCT metric) AS metrics, count(DISTINCT source) AS sources,
  count(DISTINCT strftime(ts, '%Y-%m')) AS partitions
FROM (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN 'gauge' ELSE 'buoy' END AS entity_type) FROM h)
GROUP BY ROLLUP (entity_type)""")
def history_audit(spark, sf_dir):
    kind = F.when(F.col("seq") % 2 == 0, "gauge").otherwise("buoy")
    return plain_times(store.audit(history(spark, sf_dir).withColumn("entity_type", kind)))


@query("history_pivot", """
SELECT date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(value, event_id) FILTER (event_type = 'click') AS click,
  arg_max(value, event_id) FILTER (event_type = 'error') AS error,
  arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase,
  arg_max(value, event_id) FILTER (event_type = 'signup') AS signup,
  arg_max(value, event_id) FILTER (event_type = 'view') AS view
FROM events GROUP BY 1""")
def history_pivot(spark, sf_dir):
    daily = history(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts"))
    return plain_times(timeseries.pivot_metric(
        daily, ["click", "error", "purchase", "signup", "view"], column="metric", tie="seq"))


@query("history_delete", f"""WITH {H_SQL}
SELECT {COLS} FROM h WHERE entity_id NOT IN (
  SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""")
def history_delete(spark, sf_dir):
    gone = (table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").cast("string").alias("entity_id")))
    return plain_times(store.without(history(spark, sf_dir), gone).select(*HISTORY_COLS))


@query("history_delete_counts", f"""WITH {H_SQL},
gone AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS scanned,
       count(*) FILTER (entity_id IN (SELECT id FROM gone)) AS removed
FROM h GROUP BY 1""")
def history_delete_counts(spark, sf_dir):
    """The same delete against a store on disk: what each month held and lost."""
    gone = (table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").cast("string").alias("entity_id")))
    path = run_dir(spark, "store")
    store.append(history(spark, sf_dir), path, "seq")
    return store.delete(spark, path, gone)


# One snapshot document per line item, with a sentinel, a junk number and a failed block in it.
SNAP_SQL = """WITH b AS (SELECT epoch(l_shipdate)::BIGINT + l_linenumber AS sec, * FROM lineitem),
cells AS (
  SELECT sec, 'point' AS entity_type, 'asheville' AS entity_id, 'flood_index_score' AS metric, l_quantity AS value FROM b
  UNION ALL SELECT sec, 'point', 'asheville', 'flood_index_stage', l_discount * 100 FROM b
  UNION ALL SELECT sec, 'point', 'asheville', 'wx_temp_f', l_tax * 1000 FROM b WHERE l_returnflag <> 'R'
  UNION ALL SELECT sec, 'point', 'asheville', 'wx_wind_mph', l_quantity FROM b WHERE l_returnflag <> 'R'
  UNION ALL SELECT sec, 'point', 'asheville', 'soil_soil_moisture_top', l_discount FROM b
  UNION ALL SELECT sec, 'gauge', CAST(l_partkey AS VARCHAR), 'stage_ft', l_quantity FROM b WHERE l_linenumber <> 3
  UNION ALL SELECT sec, 'gauge', CAST(l_partkey AS VARCHAR), 'discharge_cfs', l_extendedprice FROM b WHERE l_linenumber <> 4
  UNION ALL SELECT sec, 'gauge', CAST(l_suppkey AS VARCHAR), 'pool_elevation_ft', l_extendedprice FROM b
  UNION ALL SELECT sec, 'forest', l_linestatus, 'fire_score', l_quantity FROM b
  UNION ALL SELECT sec, 'forest', l_linestatus, 'aqi_us_aqi', l_quantity * 2 FROM b
  UNION ALL SELECT sec, 'district', l_linestatus || '/' || l_returnflag, 'landslide_score', l_quantity FROM b)
"""


def documents_of(li):

    def text(c):
        return c.cast("string")

    gauge = F.array(
        F.struct(text(F.col("l_partkey")).alias("site_id"),
                 F.when(F.col("l_linenumber") == 3, F.lit("-999999"))
                 .otherwise(text(F.col("l_quantity"))).alias("stage_ft"),
                 F.when(F.col("l_linenumber") == 4, F.lit("n/a"))
                 .otherwise(text(F.col("l_extendedprice"))).alias("discharge_cfs"),
                 F.lit(None).cast("string").alias("pool_elevation_ft")),
        F.struct(text(F.col("l_suppkey")).alias("site_id"), F.lit(None).cast("string").alias("stage_ft"),
                 F.lit(None).cast("string").alias("discharge_cfs"),
                 text(F.col("l_extendedprice")).alias("pool_elevation_ft")))
    quantity = F.col("l_quantity")
    document = F.struct(
        (F.unix_timestamp("l_shipdate") + F.col("l_linenumber")).alias("as_of_epoch"),
        F.struct(quantity.alias("score"),
                 F.create_map(F.lit("stage"), F.col("l_discount") * 100).alias("components")
                 ).alias("index"),
        F.struct((F.col("l_tax") * 1000).alias("temp_f"), quantity.alias("wind_mph"),
                 F.when(F.col("l_returnflag") == "R", "down").alias("error")).alias("weather"),
        F.struct(F.col("l_discount").alias("soil_moisture_top"),
                 F.lit(True).alias("saturated")).alias("soil"),
        gauge.alias("gauges"),
        F.array(F.struct(
            F.col("l_linestatus").alias("short"),
            F.struct(quantity.alias("score")).alias("fire_weather"),
            F.struct((quantity * 2).alias("us_aqi")).alias("air_quality"),
            F.array(F.struct(F.col("l_returnflag").alias("name"),
                             F.struct(quantity.alias("score")).alias("landslide"))
                    ).alias("districts_data"))).alias("forests"))
    return li.select(F.to_json(document).alias("value"))


@query("snapshot_flatten", SNAP_SQL + """
SELECT make_timestamp(sec * 1000000) AS ts, 'snapshot' AS source, entity_type, entity_id, metric, round(value, 6) AS value
FROM cells""")
def snapshot_flatten(spark, sf_dir):
    return rounded(snapshots.flatten(snapshots.parse(documents_of(spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")))))


@query("json_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing
FROM events""")
def json_props(spark, sf_dir):
    from hydrospark.functions.base import number

    return table(spark, sf_dir, "events").select(
        "event_id", number(F.get_json_object("props", "$.k")).alias("k"),
        number(F.get_json_object("props", "$.missing")).alias("missing"))
