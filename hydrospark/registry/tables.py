"""The test tables seen as sensor history, tracks and places, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return _cast_times(spark.read.parquet(f"{sf_dir}/{name}.parquet"), "timestamp_ntz", "timestamp")


def _cast_times(df: DataFrame, old: str, new: str) -> DataFrame:
    found = [f.name for f in df.schema.fields if f.dataType.simpleString() == old]
    return df.withColumns({c: F.col(c).cast(new) for c in found}) if found else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all tasks by a hash of narrow columns. A table of one small file is otherwise read by one or two
    tasks, which then do all the costly work on its rows.

    The rows pass a generator, since Spark moves filters, and all the parsing that they need, ahead of the exchange, but
    not ahead of what makes their columns.
    """
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
    return dealt.select(F.inline(F.array(F.struct(*df.columns))))


def plain_times(df: DataFrame) -> DataFrame:
    """Time stamps without a zone, as the parquet tables hold them."""
    return _cast_times(df, "timestamp", "timestamp_ntz")


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles cut to `digits`; `nudge` moves exact halves off the edge, as `round_sql` does."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return plain_times(df.withColumns(
        {c: F.round(F.col(c) + nudge, digits) + F.lit(0.0) for c in doubles}))


def round_sql(expr: str, digits: int = 6, nudge: str = "1e-9") -> str:
    return f"round({expr} + {nudge}, {digits})"


# ---- history: one row per event --------------------------------------------------------------

def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = (F.when(F.col("event_id") % 3 == 0, "usgs_iv")
              .when(F.col("event_id") % 3 == 1, "snapshot").otherwise("usgs_dv"))
    return table(spark, sf_dir, "events").select(
        "ts", source.alias("source"), F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("metric"),
        "value", F.col("event_id").alias("seq"))


H_SQL = """h AS (
  SELECT ts, CASE event_id % 3 WHEN 0 THEN 'usgs_iv' WHEN 1 THEN 'snapshot' ELSE 'usgs_dv' END AS source,
         'user' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, event_type AS metric, value,
         event_id AS seq
  FROM events)"""


# ---- gauges: one stage series per event type -------------------------------------------------

GAUGE_KEY = ["entity_id"]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("entity_id"), "ts", "value", F.col("event_id").alias("seq"))


R_SQL = "r AS (SELECT event_type AS entity_id, ts, value, event_id AS seq FROM events)"


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly last value per gauge, gaps filled."""
    from hydrospark.operators.timeseries import regular

    return regular(readings(spark, sf_dir), prefer=None, keys=GAUGE_KEY, tie="seq")


G_SQL = R_SQL + """,
g_seen AS (
  SELECT entity_id, date_trunc('hour', ts) AS ts, arg_max(value, (epoch_us(ts), seq)) AS value
  FROM r GROUP BY 1, 2),
g_spine AS (
  SELECT entity_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM g_seen GROUP BY entity_id),
g AS (
  SELECT s.entity_id, s.ts,
         last_value(v.value IGNORE NULLS) OVER (PARTITION BY s.entity_id ORDER BY s.ts) AS value
  FROM g_spine s LEFT JOIN g_seen v USING (entity_id, ts))"""


# ---- tracks: one storm per user --------------------------------------------------------------

def _grid_lat(key: Column) -> Column:
    return F.lit(33.5) + (key % 41) * F.lit(0.1)


def _grid_lon(key: Column) -> Column:
    return F.lit(-84.5) + (key % 46) * F.lit(0.1)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("storm_id"),
        F.concat(F.lit("STORM"), F.col("user_id").cast("string")).alias("name"),
        F.col("ts").alias("datetime"), F.year("ts").alias("year"), F.col("event_type").alias("status"),
        _grid_lat(F.col("event_id")).alias("lat"), _grid_lon(F.col("event_id")).alias("lon"),
        F.when(F.col("value") >= 5, F.floor("value").cast("int")).alias("wind_kt"),
        (F.lit(900) + F.col("event_id") % 120).cast("int").alias("pres_mb"))


T_SQL = """t AS (
  SELECT CAST(user_id AS VARCHAR) AS storm_id, 'STORM' || CAST(user_id AS VARCHAR) AS name,
         ts AS datetime, CAST(year(ts) AS INTEGER) AS year, event_type AS status,
         33.5::DOUBLE + (event_id % 41) * 0.1::DOUBLE AS lat, -84.5::DOUBLE + (event_id % 46) * 0.1::DOUBLE AS lon,
         CASE WHEN value >= 5 THEN CAST(floor(value) AS INTEGER) END AS wind_kt,
         CAST(900 + event_id % 120 AS INTEGER) AS pres_mb
  FROM events)"""


# ---- places: customers and suppliers ---------------------------------------------------------

def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey",
                    _grid_lat(F.col("c_custkey")).alias("lat"),
                    _grid_lon(F.col("c_custkey")).alias("lon"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", _grid_lat(F.col("s_suppkey") * 7).alias("site_lat"),
                    _grid_lon(F.col("s_suppkey") * 11).alias("site_lon"))


P_SQL = """c AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, 33.5::DOUBLE + (c_custkey % 41) * 0.1::DOUBLE AS lat,
         -84.5::DOUBLE + (c_custkey % 46) * 0.1::DOUBLE AS lon FROM customer),
s AS (
  SELECT s_suppkey, 33.5::DOUBLE + ((s_suppkey * 7) % 41) * 0.1::DOUBLE AS site_lat,
         -84.5::DOUBLE + ((s_suppkey * 11) % 46) * 0.1::DOUBLE AS site_lon FROM supplier)"""


def miles_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))")


def values_sql(name: str, columns: str, rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def half_even_sql(expr: str, digits: int) -> str:
    """Rounding on the exact binary value, as `functions.base.half_even` does."""
    return f"(printf('%.{digits}f', ({expr})::DOUBLE)::DOUBLE + 0.0::DOUBLE)"
