"""Flood-index and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions import index as rules
from hydrospark.operators import flood_index as ops, replay
from hydrospark.registry import query
from hydrospark.registry.tables import (
    T_SQL, half_even_sql as he, miles_sql, rounded, table, tracks,
)

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def parts_sql(stage, qpf, storm, rate, alert, soil, past) -> str:
    """Rounded components as SQL columns."""
    return ", ".join([
        he(f"least(35, greatest(0, coalesce({stage}, 0) / 18.0::DOUBLE * 35))", 1) + " AS index_stage",
        he(f"least(20, coalesce({qpf}, 0) / 5 * 20)", 1) + " AS index_qpf",
        he(f"coalesce(least(20, greatest(0, 20 * (1500 - {storm}) / 1300)), 0)", 1) + " AS index_storm",
        he(f"least(10, greatest(0, coalesce({rate}, 0) * 10))", 1) + " AS index_rise",
        he(f"CASE WHEN {alert} THEN 10 ELSE 0 END", 1) + " AS index_alert",
        he(f"greatest(coalesce(least(5, greatest(0, ({soil} - 0.15::DOUBLE) / 0.3::DOUBLE * 5)), 0),"
           f" least(5, coalesce({past}, 0) / 4 * 5))", 1) + " AS index_soil",
    ])


SUM = "(index_stage + index_qpf + index_storm + index_rise + index_alert + index_soil)"
TOTAL = "CAST(" + he(
    f"least(100, {SUM} * CASE WHEN saturated THEN 1.25::DOUBLE WHEN soil >= 0.3::DOUBLE THEN 1.1::DOUBLE ELSE 1 END)", 0) + " AS INTEGER)"
LABEL = ("CASE WHEN score >= 80 THEN 'EMERGENCY' WHEN score >= 60 THEN 'WARNING' WHEN score >= 40 THEN 'ALERT'"
         " WHEN score >= 20 THEN 'ELEVATED' ELSE 'CALM' END")
PARTS = ", ".join(f"index_{n}" for n in rules.COMPONENTS)

INPUT_SQL = """i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber <> 7 THEN l_quantity / 2 END AS stage_ft, l_discount * 50 AS qpf_in,
    CASE WHEN l_linestatus = 'F' THEN ((l_partkey * 37) % 3000)::DOUBLE END AS storm_mi, l_tax * 10 - 0.2::DOUBLE AS rate_ft_per_hr,
    l_returnflag = 'R' AS alert, CASE WHEN l_linenumber <> 5 THEN (l_suppkey % 60) / 100 END AS soil,
    coalesce(CASE WHEN l_linenumber <> 5 THEN (l_suppkey % 60) / 100 END >= 0.4::DOUBLE, false) AS saturated, l_quantity / 10 AS past_7d_in
  FROM lineitem)"""


def inputs(spark, sf_dir):
    soil = F.when(F.col("l_linenumber") != 5, (F.col("l_suppkey") % 60) / 100)
    return table(spark, sf_dir, "lineitem").select(
        *ID, F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 2).alias("stage_ft"),
        (F.col("l_discount") * 50).alias("qpf_in"),
        F.when(F.col("l_linestatus") == "F", ((F.col("l_partkey") * 37) % 3000).cast("double")).alias("storm_mi"),
        (F.col("l_tax") * 10 - 0.2).alias("rate_ft_per_hr"), (F.col("l_returnflag") == "R").alias("alert"),
        soil.alias("soil"), F.coalesce(soil >= 0.4, F.lit(False)).alias("saturated"),
        (F.col("l_quantity") / 10).alias("past_7d_in"))


@query("flood_index", f"""WITH {INPUT_SQL},
c AS (SELECT *, {parts_sql('stage_ft', 'qpf_in', 'storm_mi', 'rate_ft_per_hr', 'alert', 'soil', 'past_7d_in')} FROM i),
s AS (SELECT *, {TOTAL} AS score FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {PARTS}, score, {LABEL} AS label,
  coalesce(stage_ft >= 6.5, false) AS stage_above_action, coalesce(stage_ft >= 9.5, false) AS stage_above_minor,
  qpf_in >= 1 AS qpf_over_1in, qpf_in >= 3 AS qpf_over_3in, coalesce(storm_mi < 1000, false) AS storm_within_1000mi,
  coalesce(storm_mi < 500, false) AS storm_within_500mi, rate_ft_per_hr >= 0.3::DOUBLE AS river_rising_fast,
  alert AS nws_flood_or_tropical, saturated AS soil_saturated, past_7d_in >= 3 AS wet_week
FROM s""")
def flood_index(spark, sf_dir):
    return ops.score(inputs(spark, sf_dir)).select(
        *ID, *[f"index_{n}" for n in rules.COMPONENTS], "score", "label", *rules.TRIGGERS)


@query("triggers_fired_first", f"""WITH {INPUT_SQL},
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [coalesce(stage_ft >= 6.5, false), coalesce(stage_ft >= 9.5, false), qpf_in >= 1, qpf_in >= 3,
   coalesce(storm_mi < 1000, false), coalesce(storm_mi < 500, false), rate_ft_per_hr >= 0.3::DOUBLE, alert, saturated, past_7d_in >= 3] AS t,
   {rules.TRIGGERS!r} AS k FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(len(list_filter(t, lambda x: x)) AS INTEGER) AS fired,
  array_to_string(list_concat(list_filter(k, lambda x, i: t[i]), list_filter(k, lambda x, i: NOT t[i])), ',') AS triggers
FROM f""")
def triggers_fired_first(spark, sf_dir):
    out = ops.score(inputs(spark, sf_dir))
    return out.select(*ID, ops.fired_count().alias("fired"),
                      F.array_join(ops.fired_first(), ",").alias("triggers"))


@query("situation_facts", f"""WITH {INPUT_SQL},
c AS (SELECT *, {parts_sql('stage_ft', 'qpf_in', 'storm_mi', 'rate_ft_per_hr', 'alert', 'soil', 'past_7d_in')} FROM i),
s AS (SELECT *, {TOTAL} AS score, least(100, coalesce(soil, 0) / 0.45::DOUBLE * 100) AS sat FROM c),
f AS (SELECT *, list_filter([CASE WHEN stage_ft IS NOT NULL THEN 'stage' END, CASE WHEN abs(rate_ft_per_hr) >= 0.05::DOUBLE THEN 'rate' END,
    CASE WHEN qpf_in >= 0.5 THEN 'rain_72h' END, CASE WHEN storm_mi < 1000 THEN 'storm' END, CASE WHEN sat >= 80 THEN 'soil' END,
    CASE WHEN stage_ft > 5 THEN 'forecast' END, CASE WHEN past_7d_in / 10 >= 0.25 THEN 'probability' END,
    CASE WHEN alert THEN 'alert' END], lambda x: x IS NOT NULL) AS facts FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE {LABEL} WHEN 'CALM' THEN 'calm' WHEN 'ELEVATED' THEN 'watch' WHEN 'ALERT' THEN 'alert'
    WHEN 'WARNING' THEN 'warning' ELSE 'emergency' END AS level, array_to_string(facts[1:4], ',') AS key_facts
FROM f""")
def situation_facts(spark, sf_dir):
    scored = ops.score(inputs(spark, sf_dir)).withColumns({
        "saturation_pct": F.least(F.lit(100.0), F.coalesce("soil", F.lit(0.0)) / 0.45 * 100.0),
        "predicted_ft": F.when(F.col("stage_ft") > 5, F.col("stage_ft") + 1),
        "flood_probability": F.col("past_7d_in") / 10})
    return ops.situation(scored).select(
        *ID, "level", F.array_join("key_facts.fact", ",").alias("key_facts"))


# ---- replay: each event type is a site, with the next type as its weather --------------------

TYPES = ["click", "error", "purchase", "signup", "view"]
NEXT = dict(zip(TYPES, TYPES[1:] + TYPES[:1]))
SITE_LAT = {t: 34.5 + i * 0.5 for i, t in enumerate(TYPES)}


def replay_inputs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    history = e.select(
        "ts", F.lit("snapshot").alias("source"), F.lit("gauge").alias("entity_type"),
        F.col("event_type").alias("entity_id"),
        F.explode(F.array(
            F.struct(F.lit(replay.STAGE).alias("metric"), (F.col("value") / 50).alias("value")),
            F.struct(F.lit(replay.PRECIP).alias("metric"), (F.col("value") / 700).alias("value")),
            F.struct(F.lit(replay.SOIL).alias("metric"), (F.col("value") / 1000).alias("value")))
        ).alias("c")).select("ts", "source", "entity_type", "entity_id", "c.*")
    sites = spark.createDataFrame(
        [(t, NEXT[t], SITE_LAT[t], dims.HOME_LON) for t in TYPES],
        "site_id string, weather_entity string, lat double, lon double")
    return history.dropna(), sites


REPLAY_SQL = f"""{T_SQL},
hist AS (SELECT event_type AS id, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY 1, 2),
sites(site_id, wx, slat) AS (VALUES {", ".join(f"('{t}', '{NEXT[t]}', {SITE_LAT[t]}::DOUBLE)" for t in TYPES)}),
sp AS (SELECT site_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
       FROM sites JOIN hist ON id = site_id GROUP BY 1
       UNION SELECT site_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE)
       FROM sites JOIN hist ON id = wx GROUP BY 1),
d AS (SELECT sp.site_id, sp.day, a.v / 50 AS stage_ft, coalesce(b.v / 700, 0) AS rain, b.v / 1000 AS soil
      FROM sp JOIN sites USING (site_id) LEFT JOIN hist a ON a.id = sp.site_id AND a.day = sp.day
      LEFT JOIN hist b ON b.id = wx AND b.day = sp.day),
fr AS (SELECT *, sum(rain) OVER (PARTITION BY site_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS qpf_in,
         sum(rain) OVER (PARTITION BY site_id ORDER BY day ROWS 6 PRECEDING) AS past_7d_in,
         (stage_ft - lag(stage_ft) OVER (PARTITION BY site_id ORDER BY day)) / 24 AS rate FROM d),
st AS (SELECT site_id, CAST(datetime AS DATE) AS day, arg_min(name, (round(mi, 9), epoch_us(datetime))) AS storm_name, min(round(mi, 9)) AS storm_mi
       FROM (SELECT *, {miles_sql('slat', str(dims.HOME_LON), 'lat', 'lon')} AS mi FROM sites, t) GROUP BY 1, 2),
i AS (SELECT fr.*, storm_mi, storm_name, coalesce(soil >= 0.4::DOUBLE, false) AS saturated FROM fr LEFT JOIN st USING (site_id, day)),
c AS (SELECT *, {parts_sql('stage_ft', 'qpf_in', 'storm_mi', 'rate', 'false', 'soil', 'past_7d_in')} FROM i),
s AS (SELECT *, {TOTAL} AS score FROM c),
rp AS (SELECT *, {LABEL} AS label FROM s)"""


def scored_days(spark, sf_dir):
    history, sites = replay_inputs(spark, sf_dir)
    return replay.days(history, tracks(spark, sf_dir), sites)


@query("index_replay", f"""WITH {REPLAY_SQL}
SELECT site_id, day, score, label, {PARTS}, round(stage_ft + 1e-9, 6) AS stage_ft, round(qpf_in + 1e-9, 6) AS qpf_in,
  round(past_7d_in + 1e-9, 6) AS past_7d_in, round(soil + 1e-9, 6) AS soil, round(storm_mi + 1e-9, 6) AS storm_mi, storm_name FROM rp""")
def index_replay(spark, sf_dir):
    return rounded(scored_days(spark, sf_dir).select(
        "site_id", "day", "score", "label", *[f"index_{n}" for n in rules.COMPONENTS], "stage_ft",
        "qpf_in", "past_7d_in", "soil", "storm_mi", "storm_name"), nudge=1e-9)


@query("replay_validation", f"""WITH {REPLAY_SQL},
ev AS (SELECT site_id, DATE '2024-01-24' AS event_day FROM sites),
br AS (SELECT site_id, min(day) AS first_day, max(day) AS last_day, count(*) AS total_days, count(*) FILTER (score >= 40) AS alert_days,
         count(*) FILTER (score >= 40 AND storm_name IS NOT NULL) AS with_named_storm, count(*) FILTER (label = 'EMERGENCY') AS emergency,
         count(*) FILTER (label = 'WARNING') AS warning, count(*) FILTER (label = 'ALERT') AS alert, count(*) FILTER (label = 'ELEVATED') AS elevated,
         count(*) FILTER (label = 'CALM') AS calm, {he('count(*) FILTER (score >= 40) / count(*) * 100', 2)} AS alert_pct FROM rp GROUP BY 1),
brk AS (SELECT ev.site_id, max(x.day) AS last_break FROM ev JOIN (
          SELECT g.site_id, g.day, score FROM (SELECT site_id, CAST(unnest(generate_series(DATE '2023-12-01', DATE '2024-01-23', INTERVAL 1 DAY)) AS DATE) AS day FROM sites) g
          LEFT JOIN rp ON rp.site_id = g.site_id AND rp.day = g.day) x ON x.site_id = ev.site_id
        WHERE coalesce(x.score, -1) < 40 GROUP BY 1),
pk AS (SELECT rp.* FROM rp WHERE day BETWEEN DATE '2024-01-22' AND DATE '2024-01-26'
       QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY score DESC, day) = 1)
SELECT ev.site_id, ev.event_day, CAST(date_diff('day', last_break, DATE '2024-01-23') AS INTEGER) AS lead_days, pk.day AS peak_day, pk.score AS peak_score,
  pk.label AS peak_label, pk.stage_ft AS peak_stage_ft, {", ".join(f"pk.index_{n}" for n in rules.COMPONENTS)},
  br.* EXCLUDE (site_id)
FROM ev JOIN br USING (site_id) JOIN brk USING (site_id) JOIN pk USING (site_id)""")
def replay_validation(spark, sf_dir):
    scored = replay.stored(scored_days(spark, sf_dir))
    events = spark.createDataFrame([(t,) for t in TYPES], "site_id string").withColumn(
        "event_day", F.lit("2024-01-24").cast("date"))
    return replay.validate(scored, events)


@query("replay_elevated_days", f"""WITH {REPLAY_SQL}
SELECT site_id, day, score, label, storm_name, stage_ft FROM rp WHERE score >= 40""")
def replay_elevated_days(spark, sf_dir):
    return replay.elevated_days(scored_days(spark, sf_dir))
