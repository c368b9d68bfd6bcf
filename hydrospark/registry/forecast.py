"""Training frames, folds, metrics and gates."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from hydrospark.functions import hazard, stage as stage_rules
from hydrospark.operators import card, evaluation as ev, features
from hydrospark.registry import query
from hydrospark.session import run_dir
from hydrospark.registry.tables import (
    G_SQL, GAUGE_KEY, R_SQL, plain_times, readings, rounded, stage, table,
)

TYPES = ["click", "error", "purchase", "signup", "view"]
EDGES = [("view", "click", "a"), ("view", "error", "b"), ("purchase", "click", "a"),
         ("purchase", "signup", "b"), ("click", "error", "a")]
#: The full configuration; chunks are short so that the test tables cross many cuts.
CFG = features.FrameConfig(upstream=["a", "b"], thresholds=(100.0,), chunk_rows=400, dense=True)


def frame_inputs(spark, sf_dir, hourly=None):
    """Every event type is a gauge and, scaled, the rain and soil record of the next type."""
    g = stage(spark, sf_dir) if hourly is None else hourly
    series = g.select("entity_id", "ts", F.explode(F.array(
        F.struct(F.lit("stage").alias("metric"), F.col("value")),
        F.struct(F.lit("precip").alias("metric"), (F.col("value") / 100).alias("value")),
        F.struct(F.lit("soil_top").alias("metric"), (F.col("value") / 1000).alias("value")),
        F.struct(F.lit("soil_deep").alias("metric"), (F.col("value") / 2000).alias("value")))
    ).alias("c")).select(F.lit("gauge").alias("entity_type"), "entity_id", "ts", "c.*")
    targets = spark.createDataFrame(list(zip(TYPES, TYPES[1:] + TYPES[:1])),
                                    "target_id string, weather_entity string")
    edges = spark.createDataFrame(EDGES, "target_id string, upstream_id string, slot string")
    return series, targets, edges


def frame(spark, sf_dir, cfg=CFG):
    return features.training_frame(*frame_inputs(spark, sf_dir), cfg)


def _w(n):
    return f"ROWS {n - 1} PRECEDING"


def _frame_sql(source: str = "g") -> str:
    r = lambda x: f"round({x} + 1e-9, 6)"
    w = "OVER (PARTITION BY entity_id ORDER BY ts {})"
    rolls = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}
    cols = [f"lag(value, {k}) {w.format('')} AS lag{k}" for k in CFG.lags]
    cols += [f"value - lag(value, {k}) {w.format('')} AS delta{k}" for k in CFG.lags]
    cols += [f"{fn}(value) {w.format(_w(n))} AS roll{n}_{a}" for n in CFG.rolls for a, fn in rolls.items()]
    cols += [f"sum(value / 100) {w.format(_w(n))} AS psum{n}" for n in CFG.precip_rolls]
    feats = f"ft AS (SELECT *, row_number() {w.format('')} AS i, {', '.join(cols)} FROM {source})"
    api = ("api AS (SELECT a.entity_id, a.ts, sum(pow(0.99, a.i - b.i) * b.value / 100) AS api FROM ft a JOIN ft b"
           f" ON a.entity_id = b.entity_id AND b.i BETWEEN a.i - {CFG.api_window - 1} AND a.i GROUP BY 1, 2)")
    tg = "tg(target_id, wx) AS (VALUES " + ", ".join(
        f"('{a}', '{b}')" for a, b in zip(TYPES, TYPES[1:] + TYPES[:1])) + ")"
    ed = "ed(target_id, up, slot) AS (VALUES " + ", ".join(str(e) for e in EDGES) + ")"
    spine = ("hrs AS (SELECT target_id, ts FROM tg JOIN ft ON entity_id = target_id UNION SELECT target_id, ts FROM ed JOIN ft ON entity_id = up"
             " UNION SELECT target_id, ts FROM tg JOIN ft ON entity_id = wx)")
    out = ["h.target_id", "h.ts", "s.value AS self__stage_ft"]
    out += [f"s.lag{k} AS self__stage_ft__lag{k}" for k in CFG.lags]
    out += [f"{r(f's.roll{n}_{a}')} AS self__stage_ft__roll{n}_{a}" for n in CFG.rolls for a in rolls]
    out += [f"{r(f's.delta{k}')} AS self__stage_ft__delta{k}" for k in CFG.lags]
    for u in ("a", "b"):
        out += [f"{u}.lag{k} AS up_{u}__stage_ft__lag{k}" for k in CFG.lags]
        out += [f"{r(f'{u}.roll{n}_{a}')} AS up_{u}__stage_ft__roll{n}_{a}" for n in CFG.upstream_rolls for a in rolls]
    for n in CFG.precip_rolls:
        out += [f"{r(f'x.psum{n}')} AS precip__roll{n}_sum", f"{r(f'x.roll{n}_max / 100')} AS precip__roll{n}_max"]
    out += [f"{r('api.api')} AS precip__api{CFG.api_window}_d99", f"{r('x.value / 1000')} AS soil_top",
            f"{r('x.value / 2000')} AS soil_deep"]
    for n in CFG.soil_rolls:
        out += [f"{r(f'x.roll{n}_{a} / 1000')} AS soil_top__roll{n}_{a}" for a in ("mean", "max")]
    tw = "OVER (PARTITION BY h.target_id ORDER BY h.ts {})"
    lab = []
    for n in CFG.horizons:
        peak = (f"CASE WHEN lead(1, {n - 1}) {tw.format('')} IS NOT NULL THEN max(s.value) "
                + tw.format(f"ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING") + " END")
        lab += [f"{peak} AS y_future_max_{n}h", f"{r(f'{peak} - s.value')} AS y_future_rise_{n}h",
                f"lead(s.value, {n}) {tw.format('')} AS y_future_val_{n}h",
                f'CAST({peak} >= 100 AS INTEGER) AS "y_peak_above_100.0_{n}h"']
    return f"""{feats}, {api}, {tg}, {ed}, {spine},
fr AS (SELECT {', '.join(out + lab)}
FROM hrs h JOIN tg ON tg.target_id = h.target_id LEFT JOIN ft s ON s.entity_id = h.target_id AND s.ts = h.ts
LEFT JOIN ed ea ON ea.target_id = h.target_id AND ea.slot = 'a' LEFT JOIN ft a ON a.entity_id = ea.up AND a.ts = h.ts
LEFT JOIN ed eb ON eb.target_id = h.target_id AND eb.slot = 'b' LEFT JOIN ft b ON b.entity_id = eb.up AND b.ts = h.ts
LEFT JOIN ft x ON x.entity_id = tg.wx AND x.ts = h.ts LEFT JOIN api ON api.entity_id = tg.wx AND api.ts = h.ts)"""


@query("training_frame", f"WITH {G_SQL}, {_frame_sql()} SELECT * FROM fr")
def training_frame(spark, sf_dir):
    return rounded(frame(spark, sf_dir), nudge=1e-9)


@query("gapped_training_frame", f"""WITH {R_SQL},
q AS (SELECT entity_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM r GROUP BY 1, 2), {_frame_sql("q")} SELECT * FROM fr""")
def gapped_training_frame(spark, sf_dir):
    """Hours without a reading are missing and not filled, so that series have holes."""
    from hydrospark.operators import timeseries as ts

    hourly = ts.bucket_max(readings(spark, sf_dir), keys=GAUGE_KEY)
    cfg = dataclasses.replace(CFG, dense=False)
    return rounded(features.training_frame(*frame_inputs(spark, sf_dir, hourly), cfg), nudge=1e-9)


# ---- folds and metrics: the stage six hours ago as a forecast of the present -----------------

FOLD_SQL = f"""{G_SQL},
pr AS (SELECT entity_id AS target_id, ts, value AS actual, lag(value, 6) OVER w AS pred, lag(value, 1) OVER w AS current
       FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
nn AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ts) - 1 AS position, count(*) OVER (PARTITION BY target_id) AS n FROM pr),
ws AS (SELECT *, greatest(10, n // 5) AS warm_up, greatest(1, (n - greatest(10, n // 5)) // 5) AS fold_size FROM nn),
fo AS (SELECT *, CASE WHEN n > warm_up + 5 AND position >= warm_up THEN CAST(least((position - warm_up) // fold_size, 4) AS INTEGER) END AS fold FROM ws)"""


def forecasts(spark, sf_dir):
    from hydrospark.operators import timeseries as ts

    lagged = ts.lags(stage(spark, sf_dir), [1, 6], keys=GAUGE_KEY, chunk_rows=240, dense=True)
    out = lagged.withColumnsRenamed({"x__lag6": "pred", "x__lag1": "current"})
    return ev.fold_ids(out.withColumnsRenamed({"entity_id": "target_id", "value": "actual"}),
                       span_s=5 * 86400)


@query("fold_ids", f"""WITH {FOLD_SQL}
SELECT target_id, ts, actual, pred, current, position, n, warm_up, fold_size, fold, warm_up + fold * fold_size AS train_end FROM fo""")
def fold_ids(spark, sf_dir):
    return plain_times(forecasts(spark, sf_dir))


@query("regression_metrics", f"""WITH {FOLD_SQL}
SELECT target_id, fold, count(pred) AS n, round(avg(abs(actual - pred)), 6) AS mae, round(sqrt(avg(pow(actual - pred, 2))), 6) AS rmse,
  round(1 - sum(pow(actual - pred, 2)) / (var_pop(actual) FILTER (pred IS NOT NULL) * count(pred)), 6) AS r2
FROM fo WHERE fold IS NOT NULL GROUP BY 1, 2""")
def regression_metrics(spark, sf_dir):
    rows = forecasts(spark, sf_dir).filter(F.col("fold").isNotNull())
    return rounded(ev.regression_metrics(rows, ["target_id", "fold"]))


@query("rising_regime", f"""WITH {FOLD_SQL},
m AS (SELECT target_id, avg(mae) AS overall_mae, avg(naive) AS baseline_mae, count(*) AS n_folds FROM (
        SELECT target_id, fold, avg(abs(actual - pred)) AS mae, avg(abs(actual - current)) AS naive FROM fo WHERE fold IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT target_id, count(*) AS n_total, count(*) FILTER (actual - current >= 0.5) AS n_rising,
        CASE WHEN count(*) >= 100 AND count(*) FILTER (actual - current >= 0.5) >= 10 THEN avg(abs(actual - pred)) FILTER (actual - current >= 0.5) END AS event_mae,
        CASE WHEN count(*) >= 100 AND count(*) FILTER (actual - current >= 0.5) >= 10 THEN avg(abs(actual - current)) FILTER (actual - current >= 0.5) END AS event_baseline_mae
      FROM fo WHERE fold IS NOT NULL GROUP BY 1)
SELECT target_id, round(overall_mae, 6) AS overall_mae, n_folds, round(baseline_mae, 6) AS baseline_mae, n_folds AS baseline_folds, 'persistence' AS baseline_kind,
  n_total, n_rising, round(event_mae, 6) AS event_mae, round(event_baseline_mae, 6) AS event_baseline_mae,
  overall_mae < baseline_mae AS beats_baseline_overall, coalesce(event_mae < event_baseline_mae, overall_mae < baseline_mae) AS beats_baseline
FROM m JOIN e USING (target_id)""")
def rising_regime(spark, sf_dir):
    """The regression gate: fold means, the naive rule on the same folds, and the rising rows."""
    rows = forecasts(spark, sf_dir).filter(F.col("fold").isNotNull())
    by = ["target_id"]
    overall = ev.fold_mean(ev.regression_metrics(rows, ["target_id", "fold"]), by, "mae")
    naive = ev.naive_regression(rows, by, current="current")
    event = ev.rising_regime(rows, by, current="current")
    return rounded(ev.regression_gate(overall.join(naive, by).join(event, by)))


@query("naive_classifier", f"""WITH {FOLD_SQL},
y AS (SELECT target_id, fold, actual >= 100 AS y, coalesce(current >= 100, false) AS yes FROM fo WHERE fold IS NOT NULL),
a AS (SELECT target_id, fold, CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN
        (count(*) FILTER (y AND yes) / count(*) FILTER (y) + count(*) FILTER (NOT y AND NOT yes) / count(*) FILTER (NOT y)) / 2 END AS auc FROM y GROUP BY 1, 2)
SELECT target_id, round(avg(auc), 6) AS baseline_auc, count(auc) AS baseline_folds, 'persistence' AS baseline_kind FROM a GROUP BY 1""")
def naive_classifier(spark, sf_dir):
    rows = forecasts(spark, sf_dir).withColumn("actual", (F.col("actual") >= 100).cast("int"))
    return rounded(ev.naive_classification(rows, ["target_id"], 100.0))


# ---- ranking: document length as a score for the quality label -------------------------------

RANK_SQL = """d AS (SELECT lang, quality, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
b AS (SELECT lang, score, sum(quality) AS pos, count(*) AS n FROM d GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER u - sum(pos) OVER u - (n - pos) AS neg_below, sum(pos) OVER v AS top_pos, sum(n) OVER v AS top_n,
        sum(pos) OVER (PARTITION BY lang) AS p, sum(n) OVER (PARTITION BY lang) AS tot
      FROM b WINDOW u AS (PARTITION BY lang ORDER BY score), v AS (PARTITION BY lang ORDER BY score DESC))"""


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "lang", F.col("quality").alias("actual"), F.col("n_chars").cast("double").alias("pred"))


@query("roc_auc", f"""WITH {RANK_SQL}
SELECT lang, CAST(max(tot) AS BIGINT) AS n, round(sum(pos * (neg_below + (n - pos) / 2)) / (max(p) * (max(tot) - max(p))), 6) AS auc,
  round(max(p) / max(tot), 6) AS positive_rate FROM c GROUP BY 1""")
def roc_auc(spark, sf_dir):
    return rounded(ev.ranking_metrics(labelled(spark, sf_dir), ["lang"], chunks=8).drop("ap"))


@query("average_precision", f"""WITH {RANK_SQL}
SELECT lang, CASE WHEN max(p) > 0 AND max(p) < max(tot) THEN round(sum(pos * top_pos / top_n) / max(p), 6) END AS ap FROM c GROUP BY 1""")
def average_precision(spark, sf_dir):
    return rounded(ev.ranking_metrics(labelled(spark, sf_dir), ["lang"]).select("lang", "ap"))


@query("calibration_bins", """
WITH d AS (SELECT lang, quality, least(1.0::DOUBLE, n_chars / 8000) AS p FROM labels JOIN documents USING (doc_id))
SELECT lang, CAST(greatest(0, least(floor(p * 10), 9)) AS INTEGER) AS bin, round(avg(p), 6) AS mean_pred, round(avg(quality), 6) AS observed, count(*) AS n
FROM d GROUP BY 1, 2""")
def calibration_bins(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("pred", F.least(F.lit(1.0), F.col("pred") / 8000))
    return rounded(ev.calibration(rows, ["lang"]))


# ---- trust: one model record per order -------------------------------------------------------

@query("model_trust", """
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS kind,
  CAST([6, 24, 72][1 + o_custkey % 3] AS INTEGER) AS horizon_h, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus = 'O' END AS beats,
  CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 4 > 0 THEN o_totalprice / 1000000 END AS mae,
  CASE WHEN o_orderkey % 2 = 1 THEN CASE o_custkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN NULL ELSE 0.8 END END::DOUBLE AS auc,
  o_custkey % 4 AS e1, (o_custkey // 4) % 4 AS e2 FROM orders),
t AS (SELECT *, kind = 'classification' AS c, CAST(CASE WHEN kind = 'classification' THEN (e1 > 0)::INT + (e2 > 0)::INT END AS INTEGER) AS folds_with_events FROM k),
u AS (SELECT *, CASE WHEN c THEN coalesce(abs(auc - 0.5) > 1e-9, false) AND folds_with_events >= 2 AND coalesce(beats, true)
                ELSE coalesce(beats, mae IS NOT NULL) END AS trustworthy FROM t)
SELECT CAST(o_orderkey AS VARCHAR) AS target_id, kind, horizon_h, mae, CASE WHEN abs(auc - 0.5) > 1e-9 THEN auc END AS auc, beats AS beats_baseline,
  CASE WHEN c THEN e1 + e2 END AS positive_events, folds_with_events, trustworthy, trustworthy AND coalesce(beats, true) AS published FROM u""")
def model_trust(spark, sf_dir):
    o, key, cust = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    is_class = key % 2 == 1
    auc = F.when(cust % 5 == 0, 0.5).when(cust % 5 > 1, 0.8)

    def fold(events, i):
        return F.struct(F.lit(1000).alias("n"), (events / 1000).alias("positive_rate"),
                        F.lit(i).alias("fold"))

    metrics = F.struct(
        F.array(fold(cust % 4, 0), fold(F.floor(cust / 4) % 4, 1)).alias("per_fold"),
        F.when(~is_class & (cust % 4 > 0), F.col("o_totalprice") / 1000000).alias("overall_mae"),
        F.when(is_class, auc).alias("overall_auc"), F.lit(2).alias("n_folds"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus") == "O").alias("beats_baseline"))
    document = F.struct(
        key.cast("string").alias("target_id"),
        F.when(is_class, "classification").otherwise("regression").alias("kind"),
        F.element_at(F.array(F.lit(6), F.lit(24), F.lit(72)), (cust % 3 + 1).cast("int")).alias("horizon_h"),
        metrics.alias("metrics"))
    sidecars = o.select(F.from_json(F.to_json(document), ev.SIDECAR).alias("d")).select("d.*")
    return ev.trust(sidecars).select(
        "target_id", "kind", "horizon_h", "mae", "auc", "beats_baseline", "positive_events",
        "folds_with_events", "trustworthy", "published")


@query("forecast_card", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(greatest(0, least(1, l_discount * 10)) * 100) AS INTEGER) AS pct,
  CASE WHEN floor(greatest(0, least(1, l_discount * 10)) * 100) >= 50 THEN 'high' WHEN floor(greatest(0, least(1, l_discount * 10)) * 100) >= 25 THEN 'med' ELSE 'low' END AS severity,
  round(greatest(0, l_tax * 10 - 0.3::DOUBLE) + l_quantity, 6) AS predicted_ft,
  CASE WHEN greatest(0, l_tax * 10 - 0.3::DOUBLE) + l_quantity - l_quantity > 0.05 THEN 'up' ELSE 'flat' END AS direction
FROM lineitem""")
def forecast_card(spark, sf_dir):
    level = stage_rules.level_from_rise(F.col("l_tax") * 10 - 0.3, "l_quantity")
    out = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_discount") * 10)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ev.percent("p").alias("pct"),
        hazard.probability_severity(ev.percent("p")).alias("severity"),
        F.round(level, 6).alias("predicted_ft"),
        hazard.direction(level - F.col("l_quantity")).alias("direction"))


# ---- the forecast card: forecasts, gauges, stages and model figures of every supplier ----------

CARD_SQL = """f AS (SELECT CAST(l_suppkey AS VARCHAR) AS target_id, l_linenumber AS ln, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sq, count(*) AS c FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN ln <= 3 THEN 'regression' ELSE 'classification' END AS kind, CAST([6, 24, 72, 6, 24, 72, 6][ln] AS INTEGER) AS horizon_h,
  CASE WHEN ln IN (4, 5) THEN 6.5 WHEN ln = 7 THEN 9.5 END::DOUBLE AS threshold FROM f),
fc AS (SELECT target_id, kind, horizon_h, threshold, CASE WHEN ln <= 3 THEN sq % 300 / 10 ELSE sq % 120 / 100 END::DOUBLE AS prediction FROM k WHERE sq % 13 > 0),
ga AS (SELECT CAST(s_suppkey AS VARCHAR) AS target_id, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 200 / 10 END::DOUBLE AS current_ft FROM supplier WHERE s_suppkey % 9 > 0),
st AS (SELECT CAST(s_suppkey AS VARCHAR) AS target_id, CAST(4 + s_suppkey % 3 AS DOUBLE) AS action, 6.5 + s_suppkey % 4::DOUBLE AS minor, 9.5 + s_suppkey % 4::DOUBLE AS moderate,
  CASE WHEN s_suppkey % 11 > 0 THEN 13 + s_suppkey % 4 END::DOUBLE AS major FROM supplier WHERE s_suppkey % 5 > 0),
re AS (SELECT target_id, kind, horizon_h, threshold, sq % 50 / 100 AS mae, sq % 70 / 100 AS event_mae, sq % 90 / 100 AS event_baseline_mae,
  CASE c % 3 WHEN 1 THEN true WHEN 2 THEN false END AS beats, sq % 3 = 0 AS beats_overall, sq % 101 / 101 AS auc, sq % 40 AS positive_events,
  CAST(sq % 6 AS INTEGER) AS folds_with_events, sq % 2 = 0 AS trustworthy FROM k WHERE c % 7 > 0),
j AS (SELECT fc.*, current_ft, action, minor, moderate, coalesce(major, 20) * 1.25 AS axis_max, major, re.* EXCLUDE (target_id, kind, horizon_h, threshold)
      FROM fc LEFT JOIN ga USING (target_id) LEFT JOIN st USING (target_id) LEFT JOIN re ON re.target_id = fc.target_id AND re.kind = fc.kind
        AND re.horizon_h = fc.horizon_h AND re.threshold IS NOT DISTINCT FROM fc.threshold),
p AS (SELECT *, kind = 'regression' AS r, prediction - current_ft AS d, CAST(floor(greatest(0, least(1, prediction)) * 100) AS INTEGER) AS whole FROM j),
cd AS (SELECT target_id, kind, CAST(row_number() OVER (PARTITION BY target_id, kind ORDER BY horizon_h, coalesce(threshold, 0)) AS INTEGER) AS place, horizon_h, threshold, current_ft,
  CASE WHEN r THEN prediction END AS predicted_ft, axis_max, CASE WHEN r THEN round(d, 6) END AS delta,
  CASE WHEN r THEN CASE WHEN d > 0.05 THEN 'up' WHEN d < -0.05 THEN 'down' ELSE 'flat' END END AS direction,
  CASE WHEN current_ft IS NOT NULL THEN round(greatest(0, least(100, current_ft / axis_max * 100)), 6) END AS now_pct,
  CASE WHEN r THEN round(greatest(0, least(100, prediction / axis_max * 100)), 6) END AS pred_pct, CASE WHEN r THEN coalesce(prediction >= minor, false) END AS above_minor,
  CASE WHEN r THEN mae END AS mae, CASE WHEN r THEN event_mae END AS event_mae, CASE WHEN r THEN event_baseline_mae END AS event_baseline_mae,
  CASE WHEN r THEN beats_overall END AS beats_overall, CASE WHEN NOT r THEN whole END AS pct,
  CASE WHEN NOT r THEN CASE WHEN whole >= 50 THEN 'high' WHEN whole >= 25 THEN 'med' ELSE 'low' END END AS severity,
  CASE WHEN NOT r THEN CASE WHEN abs(action - threshold) < 0.01 THEN 'action' WHEN abs(minor - threshold) < 0.01 THEN 'minor' WHEN abs(moderate - threshold) < 0.01 THEN 'moderate'
    WHEN abs(major - threshold) < 0.01 THEN 'major' ELSE '' END END AS threshold_label, CASE WHEN NOT r THEN round(auc, 6) END AS auc,
  CASE WHEN NOT r THEN positive_events END AS positive_events, CASE WHEN NOT r THEN folds_with_events END AS folds_with_events,
  CASE WHEN NOT r AND mae IS NOT NULL THEN 5 END AS n_folds, CASE WHEN NOT r THEN coalesce(trustworthy, false) END AS trustworthy FROM p)"""


def _card_tables(spark, sf_dir):
    quantity, ln = F.col("l_quantity").cast("long"), F.col("ln")
    k = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("target_id"), F.col("l_linenumber").alias("ln"))
         .agg(F.sum(quantity).alias("sq"), F.count("*").alias("c"))
         .withColumns({"kind": F.when(ln <= 3, "regression").otherwise("classification"),
                       "horizon_h": F.element_at(F.array(*[F.lit(h) for h in (6, 24, 72, 6, 24, 72, 6)]), ln.cast("int")),
                       "threshold": F.when(ln.isin(4, 5), 6.5).when(ln == 7, 9.5)}))
    sq, by = F.col("sq"), ["target_id", "kind", "horizon_h", "threshold"]
    forecasts = k.filter(sq % 13 > 0).select(*by, F.when(ln <= 3, sq % 300 / 10).otherwise(sq % 120 / 100).alias("prediction"))
    supplier, s = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    gauges = supplier.filter(s % 9 > 0).select(s.cast("string").alias("site_id"), F.when(s % 7 > 0, s % 200 / 10).alias("stage_ft"))
    stages = supplier.filter(s % 5 > 0).select(
        s.cast("string").alias("site_id"), (4 + s % 3).cast("double").alias("action"), (6.5 + s % 4).alias("minor"), (9.5 + s % 4).alias("moderate"),
        F.when(s % 11 > 0, 13 + s % 4).cast("double").alias("major"))
    c = F.col("c") % 3
    records = k.filter(F.col("c") % 7 > 0).select(
        *by, (sq % 50 / 100).alias("mae"), (sq % 70 / 100).alias("event_mae"), (sq % 90 / 100).alias("event_baseline_mae"),
        F.when(c > 0, c == 1).alias("beats_baseline"), (sq % 3 == 0).alias("beats_baseline_overall"), (sq % 101 / 101).alias("auc"),
        (sq % 40).alias("positive_events"), (sq % 6).cast("int").alias("folds_with_events"), F.lit(5).alias("n_folds"), (sq % 2 == 0).alias("trustworthy"))
    return forecasts, gauges, stages, records


@query("forecast_card_rows", f"WITH {CARD_SQL} SELECT * FROM cd")
def forecast_card_rows(spark, sf_dir):
    """Every forecast beside its gauge, stages and model figures; parts of each are missing."""
    return rounded(card.card(*_card_tables(spark, sf_dir)))


@query("forecast_card_sites", f"""WITH {CARD_SQL}
SELECT target_id, count(*) FILTER (kind = 'regression') AS n_levels, count(*) FILTER (kind = 'classification') AS n_chances,
  coalesce(bool_or(NOT trustworthy), false) AS any_untrustworthy,
  coalesce((SELECT list_sort(list(DISTINCT horizon_h)) FROM re WHERE re.target_id = cd.target_id AND kind = 'regression' AND beats = false), []) AS withheld
FROM cd GROUP BY target_id""")
def forecast_card_sites(spark, sf_dir):
    forecasts, gauges, stages, records = _card_tables(spark, sf_dir)
    return card.summary(card.card(forecasts, gauges, stages, records), records)


# ---- boosted trees: a model for each gauge, horizon and kind, at the full configuration -----------

def _specs():
    from hydrospark.operators.forecast import ModelSpec

    return [*[ModelSpec(h) for h in CFG.horizons], *[ModelSpec(h, "classification", t) for t in CFG.thresholds for h in CFG.horizons]]


def _learning_frame(spark, sf_dir):
    path = run_dir(spark, "frame")
    features.write_frame(frame(spark, sf_dir), path)
    return features.read_frame(spark, path, CFG)


_LABELS = " UNION ALL ".join(
    [f"SELECT target_id, ts, self__stage_ft AS current, 'regression' AS kind, CAST({h} AS INTEGER) AS horizon_h, CAST(NULL AS DOUBLE) AS threshold, "
     f"y_future_rise_{h}h AS actual FROM fr" for h in CFG.horizons]
    + [f"SELECT target_id, ts, self__stage_ft, 'classification', CAST({h} AS INTEGER), CAST({t} AS DOUBLE), "
       f'CAST("y_peak_above_{t}_{h}h" AS DOUBLE) FROM fr' for t in CFG.thresholds for h in CFG.horizons])
PLAN_SQL = f"""{G_SQL}, {_frame_sql()}, lb AS ({_LABELS}),
nn AS (SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY target_id, kind, horizon_h, threshold) AS n FROM lb
       WHERE actual IS NOT NULL WINDOW w AS (PARTITION BY target_id, kind, horizon_h, threshold ORDER BY ts)),
ws AS (SELECT *, greatest(10, n // 5) AS warm_up, greatest(1, (n - greatest(10, n // 5)) // 5) AS fold_size FROM nn),
fo AS (SELECT *, CASE WHEN n > warm_up + 5 AND position >= warm_up THEN CAST(least((position - warm_up) // fold_size, 4) AS INTEGER) END AS fold FROM ws),
t AS (SELECT *, CASE WHEN current IS NOT NULL THEN CASE kind WHEN 'regression' THEN greatest(0, 100 - current) ELSE least(1, current / 500) END END AS pred
      FROM fo WHERE fold IS NOT NULL)"""


def _planned(spark, sf_dir):
    """Labelled rows of every model with their folds."""
    from hydrospark.operators import forecast

    specs = _specs()
    return forecast.described(forecast.planned(_learning_frame(spark, sf_dir), specs), specs).withColumnRenamed("label", "actual")


def _ruled(spark, sf_dir):
    """Tested rows with the predictions of a rule in place of a model's: a river below 100 rises to 100, and its level over
    500 is the chance."""
    rule = F.when(F.col("kind") == "regression", F.greatest(F.lit(0.0), 100 - F.col("current"))).otherwise(F.least(F.lit(1.0), F.col("current") / 500))
    return _planned(spark, sf_dir).filter(F.col("fold").isNotNull()).withColumn("pred", F.when(F.col("current").isNotNull(), rule))


@query("gbt_folds", f"WITH {PLAN_SQL} SELECT target_id, kind, horizon_h, threshold, ts, actual, current, position, n, fold, warm_up + fold * fold_size AS train_end FROM fo")
def gbt_folds(spark, sf_dir):
    """What each model learns from and is tested on."""
    return rounded(_planned(spark, sf_dir).select(
        "target_id", "kind", "horizon_h", "threshold", "ts", "actual", "current", "position", "n", "fold", "train_end"), nudge=1e-9)


_POOLED = "target_id, kind, horizon_h, threshold"


@query("backtest_summary", f"""WITH {PLAN_SQL}, k AS (SELECT * FROM t WHERE pred IS NOT NULL),
b AS (SELECT {_POOLED}, pred, sum(actual) AS pos, count(*) AS c FROM k WHERE kind = 'classification' GROUP BY ALL),
c AS (SELECT *, sum(c) OVER u - sum(pos) OVER u - (c - pos) AS neg_below, sum(pos) OVER v AS top_pos, sum(c) OVER v AS top_n,
        sum(pos) OVER w AS p, sum(c) OVER w AS tot FROM b
      WINDOW w AS (PARTITION BY target_id, horizon_h, threshold), u AS (PARTITION BY target_id, horizon_h, threshold ORDER BY pred),
             v AS (PARTITION BY target_id, horizon_h, threshold ORDER BY pred DESC))
SELECT {_POOLED}, count(*) AS n, round(avg(abs(actual - pred)), 6) AS mae, round(sqrt(avg(pow(actual - pred, 2))), 6) AS rmse,
  round(1 - sum(pow(actual - pred, 2)) / (var_pop(actual) * count(*)), 6) AS r2, CAST(NULL AS DOUBLE) AS auc, CAST(NULL AS DOUBLE) AS ap,
  CAST(NULL AS DOUBLE) AS positive_rate FROM k WHERE kind = 'regression' GROUP BY ALL
UNION ALL SELECT {_POOLED}, CAST(max(tot) AS BIGINT), NULL, NULL, NULL,
  CASE WHEN max(p) > 0 AND max(p) < max(tot) THEN round(sum(pos * (neg_below + (c - pos) / 2)) / (max(p) * (max(tot) - max(p))), 6) END,
  CASE WHEN max(p) > 0 AND max(p) < max(tot) THEN round(sum(pos * top_pos / top_n) / max(p), 6) END, round(max(p) / max(tot), 6) FROM c GROUP BY ALL""")
def backtest_summary(spark, sf_dir):
    from hydrospark.operators import forecast

    return rounded(forecast.backtest_summary(_ruled(spark, sf_dir)))


@query("model_records", f"""WITH {PLAN_SQL},
rf AS (SELECT target_id, horizon_h, fold, avg(abs(actual - pred)) AS mae, avg(abs(actual)) AS naive FROM t WHERE kind = 'regression' GROUP BY ALL),
rm AS (SELECT target_id, horizon_h, avg(mae) AS mae, avg(naive) AS baseline_mae, count(*) AS n_folds FROM rf GROUP BY ALL),
re AS (SELECT target_id, horizon_h, count(*) AS n_total, count(*) FILTER (actual >= 0.5) AS n_rising, avg(abs(actual - pred)) FILTER (actual >= 0.5) AS em,
         avg(abs(actual)) FILTER (actual >= 0.5) AS eb FROM t WHERE kind = 'regression' GROUP BY ALL),
rg AS (SELECT target_id, 'regression' AS kind, horizon_h, CAST(NULL AS DOUBLE) AS threshold, n_folds, mae, baseline_mae,
         CASE WHEN n_total >= 100 AND n_rising >= 10 THEN em END AS event_mae, CASE WHEN n_total >= 100 AND n_rising >= 10 THEN eb END AS event_baseline_mae,
         CAST(NULL AS DOUBLE) AS auc, CAST(NULL AS DOUBLE) AS baseline_auc, CAST(NULL AS BIGINT) AS positive_events, CAST(NULL AS INTEGER) AS folds_with_events
       FROM rm JOIN re USING (target_id, horizon_h)),
cr AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY target_id, horizon_h, threshold, fold, pred) - 1) / 2 AS place FROM t
       WHERE kind = 'classification' AND pred IS NOT NULL WINDOW w AS (PARTITION BY target_id, horizon_h, threshold, fold ORDER BY pred)),
cf AS (SELECT target_id, horizon_h, threshold, fold, sum(actual) AS p, count(*) - sum(actual) AS q, sum(place) FILTER (actual = 1) AS places FROM cr GROUP BY ALL),
cm AS (SELECT target_id, horizon_h, threshold, count(*) AS n_folds, avg(CASE WHEN p > 0 AND q > 0 THEN (places - p * (p + 1) / 2) / (p * q) END) AS auc,
         CAST(sum(p) AS BIGINT) AS positive_events, CAST(count(*) FILTER (p > 0) AS INTEGER) AS folds_with_events FROM cf GROUP BY ALL),
cn AS (SELECT target_id, horizon_h, threshold, fold, count(*) FILTER (actual = 1) AS p, count(*) FILTER (actual = 0) AS q,
         count(*) FILTER (actual = 1 AND coalesce(current >= threshold, false)) AS hit, count(*) FILTER (actual = 0 AND NOT coalesce(current >= threshold, false)) AS calm
       FROM t WHERE kind = 'classification' GROUP BY ALL),
cb AS (SELECT target_id, horizon_h, threshold, avg(CASE WHEN p > 0 AND q > 0 THEN (hit / p + calm / q) / 2 END) AS baseline_auc FROM cn GROUP BY ALL),
m AS (SELECT *, coalesce(event_mae < event_baseline_mae, mae < baseline_mae) AS beats FROM rg
      UNION ALL SELECT target_id, 'classification', horizon_h, threshold, n_folds, NULL, NULL, NULL, NULL, auc, baseline_auc, positive_events, folds_with_events,
        auc > baseline_auc FROM cm JOIN cb USING (target_id, horizon_h, threshold)),
k AS (SELECT {_POOLED}, max(n) AS n_train_rows FROM fo GROUP BY ALL),
u AS (SELECT m.*, n_train_rows, CASE m.kind WHEN 'regression' THEN coalesce(beats, mae IS NOT NULL)
        ELSE coalesce(abs(auc - 0.5) > 1e-9, false) AND folds_with_events >= 2 AND coalesce(beats, true) END AS trustworthy
      FROM m JOIN k ON k.target_id = m.target_id AND k.kind = m.kind AND k.horizon_h = m.horizon_h AND k.threshold IS NOT DISTINCT FROM m.threshold)
SELECT {_POOLED}, n_train_rows, n_folds, round(mae, 6) AS mae, round(baseline_mae, 6) AS baseline_mae, round(event_mae, 6) AS event_mae,
  round(event_baseline_mae, 6) AS event_baseline_mae, CASE WHEN abs(auc - 0.5) > 1e-9 THEN round(auc, 6) END AS auc, round(baseline_auc, 6) AS baseline_auc, beats AS beats_baseline,
  positive_events, folds_with_events, trustworthy, trustworthy AND coalesce(beats, true) AS published FROM u""")
def model_records(spark, sf_dir):
    """Metadata of every model, written as files, found there again and judged."""
    from hydrospark.operators import forecast

    tested, path = _ruled(spark, sf_dir), run_dir(spark, "metadata")
    forecast.write_metadata(tested, tested.select("target_id", "kind", "horizon_h", "threshold", "target_col", F.col("n").alias("n_train_rows")).distinct(),
                            ["self__stage_ft"], path)
    return rounded(ev.trust(ev.read_sidecars(spark, path)).select(
        "target_id", "kind", "horizon_h", "threshold", "n_train_rows", F.col("n_folds").cast("long").alias("n_folds"), "mae", "baseline_mae", "event_mae",
        "event_baseline_mae", "auc", "baseline_auc", "beats_baseline", "positive_events", "folds_with_events", "trustworthy", "published"))


@query("gbt_backtest")
def gbt_backtest(spark, sf_dir):
    """Scores of every model, at all horizons and both kinds."""
    from hydrospark.operators import forecast

    return rounded(forecast.backtest(_learning_frame(spark, sf_dir), _specs())[1])


@query("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    """Forecasts of the models that their own metadata say may be shown."""
    from hydrospark.operators import forecast

    learning, path = _learning_frame(spark, sf_dir), run_dir(spark, "models")
    forecast.learn(learning, _specs(), path)
    return rounded(forecast.forecast(learning, path))
