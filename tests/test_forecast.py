import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import boosting, evaluation as ev, features, forecast


def test_walk_forward_folds(spark):
    rows = [("t", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(203)]
    rows += [("short", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(14)]
    out = ev.fold_ids(spark.createDataFrame(rows, "target_id string, ts timestamp"), span_s=36 * 3600)
    got = [r["fold"] for r in out.filter("target_id = 't'").orderBy("ts").collect()]
    first, size = 40, (203 - 40) // 5
    want = [None if i < first else min((i - first) // size, 4) for i in range(203)]
    assert got == want
    assert {r["fold"] for r in out.filter("target_id = 'short'").collect()} == {None}
    assert all(r["train_end"] <= r["position"] for r in out.filter("fold is not null").collect())


def test_regression_metrics(spark):
    df = spark.createDataFrame(
        [("p", 1.0, 1.0), ("p", 2.0, 2.0), ("p", None, 99.0), ("p", 4.0, 4.0), ("c", 3.0, 1.0)],
        "k string, actual double, pred double")
    got = {r["k"]: r for r in ev.regression_metrics(df, ["k"]).collect()}
    assert (got["p"]["n"], got["p"]["mae"], got["p"]["rmse"], got["p"]["r2"]) == (3, 0.0, 0.0, 1.0)
    assert got["c"]["r2"] is None and got["c"]["mae"] == 2.0


@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_ranking_metrics_equal_brute_force(spark, chunks):
    random.seed(3)
    data = {"m": [(random.randint(0, 1), random.randint(0, 30) / 30) for _ in range(200)],
            "n": [(int(random.random() < 0.2), random.random()) for _ in range(150)],
            "one": [(0, 0.1), (0, 0.2)]}
    df = spark.createDataFrame([(k, y, s) for k, v in data.items() for y, s in v],
                               "k string, actual int, pred double")
    got = {r["k"]: r for r in ev.ranking_metrics(df, ["k"], chunks=chunks).collect()}
    for k in ("m", "n"):
        pos = [s for y, s in data[k] if y]
        neg = [s for y, s in data[k] if not y]
        auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        ap = seen = hits = 0
        for level in sorted({s for _, s in data[k]}, reverse=True):
            here = [y for y, s in data[k] if s == level]
            hits, seen = hits + sum(here), seen + len(here)
            ap += sum(here) / len(pos) * hits / seen
        assert got[k]["auc"] == pytest.approx(auc) and got[k]["ap"] == pytest.approx(ap)
    assert got["one"]["auc"] is None and got["one"]["positive_rate"] == 0.0
    whole = ev.ranking_metrics(df.filter("k = 'm'"), [], chunks=chunks).first()
    assert whole["auc"] == pytest.approx(got["m"]["auc"])


def test_calibration_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 0.95), ("a", 0, 0.05)], "k string, actual int, pred double")
    got = {r["bin"]: (r["n"], r["observed"]) for r in ev.calibration(df, ["k"]).collect()}
    assert got == {9: (2, 0.5), 0: (1, 0.0)}


def test_rising_regime(spark):
    rows = [("t", 0.0, 0.0)] * 200 + [("t", 3.0, 3.0)] * 50 + [("flat", 0.0, 0.0)] * 500
    got = {r["k"]: r for r in ev.rising_regime(
        spark.createDataFrame(rows, "k string, actual double, pred double"), ["k"]).collect()}
    assert (got["t"]["n_rising"], got["t"]["event_mae"], got["t"]["event_baseline_mae"]) == (50, 0.0, 3.0)
    assert got["flat"]["event_mae"] is None


def test_gate_follows_the_rising_regime(spark):
    df = spark.createDataFrame([(0.2, 0.1, 0.9, 1.4), (0.2, 0.1, None, None)],
                               "overall_mae double, baseline_mae double, event_mae double, event_baseline_mae double")
    got = [(r["beats_baseline_overall"], r["beats_baseline"]) for r in ev.regression_gate(df).collect()]
    assert got == [(False, True), (False, False)]


HIST = "ts timestamp, source string, entity_type string, entity_id string, metric string, value double"


@pytest.fixture(scope="module")
def history(spark):
    start, rows = dt.datetime(2025, 8, 1), []
    for i in range(480):
        t = start + dt.timedelta(hours=i)
        stage = 3 + math.sin(i / 20) + 0.4 * math.sin(i / 5)
        rows += [(t, "snapshot", "gauge", "T", "stage_ft", stage),
                 (t, "snapshot", "gauge", "U", "stage_ft", 2 + math.sin((i - 3) / 20))]
    for d in range(20):
        t = start + dt.timedelta(days=d)
        rows += [(t, "open_meteo_archive", "point", "w", "wx_precip_in_24h", float(d % 3)),
                 (t, "open_meteo_archive", "point", "w", "soil_era5_0_7cm", 0.2 + d / 100)]
    return spark.createDataFrame(rows, HIST).cache()


@pytest.fixture(scope="module")
def frame(spark, history, tmp_path_factory):
    cfg = features.FrameConfig(upstream=["U"], horizons=(6,), thresholds=(3.5,))
    series = features.hourly_series(history, cfg)
    targets = spark.createDataFrame([("T", "w")], "target_id string, weather_entity string")
    edges = spark.createDataFrame([("T", "U", "U")], "target_id string, upstream_id string, slot string")
    path = str(tmp_path_factory.mktemp("frame"))
    features.write_frame(features.training_frame(series, targets, edges, cfg), path)
    return spark.read.parquet(path)


def test_frame_columns():
    cfg = features.FrameConfig(upstream=["03439000", "03443000", "03446000", "03451000"])
    columns = features.feature_columns(cfg)
    assert len(columns) == 96
    assert {"self__stage_ft__lag24", "up_03451000__stage_ft__roll24_std", "precip__api336_d99",
            "soil_top__roll72_max", "soil_deep"} <= set(columns)


def test_frame_values(frame):
    rows = {r["ts"]: r for r in frame.collect()}
    assert len(rows) == 480
    at = dt.datetime(2025, 8, 3)
    stage = [3 + math.sin(i / 20) + 0.4 * math.sin(i / 5) for i in range(480)]
    r = rows[at]
    assert r["self__stage_ft"] == pytest.approx(stage[48])
    assert r["self__stage_ft__lag3"] == pytest.approx(stage[45])
    assert r["self__stage_ft__roll24_max"] == pytest.approx(max(stage[25:49]))
    assert r["up_U__stage_ft__lag1"] == pytest.approx(2 + math.sin(44 / 20))
    assert r["y_future_max_6h"] == pytest.approx(max(stage[49:55]))
    # Daily totals stay filled over their day, so 24 hours sum to 24 times the total.
    assert r["precip__roll24_sum"] == pytest.approx(23 * 1.0 + 2.0)
    assert r["soil_deep"] is None


def test_backtest_forecast_and_gate(spark, frame, tmp_path):
    spec = forecast.ModelSpec(6, folds=3, rounds=4, depth=3)
    above = forecast.ModelSpec(6, "classification", 3.5, folds=3, rounds=4, depth=3)
    assert spec.target_col == "y_future_rise_6h"
    tested = forecast.learn(frame, [spec, above], str(tmp_path))
    scored = {r["kind"]: r for r in forecast.score_backtest(tested).collect()}
    assert {(r["kind"], r["fold"]) for r in tested.select("kind", "fold").distinct().collect()} == {
        (k, f) for k in ("regression", "classification") for f in range(3)}
    row = scored["regression"]
    assert row["n_folds"] == 3 and row["baseline_kind"] == "no-change" and 0 < row["overall_mae"] < row["baseline_mae"]
    assert scored["classification"]["overall_auc"] > 0.5
    sidecars, trees = forecast.saved(spark, str(tmp_path))
    assert trees.count() == 2 and {(r["kind"], r["n_train_rows"]) for r in sidecars.collect()} == {
        ("regression", 475), ("classification", 475)}
    assert sidecars.first()["metrics"]["per_fold"][0]["n"] > 0 and sidecars.first()["feature_cols"] == forecast.feature_names(frame)
    shown = {r["kind"]: r for r in forecast.forecast(frame, str(tmp_path), published_only=False).collect()}
    out = shown["regression"]
    assert out["prediction"] >= out["current_ft"] and out["ts"] == dt.datetime(2025, 8, 20, 23)
    assert out["prediction"] == max(out["current_ft"], out["current_ft"] + out["predicted_rise_ft"])
    assert 0 <= shown["classification"]["prediction"] <= 1
    # a file that cannot be read takes its model with it
    broken = next(p for p in (tmp_path / "meta").rglob("*.json") if "model=regression" in str(p))
    broken.with_name(f".{broken.name}.crc").unlink()
    broken.write_text('{"kind": ')
    assert {r["kind"] for r in forecast.forecast(frame, str(tmp_path), published_only=False).collect()} == {"classification"}
    with pytest.raises(ValueError):
        forecast.ModelSpec(6, "classification")
    with pytest.raises(KeyError):
        forecast.learn(frame, [forecast.ModelSpec(999)])
    with pytest.raises(ValueError):
        forecast.learn(frame, [spec, forecast.ModelSpec(6)])


def rows_of(target, start, n, shift=0.0):
    return [(target, start + dt.timedelta(hours=i), float(i % 7), None if i % 5 else 1.0, float(i % 7) * 2 + shift) for i in range(n)]


FRAME = "target_id string, ts timestamp, self__stage_ft double, gap double, y_future_rise_6h double"


def test_each_target_learns_from_its_own_rows(spark):
    early, late = dt.datetime(2010, 1, 1), dt.datetime(2020, 1, 1)
    both = spark.createDataFrame(rows_of("a", early, 400) + rows_of("b", late, 300, shift=50.0) + rows_of("few", late, 8), FRAME)
    spec = forecast.ModelSpec(6, folds=3, rounds=8, depth=3, step=0.5)
    tested = forecast.learn(both, [spec])
    worst = {(r["target_id"], r["fold"]): r["e"] for r in tested.groupBy("target_id", "fold").agg(
        F.max(F.abs(F.col("actual") - F.col("pred"))).alias("e")).collect()}
    assert set(worst) == {(t, f) for t in "ab" for f in range(3)} and max(worst.values()) < 1.5
    alone = forecast.learn(both.filter("target_id = 'b'"), [spec])
    key = ["ts", "fold", "pred"]
    assert sorted(map(tuple, tested.filter("target_id = 'b'").select(key).collect())) == sorted(map(tuple, alone.select(key).collect()))
    assert forecast.learn(both.limit(0), [spec]).count() == 0
    assert forecast.score_backtest(forecast.learn(both.filter("target_id = 'few'"), [spec])).count() == 0


def test_split_blocks_grow_the_same_trees(spark, monkeypatch):
    one = spark.createDataFrame(rows_of("a", dt.datetime(2010, 1, 1), 400), FRAME)
    spec = forecast.ModelSpec(6, folds=2, rounds=5, depth=3)
    whole = {(r["ts"], r["fold"]): r["pred"] for r in forecast.learn(one, [spec]).collect()}
    monkeypatch.setattr(boosting, "BLOCK_H", 48)
    cut = {(r["ts"], r["fold"]): r["pred"] for r in forecast.learn(one, [spec]).collect()}
    assert whole == pytest.approx(cut)


def test_best_split_equals_brute_force():
    pick = np.random.default_rng(6)
    x, y = pick.integers(0, 6, (80, 3)).astype(np.uint8), pick.standard_normal(80)
    model = boosting.Model("t", 0, boosting.FINAL, "regression", 0, 0.0, True, *[np.full((1, 3), v, t) for v, t in (
        (-1, np.int16), (0, np.uint8), (0.0, float))])
    sums = boosting._sums(model, x, y, np.arange(80), 6, 0)
    growth = boosting.Growth(depth=1, bins=6, least=5.0)
    feature, split, left, right = (v[0] for v in boosting.best_splits(sums, growth, growth.least))

    def gain(f, b):
        low = x[:, f] <= b
        if min(low.sum(), (~low).sum()) < 5:
            return -np.inf
        return sum(y[s].sum() ** 2 / (s.sum() + growth.ridge) for s in (low, ~low))

    assert (feature, split) == max(((f, b) for f in range(3) for b in range(6)), key=lambda k: gain(*k))
    low = x[:, feature] <= split
    assert left == pytest.approx(growth.step * y[low].sum() / (low.sum() + 1)) and right == pytest.approx(growth.step * y[~low].sum() / ((~low).sum() + 1))
    edges = [np.array([1.0, 2.0])]
    assert boosting.binned(np.array([[np.nan], [0.5], [1.0], [1.5], [2.0], [9.0]]), edges).ravel().tolist() == [0, 1, 1, 2, 2, 3]


def test_trust_needs_events_in_two_folds(spark):
    def card(rates, auc, beats):
        folds = [{"n": 1000, "positive_rate": r, "fold": i} for i, r in enumerate(rates)]
        return {"target_id": "t", "kind": "classification", "horizon_h": 6, "threshold": 9.5,
                "metrics": {"per_fold": folds, "overall_auc": auc, "beats_baseline": beats}}

    import json
    cards = [card([0.01, 0.02], 0.8, True), card([0.0, 0.02], 0.8, True), card([0.1, 0.1], 0.5, True),
             card([0.1, 0.1], 0.8, False)]
    df = spark.createDataFrame([(json.dumps(c),) for c in cards], "v string").select(
        F.from_json("v", ev.SIDECAR).alias("d")).select("d.*")
    got = [(r["positive_events"], r["folds_with_events"], r["trustworthy"]) for r in ev.trust(df).collect()]
    assert got == [(30, 2, True), (20, 1, False), (200, 2, False), (200, 2, False)]
