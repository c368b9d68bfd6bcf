from hydrospark.operators import card


def test_card_and_summary(spark):
    forecasts = spark.createDataFrame(
        [("s", "regression", 24, None, 9.0), ("s", "regression", 6, None, 5.02), ("s", "classification", 6, 9.5, 0.29),
         ("s", "classification", 6, None, 0.7), ("s", "classification", 6, 6.5, 1.4), ("s", "regression", 72, None, None),
         ("bare", "regression", 6, None, -1.0)],
        "target_id string, kind string, horizon_h int, threshold double, prediction double")
    gauges = spark.createDataFrame([("s", 5.0)], "site_id string, stage_ft double")
    stages = spark.createDataFrame([("s", 6.5, 9.5, 13.0, 0.0)], "site_id string, action double, minor double, moderate double, major double")
    records = spark.createDataFrame(
        [("s", "regression", 24, None, 0.2, 0.5, 0.6, True, True, None, None, None, 5, True),
         ("s", "regression", 72, None, 0.9, 0.5, 0.4, False, False, None, None, None, 5, False),
         ("s", "regression", 6, None, 0.9, 0.5, 0.4, False, False, None, None, None, 5, False),
         ("s", "classification", 6, 9.5, None, None, None, True, True, 0.8, 12, 3, 5, True)],
        "target_id string, kind string, horizon_h int, threshold double, mae double, event_mae double, event_baseline_mae double, "
        "beats_baseline boolean, beats_baseline_overall boolean, auc double, positive_events long, folds_with_events int, n_folds int, trustworthy boolean")
    cards = card.card(forecasts, gauges, stages, records)
    rows = {(r["target_id"], r["kind"], r["place"]): r for r in cards.collect()}
    assert len(rows) == 6
    first, second = rows["s", "regression", 1], rows["s", "regression", 2]
    assert (first["horizon_h"], first["direction"], first["above_minor"], first["axis_max"]) == (6, "flat", False, 25.0)
    assert (second["direction"], second["mae"], second["now_pct"], second["pred_pct"]) == ("up", 0.2, 20.0, 36.0)
    chances = [rows["s", "classification", i] for i in (1, 2, 3)]
    assert [(c["threshold"], c["pct"], c["severity"], c["threshold_label"], c["trustworthy"]) for c in chances] == [
        (None, 70, "high", "", False), (6.5, 100, "high", "action", False), (9.5, 28, "med", "minor", True)]
    bare = rows["bare", "regression", 1]
    assert (bare["current_ft"], bare["delta"], bare["direction"], bare["pred_pct"], bare["above_minor"]) == (None, None, "flat", 0.0, False)
    told = {r["target_id"]: r for r in card.summary(cards, records).collect()}
    assert (told["s"]["n_levels"], told["s"]["n_chances"], told["s"]["any_untrustworthy"], told["s"]["withheld"]) == (2, 3, True, [6, 72])
    assert told["bare"]["withheld"] == [] and not told["bare"]["any_untrustworthy"]
    assert card.card(forecasts.limit(0), gauges, stages, records).count() == 0
