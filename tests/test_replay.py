import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import replay

STAGE = [1.5, 1.5, 1.6, 1.6, 2.0, 3.0, 9.7, 18.5, 18.4, 13.1, 8.5]
RAIN = [0, 0, .1, .4, 2.8, 4.0, 1.8, .2, 0, 0, 0]
SOIL = [.30, .31, .35, .41, .44, .46, .51, .51, .49, .48, .47]


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for i in range(11):
        t = dt.datetime(2024, 9, 20 + i)
        rows += [(t, "usgs_dv", "gauge", "03451500", "stage_ft", STAGE[i]),
                 (t, "open_meteo_archive", "point", "asheville", "wx_precip_in_24h", float(RAIN[i])),
                 (t, "open_meteo_archive", "point", "asheville", "soil_era5_0_7cm", SOIL[i])]
    history = spark.createDataFrame(
        rows, "ts timestamp, source string, entity_type string, entity_id string, metric string, value double")
    tracks = spark.createDataFrame(
        [("AL092024", "HELENE", dt.datetime(2024, 9, 27, 12), 34.5, -82.6),
         ("AL092024", "HELENE", dt.datetime(2024, 9, 27, 18), 36.5, -84.0),
         ("AL092024", "HELENE", dt.datetime(2024, 9, 26, 18), 27.0, -84.6)],
        "storm_id string, name string, datetime timestamp, lat double, lon double")
    return replay.days(history, tracks, replay.home_site(spark)).cache()


def by_day(scored):
    return {str(r["day"]): r for r in scored.collect()}


def test_components(scored):
    days = by_day(scored)
    assert len(days) == 11
    assert days["2024-09-24"]["qpf_in"] == pytest.approx(8.6)
    crest = days["2024-09-27"]
    assert crest["index_stage"] == 35.0 and crest["index_storm"] == 20.0 and crest["index_alert"] == 0.0
    assert crest["storm_name"] == "HELENE" and crest["storm_mi"] < 90 and crest["index_rise"] < 5
    assert not days["2024-09-20"]["soil_saturated"] and crest["soil_saturated"]
    # Score is the amplified sum of the rounded parts.
    parts = sum(crest[f"index_{n}"] for n in ("stage", "qpf", "storm", "rise", "alert", "soil"))
    assert crest["score"] == round(min(100.0, parts * 1.25))


def test_validation(spark, scored):
    events = spark.createDataFrame([("03451500",)], "site_id string").withColumn(
        "event_day", F.lit("2024-09-27").cast("date"))
    row = replay.validate(scored, events).first()
    days = by_day(scored)
    lead = 0
    while days[f"2024-09-{26 - lead:02d}"]["score"] >= 40:
        lead += 1
    assert row["lead_days"] == lead >= 1
    assert row["total_days"] == 11 and row["peak_score"] == max(
        days[f"2024-09-{d}"]["score"] for d in range(25, 30))
    assert row["alert_days"] == sum(r["score"] >= 40 for r in days.values())
    window = replay.event_window(scored, events, 2)
    assert sorted(str(r["day"]) for r in window.collect()) == [f"2024-09-{d}" for d in range(25, 30)]
    quiet = replay.lead_days(scored, events.withColumn("event_day", F.lit("2024-09-21").cast("date")))
    assert quiet.first()["lead_days"] == 0
    assert replay.as_report(scored).first()["components"].keys() == {
        "stage", "qpf", "storm", "rise", "alert", "soil"}


def test_runs_break_on_missing_days(spark):
    days = [("s", d, sc) for d, sc in (("2024-01-01", 50), ("2024-01-02", 60), ("2024-01-04", 45), ("2024-01-05", 10))]
    df = spark.createDataFrame(days, "site_id string, d string, score int").withColumn(
        "day", F.col("d").cast("date"))
    runs = {(str(r["first_day"]), r["run_days"]) for r in replay.alert_runs(df).collect()}
    assert runs == {("2024-01-01", 2), ("2024-01-04", 1)}
