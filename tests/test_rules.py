import pytest
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions import geo, hazard, index, stage, storm
from hydrospark.functions.base import half_even, number
from hydrospark.operators import flood_index, hazards


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(n) for n, e in exprs.items()]).first()


def test_half_even_matches_binary_value(spark):
    values = [0.35, 0.05, 0.25, 2.675, 1.005, 93.15, 81 * 1.15, 1036.25, -0.35, 0.45]
    values += [i * 0.05 for i in range(400)] + [i / 7 for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[half_even("v", d).alias(f"d{d}") for d in (0, 1, 2, 3)]).collect()
    for r in rows:
        assert [r[f"d{d}"] for d in (0, 1, 2, 3)] == [round(r["v"], d) for d in (0, 1, 2, 3)]


def test_number_rejects_junk(spark):
    rows = spark.createDataFrame([("7.5",), ("true",), ("x",), ("-999999",), ("NaN",), (None,)],
                                 "v string").select(number("v").alias("n")).collect()
    assert [r["n"] for r in rows] == [7.5, None, None, None, None, None]


def test_haversine(spark):
    r = one(spark, same=geo.haversine_mi(35.0, -80.0, 35.0, -80.0),
            degree=geo.haversine_mi(35.0, -80.0, 36.0, -80.0),
            city=geo.haversine_mi(35.5951, -82.5515, 35.2271, -80.8431))
    assert r["same"] == 0 and 68 < r["degree"] < 70 and 95 < r["city"] < 115


def test_bearing_and_difference(spark):
    r = one(spark, north=geo.bearing_deg(30.0, -80.0, 31.0, -80.0),
            east=geo.bearing_deg(0.0, 0.0, 0.0, 1.0), turn=geo.angular_diff(F.lit(350.0), F.lit(10.0)))
    assert (r["north"], r["east"], r["turn"]) == pytest.approx((0, 90, 20))


def test_basin(spark):
    ring = dims.BASIN_RING
    r = one(spark, inside=geo.inside_ring(F.lit(35.20), F.lit(-82.50), ring),
            far=geo.inside_ring(F.lit(40.0), F.lit(-100.0), ring),
            zero=geo.ring_distance_mi(F.lit(35.20), F.lit(-82.50), ring),
            near=geo.ring_proximity(F.lit(50.0)))
    assert r["inside"] and not r["far"] and r["zero"] == 0 and 0 < r["near"] < 1


def test_stage_category(spark):
    levels = {"action": 6.5, "minor": 9.5, "moderate": 13.0, "major": 18.0}
    rows = [("a", 0.5, None, None), ("b", 6.5, None, None), ("c", 9.5, None, None),
            ("d", 13.0, None, None), ("e", 50.0, None, "reservoir"), ("f", None, None, None)]
    df = spark.createDataFrame(rows, "k string, s double, p double, role string").withColumns(
        {k: F.lit(v) for k, v in levels.items()})
    got = {r["k"]: r["c"] for r in df.select("k", stage.category(
        "s", "p", "role", F.lit(True)).alias("c")).collect()}
    assert got == {"a": "below action", "b": "action stage", "c": "MINOR FLOOD",
                   "d": "MODERATE FLOOD", "e": "MAJOR FLOOD", "f": "unknown"}
    bare = df.select("k", stage.category("s", "p", F.lit("reservoir"), F.lit(False)).alias("c"))
    assert bare.first()["c"] == "pool stage"


def test_eta(spark):
    r = one(spark, a=stage.eta_hours(F.lit(5.0), F.lit(9.5), F.lit(0.5)),
            b=stage.eta_hours(F.lit(5.0), F.lit(9.5), F.lit(0.0)),
            c=stage.eta_hours(F.lit(10.0), F.lit(9.5), F.lit(0.5)),
            d=stage.eta_hours(F.lit(5.0), F.lit(9.5), F.lit(None).cast("double")))
    assert (r["a"], r["b"], r["c"], r["d"]) == (9.0, None, 0.0, None)


def _slide(spark, region, soil, past, ahead, wet):
    df = spark.createDataFrame([(region, soil, None, past, ahead, wet)],
                               "region string, soil_moisture_top double, soil_moisture_shallow double,"
                               "past_7d_precip_in double, next_72h_precip_in double, saturated boolean")
    return hazards.landslide(df).first()


def test_landslide(spark):
    assert _slide(spark, "mountain", 0.15, 0.2, 0.0, False)["slide_score"] < 35
    worst = _slide(spark, "mountain", 0.45, 9.0, 8.0, True)
    assert worst["slide_label"] == "EXTREME" and worst["slide_score"] == 100.0
    assert _slide(spark, "coastal", 0.45, 9.0, 8.0, True)["slide_score"] == 30.0
    assert _slide(spark, "piedmont", 0.45, 9.0, 8.0, True)["slide_score"] == 65.0
    assert _slide(spark, "mountain", None, None, None, None)["slide_score"] == 18.0


def _fire(spark, t, h, w, region="mountain", red=False, alert=False):
    df = spark.createDataFrame([(t, h, w, region, red, alert)], "temp_f double, humidity_pct double,"
                               "wind_mph double, region string, red_flag boolean, fire_alert boolean")
    return hazards.fire_weather(df).first()


def test_fire_weather(spark):
    assert _fire(spark, 90.0, 15.0, 25.0)["fwi"] > 50
    assert _fire(spark, 60.0, 90.0, 2.0)["fwi"] < 20
    missing = _fire(spark, None, 50.0, 10.0)
    assert missing["fwi"] is None and missing["fire_score"] == 0 and missing["fire_label"] == "CALM"
    assert _fire(spark, 60.0, 80.0, 2.0, red=True, alert=True)["fire_score"] >= 70
    assert _fire(spark, 60.0, 80.0, 2.0, alert=True)["fire_label"] == "ELEVATED"


def test_sea_soil_air(spark):
    r = one(spark, none=hazard.sea_state(F.lit(None).cast("double"), F.lit(None).cast("double")),
            calm=hazard.sea_state(F.lit(2.0), F.lit(10.0)), rough=hazard.sea_state(F.lit(10.0), F.lit(36.0)),
            top=hazard.sea_state(F.lit(30.0), F.lit(70.0)), dry=hazard.soil_condition(F.lit(0.10)),
            air=hazard.air_band(F.lit(42.0)), bad=hazard.air_band(F.lit(301.0)))
    assert list(r) == ["unknown", "CALM", "ROUGH", "PHENOMENAL", "very dry", "GOOD", "HAZARDOUS"]


def _index(spark, **over):
    given = {"stage_ft": None, "qpf_in": 0.0, "storm_mi": None, "rate_ft_per_hr": 0.0, "alert": False,
             "soil": 0.10, "saturated": False, "past_7d_in": 0.0, **over}
    kinds = {"alert": "boolean", "saturated": "boolean"}
    df = spark.createDataFrame([tuple(given.values())],
                               ", ".join(f"{k} {kinds.get(k, 'double')}" for k in given))
    return flood_index.score(df).first()


def test_flood_index(spark):
    assert _index(spark)["label"] == "CALM"
    assert _index(spark, stage_ft=18.0)["index_stage"] == 35.0
    heavy = _index(spark, qpf_in=5.0)
    assert heavy["index_qpf"] == 20.0 and heavy["qpf_over_3in"]
    near, far = _index(spark, storm_mi=100.0), _index(spark, storm_mi=1400.0)
    assert near["index_storm"] > far["index_storm"] > 0 and near["storm_within_500mi"]
    assert _index(spark, rate_ft_per_hr=2.0)["index_rise"] == 10.0
    top = _index(spark, stage_ft=30.0, rate_ft_per_hr=5.0, storm_mi=50.0, alert=True, qpf_in=15.0,
                 soil=0.5, past_7d_in=10.0, saturated=True)
    assert (top["score"], top["label"]) == (100, "EMERGENCY")
    assert _index(spark, qpf_in=3.0, soil=0.45, saturated=True)["score"] > _index(spark, qpf_in=3.0)["score"]


def test_storm_factors(spark):
    r = one(spark, unknown=storm.orographic_factor(F.lit(-84.0), F.lit(35.0), F.lit(None).cast("double"),
                                                   F.lit(-82.55)),
            north=storm.orographic_factor(F.lit(-84.0), F.lit(35.0), F.lit(0.0), F.lit(-82.55)),
            weak=storm.decayed_wind_kt(F.lit(50.0), F.lit(20.0)),
            none=storm.decayed_wind_kt(F.lit(50.0), F.lit(None).cast("double")),
            strong=storm.decayed_wind_kt(F.lit(0.0), F.lit(100.0)),
            moist=storm.moisture_factor(F.lit(40.0), F.lit(25.0), F.lit(8), F.lit(35.6)))
    assert 1 < r["unknown"] < r["north"] <= 3
    assert (r["weak"], r["none"], r["strong"]) == (20.0, 0.0, 100.0)
    assert r["moist"] == pytest.approx(0.3 + 1.2 * 48 / 65)


def test_freshness(spark):
    def level(minutes):
        age, band = hazard.freshness(F.lit(1_000_000), F.lit(1_000_000 + minutes * 60))
        return one(spark, b=band)["b"]

    assert [level(m) for m in (10, 100, 200, 500)] == ["fresh", "aging", "stale", "frozen"]
    age, band = hazard.freshness(F.lit(None).cast("bigint"), F.lit(5))
    assert tuple(one(spark, a=age, b=band)) == (None, "frozen")


def test_levels(spark):
    got = one(spark, **{k: index.level(F.lit(k)) for k in index.LEVELS})
    assert got["ELEVATED"] == "watch" and got["EMERGENCY"] == "emergency"
