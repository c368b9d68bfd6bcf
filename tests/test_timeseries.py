import math

import pytest

from hydrospark.operators import timeseries as ts


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
            for r in df.orderBy("entity_id", "ts").collect()]


def test_lags_and_deltas(series):
    out = ts.lags(series([1, 2, 3, 4, 5]), [1, 2])
    assert ordered(out, "x__lag1", "x__lag2") == [
        (None, None), (1, None), (2, 1), (3, 2), (4, 3)]
    assert ordered(ts.deltas(series([1, 3, 6, 10]), [1]), "x__delta1") == [None, 2, 3, 4]


def test_rolling_uses_short_head(series):
    out = ts.rolling(series([1, 2, 3, 4]), [2])
    assert ordered(out, "x__roll2_mean") == [1, 1.5, 2.5, 3.5]
    assert ordered(out, "x__roll2_max") == [1, 2, 3, 4]
    assert ordered(out, "x__roll2_std")[0] is None


def test_antecedent_index(series):
    out = ts.antecedent(series([10, 0, 0, 0, 0]), 0.5, 4)
    assert ordered(out, "precip__api4_d50") == pytest.approx([10, 5, 2.5, 1.25, 0])


def test_future_labels(series):
    out = ts.targets(series(range(10)), [3], [5.0])
    rows = ordered(out, "y_future_max_3h", "y_future_val_3h", "y_peak_above_5.0_3h")
    assert rows[0] == (3, 3, 0) and rows[3] == (6, 6, 1)
    # The row before the tail has a partial frame; the last two have none.
    assert [r[0] for r in rows[-3:]] == [9, None, None]
    assert [r[2] for r in rows[-2:]] == [None, None]
    compat = ts.targets(series(range(10)), [3], [5.0], compat=True)
    assert [r["y_peak_above_5.0_3h"] for r in compat.orderBy("ts").collect()][-1] == 0


def test_future_rise(series):
    out = ts.targets(series([1, 1, 5, 2, 1, 1]), [2])
    assert ordered(out, "y_future_max_2h", "y_future_rise_2h")[0] == (5, 4)


@pytest.mark.parametrize("chunk", [24, 100, 5000])
def test_chunks_do_not_change_results(series, chunk):
    values = [10 + 5 * math.sin(i / 7) + i % 13 for i in range(400)]
    df = series(values).unionByName(series(values[::-1], entity="h"))
    whole = ts.rolling(df, [3, 24], chunk_rows=10**6)
    cut = ts.rolling(df, [3, 24], chunk_rows=chunk)
    for c in ("x__roll3_mean", "x__roll24_std", "x__roll24_max"):
        assert ordered(cut, c) == pytest.approx(ordered(whole, c), nan_ok=True)
    a = ordered(ts.targets(df, [24], chunk_rows=chunk), "y_future_max_24h")
    assert a == ordered(ts.targets(df, [24], chunk_rows=10**6), "y_future_max_24h")
    api = ordered(ts.antecedent(df, 0.85, 14, chunk_rows=chunk), "precip__api14_d85")
    brute = [sum(0.85 ** i * values[t - i] for i in range(14) if t >= i) for t in range(400)]
    assert api[:400] == pytest.approx(brute)


def test_fill_forward_between_own_ends(series):
    df = series([1, None, None, 4]).unionByName(series([7, None, 9], entity="h"))
    out = ts.fill_forward(df, span_s=3600)
    assert ordered(out, "entity_id", "value") == [
        ("g", 1), ("g", 1), ("g", 1), ("g", 4), ("h", 7), ("h", 7), ("h", 9)]


def test_best_source_is_never_blended(spark, series):
    from pyspark.sql import functions as F

    hourly = series([24.0] * 24, start="2024-09-27 00:00:00").withColumn("source", F.lit("usgs_iv"))
    daily = series([18.0], start="2024-09-27 00:00:00").withColumn("source", F.lit("usgs_dv"))
    kept = ts.best_source(hourly.unionByName(daily))
    assert kept.count() == 24 and {r["source"] for r in kept.collect()} == {"usgs_iv"}
    other = series([1.0], entity="z").withColumn("source", F.lit("elsewhere"))
    assert ts.best_source(other).count() == 1


def test_hourly_maximum_keeps_the_crest(series):
    df = series([20.0, 22.0, 24.82, 24.0], hours=0.25, start="2024-09-27 21:00:00")
    assert ordered(ts.bucket_max(df), "value") == [24.82]


def test_first_metric_prefers_listed_order(series):
    df = series([1.0], metric="precip_in_24h").unionByName(series([2.0], metric="wx_precip_in"))
    out = ts.first_metric(df, {"precip": ["wx_precip_in_24h", "wx_precip_in", "precip_in_24h"]})
    assert [(r["metric"], r["value"]) for r in out.collect()] == [("precip", 2.0)]


def test_largest_total_and_peak(series):
    row = ts.largest_total(series([0, 1, 3, 2, 0]), 2, keys=["entity_id"]).first()
    assert (row["max_2"], row["total"], row["peak_value"]) == (5, 6, 3)
    assert ts.largest_total(series([1, 2]), 6, keys=["entity_id"]).first()["max_6"] == 3


def test_cumulative_share_across_chunks(series):
    out = ts.cumulative_share(series([1, 2, 3, 4]), keys=["entity_id"], span_s=7200)
    assert ordered(out, "running") == [1, 3, 6, 10]
    assert ordered(out, "share") == pytest.approx([0.1, 0.3, 0.6, 1.0])


def test_recent_rate_needs_two_readings(series):
    rows = {r["entity_id"]: r["rate_ft_per_hr"] for r in ts.recent_rate(
        series([1.0 + 0.5 * i for i in range(40)]).unionByName(series([3.0], entity="one"))
    ).collect()}
    assert rows["g"] == pytest.approx(0.5) and rows["one"] is None


def test_chunks_never_change_a_frame_on_a_series_with_holes(spark):
    """Same rows for chunks of 7, 50 and a million rows, in every function that cuts."""
    import datetime as dt

    from hydrospark.operators import timeseries as ts

    start = dt.datetime(2024, 1, 1)
    hours = [h for h in range(400) if not (40 <= h < 280 or h % 11 in (3, 4))]
    df = spark.createDataFrame([("gauge", "g", "stage_ft", start + dt.timedelta(hours=h), float(h * 7 % 31)) for h in hours],
                               "entity_type string, entity_id string, metric string, ts timestamp, value double").cache()

    def everything(chunk):
        out = ts.lags(df, [1, 6, 24], chunk_rows=chunk)
        out = ts.deltas(out, [3], chunk_rows=chunk)
        out = ts.rolling(out, [6, 24], chunk_rows=chunk)
        out = ts.antecedent(out, 0.85, 14, chunk_rows=chunk)
        out = ts.targets(out, [6, 24], [20.0], chunk_rows=chunk)
        total = ts.largest_total(df, 12, keys=["entity_id"], chunk_rows=chunk)
        rounded = [[round(v, 9) if isinstance(v, float) else v for v in r] for r in out.orderBy("ts").collect()]
        return rounded, [tuple(r) for r in total.collect()]

    whole = everything(10**6)
    assert len(whole[0]) == len(hours)
    assert everything(7) == whole and everything(50) == whole
