import json

from hydrospark.operators import replay, store
from hydrospark.sources import backfill


def test_backfill_and_validation_files(spark, tmp_path):
    daily, archive = tmp_path / "dv", tmp_path / "archive"
    (archive / "forest").mkdir(parents=True)
    daily.mkdir()
    payload = {"value": {"timeSeries": [{"variable": {"variableCode": [{"value": "00065"}]},
               "values": [{"value": [{"value": "2.5", "dateTime": "2024-09-27T00:00:00.000"}]}]}]}}
    (daily / "03451500_2024.json").write_text(json.dumps(payload))
    (archive / "forest" / "Pisgah_2024.json").write_text(json.dumps(
        {"daily": {"time": ["2023-01-01"], "precipitation_sum": [25.4]}}))
    months = backfill.run(spark, str(tmp_path / "store"), daily=str(daily), archive=str(archive))
    assert months == ["2023-01", "2024-09"]
    got = {(r["entity_type"], r["entity_id"], r["metric"], r["value"])
           for r in store.load(spark, str(tmp_path / "store")).collect()}
    assert got == {("gauge", "03451500", "stage_ft", 2.5), ("forest", "Pisgah", "wx_precip_in_24h", 1.0)}
    out = str(tmp_path / "validation")
    assert replay.read_validation(spark, out) is None
    replay.write_validation(spark.createDataFrame([("s", 96)], "site_id string, peak_score int"), out)
    assert replay.read_validation(spark, out).first()["peak_score"] == 96
