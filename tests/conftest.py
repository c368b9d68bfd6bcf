import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from hydrospark.session import local_session

    session = local_session(4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Hourly series from a list of values: `s(values, entity='g', start=...)`."""
    import datetime as dt

    def make(values, entity="g", metric="stage_ft", start="2024-01-01 00:00:00", hours=1):
        first = dt.datetime.fromisoformat(start)
        rows = [("gauge", entity, metric, first + dt.timedelta(hours=hours * i), float(v))
                for i, v in enumerate(values) if v is not None]
        return spark.createDataFrame(
            rows, "entity_type string, entity_id string, metric string, ts timestamp, value double")

    return make


@pytest.fixture
def docs(spark):
    import json

    def make(*payloads, **keys):
        rows = [tuple(keys.values()) + (p if isinstance(p, str) else json.dumps(p),)
                for p in payloads]
        return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys)
                                     + (", " if keys else "") + "value string")

    return make
