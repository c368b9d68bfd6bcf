"""Multi-year history from folders of landed archive payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from hydrospark.operators import store
from hydrospark.sources import documents, water, weather

SITE = {"site_id": r"/([^/]+?)(?:_[^/_]*)?\.json$"}
PLACE = {"entity_type": r"/(point|forest|district)/", "entity_id":
         r"/(?:point|forest|district)/(.+?)(?:_[^/_]*)?\.json$"}


def assemble(spark: SparkSession, daily: str | None = None, instant: str | None = None,
             archive: str | None = None, soil: str | None = None) -> DataFrame:
    """History rows of every given folder. Files are named by site (`03451500_2024.json`) or by
    place (`forest/Pisgah_2024.json`); all sites and places run in one plan."""
    parts = []
    if daily:
        parts.append(water.daily_values(documents.read(spark, daily, **SITE)))
    if instant:
        parts.append(water.hourly_maxima(documents.read(spark, instant, **SITE)))
    if archive:
        parts.append(weather.archive_daily(documents.read(spark, archive, **PLACE)))
    if soil:
        parts.append(weather.soil_daily(documents.read(spark, soil, **PLACE)))
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, path: str, **folders: str) -> list[str]:
    """Assemble and merge into the backfill store; returns the months written."""
    return store.append(assemble(spark, **folders), path)
