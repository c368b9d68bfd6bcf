"""Best-track text, active storms and forecast graphics."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions.base import number
from hydrospark.functions.geo import haversine_mi
from hydrospark.schema import TRACK
from hydrospark.sources.documents import parsed

BASINS = "AL|EP|CP"
HEADER = rf"[ \t]*(?:{BASINS})[^,\n]*,[^,\n]*,[^,\n]*,[^,\n]*$"
TRACK_POINTS, CONE_POINTS = 40, 160


def best_tracks(spark: SparkSession, path: str, basin: str = "AL") -> DataFrame:
    """Track table from best-track files.

    The record separator is the start of the next storm of the basin, so one large file is read by
    many tasks, each taking whole storms.
    """
    blocks = spark.read.option("lineSep", f"\n{basin}").text(path)
    whole = F.col("value").rlike(f"^\\s*({BASINS})")
    return parse_best_tracks(blocks.select(
        F.when(whole, F.col("value")).otherwise(F.concat(F.lit(basin), "value")).alias("value")))


def _signed(text: Column, positive: str) -> Column:
    size = F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double")
    return F.when(F.right(text, F.lit(1)) == positive, size).otherwise(-size)


def parse_best_tracks(df: DataFrame) -> DataFrame:
    """Track table from text blocks that hold whole storms.

    A block is cut before every header line, so no ordering between rows is needed. Lines that do
    not parse are dropped.
    """
    storms = df.select(F.explode(F.split("value", f"(?m)^(?={HEADER})")).alias("block"))
    lines = storms.select(F.split("block", r"\r?\n").alias("lines")).select(
        F.split(F.get("lines", F.lit(0)), ",").alias("head"),
        F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    field = F.transform(F.split("line", ","), lambda s: F.trim(s))
    rows = (lines.filter(F.get("head", F.lit(0)).rlike(f"^\\s*({BASINS})"))
            .withColumn("f", field).filter(F.size("f") >= 8))
    at = {n: F.get("f", F.lit(i)) for i, n in enumerate(
        ["date", "time", "record_id", "status", "lat", "lon", "wind", "pres"])}
    wind, pres = at["wind"].try_cast("int"), at["pres"].try_cast("int")
    moment = F.concat(at["date"], at["time"])
    out = rows.select(
        F.trim(F.get("head", F.lit(0))).alias("storm_id"), F.trim(F.get("head", F.lit(1))).alias("name"),
        F.try_to_timestamp(moment, F.lit("yyyyMMddHHmm")).alias("datetime"),
        F.substring(at["date"], 1, 4).try_cast("int").alias("year"), at["record_id"].alias("record_id"),
        at["status"].alias("status"), _signed(at["lat"], "N").alias("lat"),
        _signed(at["lon"], "E").alias("lon"), wind.alias("_w"), pres.alias("_p"))
    return (out.dropna(subset=["datetime", "lat", "lon", "_w", "_p"])
            .withColumn("wind_kt", F.when(F.col("_w") >= 0, F.col("_w")))
            .withColumn("pres_mb", F.when(F.col("_p") > 0, F.col("_p")))
            .select(*TRACK.fieldNames()))


ACTIVE = """activeStorms array<struct<id: string, name: string, binNumber: string, basin: string,
  classification: string, intensity: string, latitudeNumeric: string, latitude: string,
  longitudeNumeric: string, longitude: string, movement: string,
  publicAdvisory: struct<url: string>>>"""


def active_storms(df: DataFrame, lat: float = dims.HOME_LAT, lon: float = dims.HOME_LON
                  ) -> DataFrame:
    """Atlantic storms of the active-storm documents with their distance to a place."""
    keys = [c for c in df.columns if c != "value"]
    s = parsed(df, ACTIVE).select(*keys, F.explode("doc.activeStorms").alias("s")).select(
        *keys, "s.*")
    atlantic = (F.coalesce(F.col("binNumber").startswith("AT"), F.lit(False))
                | F.coalesce(F.lower("basin").startswith("atl"), F.lit(False)))
    out = s.filter(atlantic).select(
        *keys, "id", "name", "classification", number("intensity").alias("intensity_kt"),
        F.coalesce(number("latitudeNumeric"), number("latitude")).alias("lat"),
        F.coalesce(number("longitudeNumeric"), number("longitude")).alias("lon"), "movement",
        F.col("publicAdvisory.url").alias("public_advisory_url"))
    return out.dropna(subset=["lat", "lon"]).withColumn(
        "distance_mi", haversine_mi(F.lit(lat), F.lit(lon), "lat", "lon"))


# ---- forecast track and cone -----------------------------------------------------------------

POINTS = "array<struct<lat: double, lon: double>>"


def unzip_kml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First KML of each archive; an unreadable archive gives a null document."""
    for batch in batches:
        texts = []
        for content in batch["content"]:
            text = None
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".kml")]
                    text = archive.read(names[0]).decode("utf-8", "replace") if names else None
            except zipfile.BadZipFile:
                pass
            texts.append(text)
        yield pd.DataFrame({"path": batch["path"], "value": texts})


def read_graphics(spark: SparkSession, path: str) -> DataFrame:
    """`storm_id`, `product` (TRACK or CONE) and KML text of downloaded archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    docs = files.select("path", "content").mapInPandas(unzip_kml, "path string, value string")
    name = r"([A-Za-z0-9]+)_(TRACK|CONE)"
    return docs.select(F.upper(F.regexp_extract("path", name, 1)).alias("storm_id"),
                       F.regexp_extract("path", name, 2).alias("product"), "value")


def _points(blob: Column) -> Column:
    pairs = F.transform(F.split(F.trim(blob), r"\s+"), lambda t: F.split(t, ","))
    read = F.transform(pairs, lambda p: F.struct(
        F.get(p, F.lit(1)).try_cast("double").alias("lat"),
        F.get(p, F.lit(0)).try_cast("double").alias("lon")))
    return F.filter(read, lambda p: p["lat"].between(-90.0, 90.0) & p["lon"].between(-180.0, 180.0))


def _coordinates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)<coordinates>\s*([^<]+?)\s*</coordinates>"), 1)


def _longest(texts: Column) -> Column:
    lists = F.transform(texts, _points)
    return F.aggregate(lists, F.array().cast(POINTS),
                       lambda best, p: F.when(F.size(p) > F.size(best), p).otherwise(best))


def _placemarks(kml: Column, shape: str) -> Column:
    marks = F.regexp_extract_all(kml, F.lit(r"(?s)<Placemark>(.*?)</Placemark>"), 1)
    shaped = F.filter(marks, lambda m: m.rlike(rf"(?s)<{shape}>.*?</{shape}>"))
    return F.flatten(F.transform(shaped, _coordinates))


def thin(points: Column, limit: int) -> Column:
    """Evenly thinned list of at most `limit` points that keeps the first and the last."""
    step = F.size(points) / F.lit(float(limit))
    kept = F.transform(F.sequence(F.lit(0), F.lit(limit - 2)),
                       lambda i: F.get(points, F.floor(i * step).cast("int")))
    return F.when(F.size(points) <= limit, points).otherwise(
        F.concat(kept, F.array(F.element_at(points, -1))))


def graphics(df: DataFrame, track_points: int = TRACK_POINTS, cone_points: int = CONE_POINTS
             ) -> DataFrame:
    """Point list per document: the longest line of a track, the longest polygon of a cone (or any
    coordinates where the polygon has no placemark)."""
    kml = F.coalesce("value", F.lit(""))
    track = F.col("product") == "TRACK"
    found = df.withColumn("_shape", F.when(track, _longest(_placemarks(kml, "LineString")))
                          .otherwise(_longest(_placemarks(kml, "Polygon"))))
    picked = found.withColumn("_points", F.when(track | (F.size("_shape") > 0), F.col("_shape"))
                              .otherwise(_longest(_coordinates(kml)))).drop("_shape", "value")
    limited = F.when(track, thin(F.col("_points"), track_points)).otherwise(
        thin(F.col("_points"), cone_points))
    return picked.withColumn("points", limited).drop("_points")


def attach_forecasts(storms: DataFrame, shapes: DataFrame, key: str = "id") -> DataFrame:
    """Storms with their forecast track and cone; a missing product is an empty list.

    The lists are far larger than the files they come from, by whose size Spark would broadcast them: a merge join.
    """
    wide = shapes.groupBy(F.col("storm_id").alias("_storm")).agg(
        F.max_by("points", F.when(F.col("product") == "TRACK", F.size("points"))).alias("forecast_track"),
        F.max_by("points", F.when(F.col("product") == "CONE", F.size("points"))).alias("cone"))
    none = F.array().cast(POINTS)
    return (storms.join(wide.hint("merge"), F.upper(F.col(key)) == F.col("_storm"), "left").drop("_storm")
            .withColumns({c: F.coalesce(c, none) for c in ("forecast_track", "cone")}))
