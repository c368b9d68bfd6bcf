"""Radius joins and nearest points without comparing every pair."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.functions.geo import EARTH_RADIUS_MI, haversine_mi
from hydrospark.session import run_dir

HOT_CELL_ROWS = 200_000


def _bands(radius_mi: float) -> tuple[float, float]:
    """Height of a latitude band in degrees, a little over the radius, and the radius in radians."""
    angle = radius_mi / EARTH_RADIUS_MI * (1 + 1e-9) + 1e-12
    return max(math.degrees(angle) * 1.001, 1e-6), angle


def _cells_around(band: Column, height: float) -> Column:
    """How many cells a latitude band is cut into: at least one radius wide at its narrowest."""
    top = F.greatest(F.abs(band * height), F.abs((band + 1) * height))
    narrow = F.cos(F.radians(F.least(top, F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0 / height) * narrow)).cast("int")


def _place_in_band(lon: Column, cells: Column) -> Column:
    return F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * cells)


def radius_join(points: DataFrame, sites: DataFrame, radius_mi: float, *, site_prefix: str = "site_",
                hot_cell_rows: int = HOT_CELL_ROWS, point_lat: str = "lat", point_lon: str = "lon",
                nearest: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """All (point, site) pairs within `radius_mi`, with `distance_mi`.

    Site columns carry `site_prefix`, with coordinates in `{prefix}lat` and `{prefix}lon`. Latitude
    bands a radius high are cut into cells a radius wide, fewer towards the poles, numbered around
    the globe. A site looks in its own band and the two beside it, in the cells that its circle can
    reach there, which may run across the date line or, next to a pole, all around: an equi-join
    replaces the comparison of all pairs. Points of a crowded cell are spread over as many salts as
    the cell holds multiples of `hot_cell_rows`, equal points too, and only the sites next to such
    a cell are copied to match. Rows without coordinates match nothing.

    With `nearest`, just the so many closest points of each site, by distance to six decimals and then by the columns of
    `tie`: see `_closest`, which doesn't make the other pairs.
    """
    if nearest is not None:
        return _closest(points, sites, nearest, radius_mi, tie, (point_lat, point_lon), (f"{site_prefix}lat", f"{site_prefix}lon"))
    height, angle = _bands(radius_mi)
    cell = ["_cy", "_cx"]
    band = F.floor(F.col(point_lat) / height)
    placed = points.withColumn("_cy", band).withColumn(
        "_cx", _place_in_band(F.col(point_lon), _cells_around(F.col("_cy"), height)))
    crowded = (placed.groupBy(*cell).agg(F.count("*").alias("_n"))
               .filter(F.col("_n") > hot_cell_rows)
               .select(*cell, F.ceil(F.col("_n") / hot_cell_rows).cast("int").alias("_salts")))
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1)))
    salted = placed.join(crowded, cell, "left").withColumn("_salt", row.cast("int")).drop("_salts")

    lat, lon = F.col(f"{site_prefix}lat"), F.col(f"{site_prefix}lon")
    polar = F.radians(F.abs(lat)) + angle >= math.pi / 2 - 1e-9
    # Widest difference in longitude between a circle's centre and its rim.
    reach = F.when(~polar, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(angle, math.pi / 2))
                                                    / F.cos(F.radians(lat))))) + 1e-6)
    first = F.floor((lon - F.col("_reach") + 180.0) / 360.0 * F.col("_cells"))
    last = F.floor((lon + F.col("_reach") + 180.0) / 360.0 * F.col("_cells"))
    whole = F.col("_reach").isNull() | (last - first + 1 >= F.col("_cells"))
    looked_in = F.when(whole, F.sequence(F.lit(0).cast("bigint"), F.col("_cells").cast("bigint") - 1)).otherwise(
        F.sequence(first, last))
    around = (
        sites.filter(lat.isNotNull() & lon.isNotNull())
        .withColumn("_cy", F.explode(F.sequence(F.floor(lat / height) - 1, F.floor(lat / height) + 1)))
        .withColumns({"_cells": _cells_around(F.col("_cy"), height), "_reach": reach})
        .withColumn("_cx", F.explode(looked_in))
        .withColumn("_cx", F.pmod("_cx", F.col("_cells")))
        .drop("_cells", "_reach")
        .join(crowded, cell, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    distance = haversine_mi(lat, lon, F.col(point_lat), F.col(point_lon))
    # Spark takes the size of the files behind `around` for its own and would broadcast the copies; and it would merge
    # partitions of few bytes, of which many pairs come. A count stated keeps them apart.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (salted.repartition(tasks, *cell, "_salt").join(
                around.repartition(tasks, *cell, "_salt").hint("merge"), [*cell, "_salt"])
            .withColumn("distance_mi", distance)
            .filter(F.col("distance_mi") <= radius_mi)
            .drop(*cell, "_salt"))


#: Edges of the cells of level n are 180 / 4**n degrees long; about a metre at the finest.
FINEST = 12
LEAF_ROWS = 32
FEW_CELLS = 20_000
#: More than the rounding of distances, which is coarsest next to a site's opposite point.
SLACK_MI = 1e-3


def _balls(points: DataFrame, level: int, lat: str, lon: str) -> DataFrame:
    """The cells of a level that hold points: how many, and a ball around them all."""
    low_lat, high_lat, low_lon, high_lon = (F.col(c) for c in ("_low_lat", "_high_lat", "_low_lon", "_high_lon"))
    boxes = points.groupBy(*[F.shiftright(c, 2 * (FINEST - level)).alias(c) for c in ("_cy", "_cx")]).agg(
        F.count("*").alias("_n"), F.min(lat).alias("_low_lat"), F.max(lat).alias("_high_lat"),
        F.min(lon).alias("_low_lon"), F.max(lon).alias("_high_lon"))
    mid = F.col("_mid_lat")
    outermost = F.greatest(F.abs(low_lat), F.abs(high_lat))
    widest = F.when((outermost > 90.0) | F.isnan(outermost) | (low_lat * high_lat <= 0.0), 1.0).otherwise(
        F.cos(F.radians(F.least(F.abs(low_lat), F.abs(high_lat)))))
    # No point of the box is farther from its middle than this one would be at the widest latitude of the box.
    chord = (F.pow(F.sin(F.radians((high_lat - low_lat) / 2) / 2), F.lit(2.0))
             + F.abs(F.cos(F.radians(mid))) * widest
             * F.pow(F.sin(F.radians(F.least((high_lon - low_lon) / 2, F.lit(180.0))) / 2), F.lit(2.0)))
    return (boxes.withColumns({"_mid_lat": (low_lat + high_lat) / 2, "_mid_lon": (low_lon + high_lon) / 2})
            .withColumn("_ball", F.lit(2 * EARTH_RADIUS_MI) * F.asin(F.sqrt(F.least(F.lit(1.0), chord))))
            .select("_cy", "_cx", "_n", "_mid_lat", "_mid_lon", "_ball"))


def _closest(points: DataFrame, sites: DataFrame, k: int, radius_mi: float, tie: Sequence[str],
             point: tuple[str, str], site: tuple[str, str]) -> DataFrame:
    """The `k` points closest to each site within `radius_mi`.

    Points lie in cells within cells, sixteen in each. From the largest cells down, a site keeps those that may hold one of
    its k closest points: their ball begins before enough other balls have ended to hold k points. So a site, however
    far, meets a number of cells that hardly grows with the points, and points only in the last ones, which are as
    fine as it takes for few points in each. Of points at one position, the k first by `tie` can be wanted; sites at one
    position are answered together.
    """
    spark, (lat, lon) = points.sparkSession, point
    path = run_dir(spark, "nearest")
    first = F.row_number().over(Window.partitionBy(lat, lon).orderBy(*tie) if tie
                                else Window.partitionBy(lat, lon).orderBy(F.lit(0)))
    scale = 4.0 ** FINEST / 180.0
    placed = (points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_first", first)
              .filter(F.col("_first") <= k).drop("_first")
              .withColumns({"_cy": F.floor((F.col(lat) + 90.0) * scale), "_cx": F.floor((F.col(lon) + 180.0) * scale)}))
    placed.write.parquet(f"{path}/points")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/points")

    levels = []
    for level in range(1, FINEST + 1):
        cells = _balls(placed, level, lat, lon)
        cells.write.parquet(f"{path}/level_{level}")
        cells = spark.read.schema(cells.schema).parquet(f"{path}/level_{level}")
        count, most = cells.agg(F.count("*"), F.max("_n")).first()
        levels.append(cells if count <= FEW_CELLS else cells.hint("merge"))
        if (most or 0) <= max(LEAF_ROWS, 2 * k):
            break

    spots = sites.select(*site).dropna(subset=list(site), how="any").distinct()
    found = None
    for cells in levels:
        if found is None:
            found = spots.crossJoin(cells)
        else:
            parent = found.select(*site, F.col("_cy").alias("_py"), F.col("_cx").alias("_px"))
            within = cells.withColumns({"_py": F.shiftright("_cy", 2), "_px": F.shiftright("_cx", 2)})
            found = parent.join(within, ["_py", "_px"]).drop("_py", "_px")
        middle = haversine_mi(*site, "_mid_lat", "_mid_lon")
        found = found.withColumns({"_begins": middle - F.col("_ball") - SLACK_MI, "_ends": middle + F.col("_ball") + SLACK_MI})
        of_site = Window.partitionBy(*site)
        found = (found.filter(F.col("_begins") <= radius_mi)
                 .withColumn("_held", F.sum("_n").over(of_site.orderBy("_ends")))
                 .withColumn("_enough", F.min(F.when(F.col("_held") >= k, F.col("_ends"))).over(of_site))
                 .filter(F.col("_enough").isNull() | (F.col("_begins") <= F.col("_enough")))
                 .select(*site, "_cy", "_cx"))
    leaf = [F.shiftright(c, 2 * (FINEST - len(levels))).alias(c) for c in ("_cy", "_cx")]
    near = (found.join(placed.select(*points.columns, *leaf).hint("merge"), ["_cy", "_cx"])
            .withColumn("distance_mi", haversine_mi(*site, lat, lon)).filter(F.col("distance_mi") <= radius_mi))
    rank = F.row_number().over(Window.partitionBy(*site).orderBy(F.round("distance_mi", 6), *tie))
    best = (near.withColumn("_rank", rank).filter(F.col("_rank") <= k)
            .select(*[F.col(c).alias(f"_{c}") for c in site], *points.columns, "distance_mi"))
    same = (F.col(site[0]) == F.col(f"_{site[0]}")) & (F.col(site[1]) == F.col(f"_{site[1]}"))
    return sites.join(best.hint("merge"), same).select(*points.columns, *sites.columns, "distance_mi")


def nearest_of_sites(points: DataFrame, sites: DataFrame, site_keys: Sequence[str],
                     carry: Sequence[str]) -> DataFrame:
    """The closest point of every site of a table, of any length and however far. Without points there is no row."""
    kept = points.select(*carry, *[c for c in ("lat", "lon") if c not in carry])
    pairs = radius_join(kept, sites, math.pi * EARTH_RADIUS_MI + 1.0, nearest=1, tie=carry)
    return nearest_point(pairs, site_keys, carry)


def with_fixed_sites(points: DataFrame, sites: Sequence[dict], *, point_lat: str = "lat",
                     point_lon: str = "lon") -> DataFrame:
    """Every point beside every site of a short fixed list, with `distance_mi`.

    The list is part of the program (a site, or the forests and their districts), so it is an array
    literal exploded per row: work grows with points only and nothing is shuffled or broadcast.
    """
    if len(sites) > 256:
        raise ValueError("a long site list belongs in a table")
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in sites])
    out = points.withColumn("_site", F.explode(rows))
    out = out.withColumn("distance_mi", haversine_mi(
        F.col("_site.site_lat"), F.col("_site.site_lon"), F.col(point_lat), F.col(point_lon)))
    return out.select(*points.columns, *[F.col(f"_site.{k}").alias(k) for k in sites[0]],
                      "distance_mi")


def nearest_to_fixed_sites(points: DataFrame, sites: Sequence[dict], site_keys: Sequence[str],
                           carry: Sequence[str]) -> DataFrame:
    """The closest point of every site of a short fixed list; ties go to the smallest carried values.

    One running minimum for each site, without groups: Spark sorts its input to group by key for minima of more than a
    number, which would hold every point beside every site in a task's memory.
    """
    places: dict[tuple, list[Column]] = {}
    for site in sites:
        miles = haversine_mi(F.lit(site["site_lat"]), F.lit(site["site_lon"]), "lat", "lon")
        places.setdefault(tuple(site[c] for c in site_keys), []).append(
            F.struct(F.round(miles, 6).alias("distance_mi"), *[F.col(c) for c in carry]))
    best = points.agg(*[F.min(F.least(*rows) if len(rows) > 1 else rows[0]).alias(f"_{i}")
                        for i, rows in enumerate(places.values())])
    rows = best.select(F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(c) for c, v in zip(site_keys, key)], F.col(f"_{i}").alias("_best"))
        for i, key in enumerate(places)])).alias("_site")).select("_site.*").filter(F.col("_best").isNotNull())
    return rows.select(*site_keys, *[F.col(f"_best.{c}").alias(c) for c in carry],
                       F.col("_best.distance_mi").alias("distance_mi"))


def within_sites(points: DataFrame, sites: Sequence[dict] | DataFrame,
                 radius_mi: float | None = None, **kw) -> DataFrame:
    """Pairs inside `radius_mi`, or inside each site's own `site_radius_mi`.

    `sites` is a short fixed list or a table of any length; a table needs `radius_mi`.
    """
    if isinstance(sites, DataFrame):
        if radius_mi is None:
            raise ValueError("a table of sites needs a radius")
        return radius_join(points, sites, radius_mi, **kw)
    limit = F.lit(radius_mi) if radius_mi is not None else F.col("site_radius_mi")
    return with_fixed_sites(points, sites, **kw).filter(F.col("distance_mi") <= limit)


def nearest_point(pairs: DataFrame, site_keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The closest point per site from a table of pairs; ties go to the smallest carried values.

    A min-by aggregate, so each task keeps one row per site before anything is shuffled.
    """
    best = F.min(F.struct(F.round("distance_mi", 6).alias("distance_mi"),
                          *[F.col(c) for c in carry]))
    return (pairs.groupBy(*site_keys).agg(best.alias("_best"))
            .select(*site_keys, *[F.col(f"_best.{c}").alias(c) for c in carry],
                    F.col("_best.distance_mi").alias("distance_mi")))
