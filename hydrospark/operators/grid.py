"""Elevation grids as cell tables: hole filling, gradients, sampling and forced lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.storm import upslope_ms
from hydrospark.plans.chunks import chunk_window, own_rows, with_halo

GRID_DEG = 0.20
LAT_MIN, LON_MIN = 33.5, -84.5
ROWS, COLUMNS = 21, 23
CHUNK_CELLS = 1024


def axes(i: Column, j: Column, lat0: float = LAT_MIN, lon0: float = LON_MIN, deg: float = GRID_DEG
         ) -> tuple[Column, Column]:
    return F.lit(lat0) + i * deg, F.lit(lon0) + j * deg


def fill_holes(cells: DataFrame, max_missing: float = 0.25) -> DataFrame:
    """Missing cells take the mean of the valid ones; a grid with too many holes is rejected.

    The mean is a per-grid aggregate joined back, so a large grid never gathers in one task.
    """
    stats = cells.groupBy("grid_id").agg(
        F.avg("elev").alias("_mean"), F.avg(F.col("elev").isNull().cast("double")).alias("_holes"))
    return (cells.join(stats, "grid_id").filter(F.col("_holes") <= max_missing)
            .withColumn("elev", F.coalesce("elev", "_mean")).drop("_mean", "_holes"))


def complete(cells: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """One row per cell of every grid, with null elevation where no cell was given."""
    spine = (cells.select("grid_id").distinct()
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))))
    return spine.join(cells.select("grid_id", "i", "j", "elev"), ["grid_id", "i", "j"], "left")


def _slope(cells: DataFrame, along: str, across: str, name: str, deg: float, size: int
           ) -> DataFrame:
    keys = ["grid_id", across]
    w = chunk_window(keys, along)
    cut = with_halo(cells, F.col(along).cast("bigint"), size, 1, 1)
    before, after = F.lag("elev").over(w), F.lead("elev").over(w)
    central = (after - before) / (2 * deg)
    forward = (after - F.col("elev")) / deg
    backward = (F.col("elev") - before) / deg
    return own_rows(cut.withColumn(name, F.coalesce(central, forward, backward)))


def gradient(cells: DataFrame, deg: float = GRID_DEG, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """Metres per degree along both axes: central inside, one-sided at the edges."""
    north = _slope(cells, "i", "j", "dh_dlat", deg, chunk_cells)
    return _slope(north, "j", "i", "dh_dlon", deg, chunk_cells)


def sample(points: DataFrame, cells: DataFrame, values: list[str], *, rows: int = ROWS,
           columns: int = COLUMNS, lat0: float = LAT_MIN, lon0: float = LON_MIN,
           deg: float = GRID_DEG) -> DataFrame:
    """Bilinear values at points; null outside the grid. Points carry `grid_id`, `lat`, `lon`.

    Points are first reduced to distinct positions, each position is joined with its four corner
    cells by key, and the weighted sum is a partial aggregate.
    """
    fi, fj = (F.col("lat") - lat0) / deg, (F.col("lon") - lon0) / deg
    edge = 1e-9
    inside = fi.between(-edge, rows - 1 + edge) & fj.between(-edge, columns - 1 + edge)

    def low(f: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 2), (F.ceil(f - edge) - 1).cast("int")))

    at = points.select("grid_id", "lat", "lon").distinct().filter(inside)
    at = at.withColumns({"_i": low(fi, rows), "_j": low(fj, columns)})
    at = at.withColumns({"_fy": fi - F.col("_i"), "_fx": fj - F.col("_j")})
    corner = F.explode(F.array(*[
        F.struct((F.col("_i") + di).alias("i"), (F.col("_j") + dj).alias("j"),
                 ((F.col("_fy") if di else 1 - F.col("_fy"))
                  * (F.col("_fx") if dj else 1 - F.col("_fx"))).alias("w"))
        for di in (0, 1) for dj in (0, 1)]))
    corners = at.select("grid_id", "lat", "lon", corner.alias("_c")).select(
        "grid_id", "lat", "lon", "_c.*")
    found = (corners.join(cells.select("grid_id", "i", "j", *values), ["grid_id", "i", "j"])
             .groupBy("grid_id", "lat", "lon")
             .agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values]))
    return points.join(found, ["grid_id", "lat", "lon"], "left")


def upslope(points: DataFrame, cells: DataFrame, **grid) -> DataFrame:
    """Lift at points that carry `wind_from` and `wind_kt`; `cells` must hold gradients."""
    at = sample(points, cells, ["dh_dlat", "dh_dlon"], **grid)
    return at.withColumn("upslope_ms", upslope_ms("dh_dlat", "dh_dlon", "lat", "wind_from",
                                                  "wind_kt"))
