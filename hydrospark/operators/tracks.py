"""Storm-track climatology and terrain-aware rainfall scoring, for one site or many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions import storm
from hydrospark.functions.geo import (
    bearing_deg, haversine_mi, inside_ring, ring_distance_mi, ring_proximity,
)
from hydrospark.operators import grid as grids
from hydrospark.plans.chunks import chunk_window, unborrowed, with_neighbours
from hydrospark.plans.spatial import nearest_point, with_fixed_sites, within_sites

Sites = Sequence[dict] | DataFrame
HOME = [{"site_id": "home", "site_lat": dims.HOME_LAT, "site_lon": dims.HOME_LON}]
NEIGHBOUR_SPAN_S = 30 * 86400
# Windward sampling point and default wind for unknown motion.
CREST_LAT, CREST_LON = 35.30, -82.40
DEFAULT_WIND_FROM = 160.0


def fixes_near(tracks: DataFrame, radius_mi: float = dims.DEFAULT_RADIUS_MI,
               sites: Sites = HOME) -> DataFrame:
    """(site, fix) pairs inside the radius, with `distance_mi`.

    Here and below, `sites` is a short fixed list or a table of any length with `site_id`,
    `site_lat` and `site_lon`.
    """
    return within_sites(tracks, sites, radius_mi)


def near(tracks: DataFrame, radius_mi: float = dims.DEFAULT_RADIUS_MI,
         sites: Sites = HOME) -> DataFrame:
    """One row per site, storm and year: closest approach and peaks while inside the radius."""
    inside = fixes_near(tracks, radius_mi, sites)
    return inside.groupBy("site_id", "storm_id", "name", "year").agg(
        F.min("distance_mi").alias("min_dist_mi"),
        F.max("wind_kt").alias("peak_wind_kt"),
        F.min("pres_mb").alias("min_pres_mb"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"),
        F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"))


def climatology(tracks: DataFrame, radius_mi: float = dims.DEFAULT_RADIUS_MI,
                start_year: int = 1950, sites: Sites = HOME) -> DataFrame:
    """Yearly storm rate and Poisson chances per site; a site without storms gets rate 0."""
    recent = tracks.filter(F.col("year") >= start_year)
    span = recent.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    counts = near(recent, radius_mi, sites).groupBy("site_id").agg(
        F.count("*").alias("n_storms"),
        F.count_if(F.col("peak_wind_kt") >= 64).alias("n_hurricanes"))
    if isinstance(sites, DataFrame):
        years = sites.select("site_id").distinct().crossJoin(F.broadcast(span))  # span is one row
    else:
        every = F.explode(F.array(*[F.lit(s["site_id"]) for s in sites])).alias("site_id")
        years = span.select("*", every)  # one row per listed site
    rate = F.col("n_storms") / F.col("n_years")
    return (
        years.join(counts, "site_id", "left")
        .withColumn("n_years", F.col("last_year") - F.col("first_year") + 1)
        .withColumn("n_storms", F.coalesce("n_storms", F.lit(0).cast("bigint")))
        .withColumn("n_hurricanes", F.coalesce("n_hurricanes", F.lit(0).cast("bigint")))
        .withColumn("rate_per_year", rate)
        .withColumn("p_at_least_one", storm.poisson_any("rate_per_year"))
        .withColumn("p_hurricane", storm.poisson_any(F.col("n_hurricanes") / F.col("n_years")))
    )


def seasonal_risk(climo: DataFrame, season: dict | None = dims.SEASON_OUTLOOK,
                  climo_ace: float = dims.SEASON_CLIMO["ace"]) -> DataFrame:
    scale = storm.season_scale(season, climo_ace)
    return (climo.withColumn("seasonal_scale", F.lit(scale))
            .withColumn("seasonal_p_at_least_one",
                        storm.poisson_any(F.col("rate_per_year") * scale)))


def with_motion(tracks: DataFrame, order: Sequence[str] = ("datetime",),
                span_s: int = NEIGHBOUR_SPAN_S) -> DataFrame:
    """Each fix with its neighbours and the bearing across them, clamped at the track's ends; a
    single-fix storm has no motion."""
    cut = with_neighbours(tracks, ["storm_id"], list(order), span_s)
    w = chunk_window(["storm_id"], *order)
    joined = cut.withColumns({
        f"{side}_{c}": fn(c).over(w)
        for side, fn in (("prev", F.lag), ("next", F.lead)) for c in ("lat", "lon")})
    out = unborrowed(joined)
    moved = F.col("prev_lat").isNotNull() | F.col("next_lat").isNotNull()
    motion = bearing_deg(F.coalesce("prev_lat", "lat"), F.coalesce("prev_lon", "lon"),
                         F.coalesce("next_lat", "lat"), F.coalesce("next_lon", "lon"))
    return out.withColumn("motion_deg", F.when(moved, motion))


def _whole_tracks(moving: DataFrame, selected: DataFrame | None, sites: Sites) -> DataFrame:
    """Every fix beside the sites it counts for, with `distance_mi`: all listed sites, or those of a
    table that `selected` names for its storm."""
    if not isinstance(sites, DataFrame):
        return with_fixed_sites(moving, sites)
    pairs = selected.join(sites, "site_id")
    return moving.join(pairs, "storm_id").withColumn(
        "distance_mi", haversine_mi("site_lat", "site_lon", "lat", "lon"))


def closest_fix(tracks: DataFrame, sites: Sites = HOME, order: Sequence[str] = ("datetime",),
                radius_mi: float = dims.DEFAULT_RADIUS_MI) -> DataFrame:
    """Closest fix of every storm to every site, earliest on ties, with the motion there.

    For a table of sites, of the storms that came inside `radius_mi` of them: all pairs of both
    tables would be no answer at scale.
    """
    selected = None
    if isinstance(sites, DataFrame):
        selected = fixes_near(tracks, radius_mi, sites).select("site_id", "storm_id").distinct()
    pairs = _whole_tracks(with_motion(tracks, order), selected, sites)
    return nearest_point(pairs, ["site_id", "storm_id"], [*order, "lat", "lon", "motion_deg"])


def basin_fraction(tracks: DataFrame, ring=dims.BASIN_RING, order: Sequence[str] = ("datetime",)
                   ) -> DataFrame:
    """Share of a storm's consecutive segments whose midpoint lies in the basin."""
    mid = inside_ring((F.col("lat") + F.col("next_lat")) / 2,
                      (F.col("lon") + F.col("next_lon")) / 2, ring)
    return with_motion(tracks, order).groupBy("storm_id").agg(
        F.coalesce(F.avg(F.when(F.col("next_lat").isNotNull(), mid.cast("double"))), F.lit(0.0))
        .alias("track_fraction"))


def terrain_score(tracks: DataFrame, gradients: DataFrame | None = None, *,
                  radius_mi: float = dims.DEFAULT_RADIUS_MI, start_year: int = 1950,
                  sites: Sites = HOME, ring=dims.BASIN_RING,
                  order: Sequence[str] = ("datetime",), crest=(CREST_LAT, CREST_LON)) -> DataFrame:
    """Rainfall score of every storm that came inside the radius, over its whole track.

    One pass: neighbours by chunk, then one aggregate per (site, storm) for the closest fix, the
    peak wind and the basin share. `gradients` are elevation grids (see `grid.gradient`). A site
    names its grid in `site_grid_id`; sites without that column use the grid with the smallest id. A
    grid that was rejected, or given no cell at the crest, lifts nothing: its storms score with 0.
    """
    selected = (fixes_near(tracks.filter(F.col("year") >= start_year), radius_mi, sites)
                .select("site_id", "storm_id").distinct())
    mid = inside_ring((F.col("lat") + F.col("next_lat")) / 2,
                      (F.col("lon") + F.col("next_lon")) / 2, ring)
    pairs = _whole_tracks(with_motion(tracks, order), selected, sites)
    named = "site_grid_id" in pairs.columns
    carried = [*order, "lat", "lon", "motion_deg", "site_lat", "site_lon",
               *(["site_grid_id"] if named else [])]
    at = F.min(F.struct(F.round("distance_mi", 9).alias("min_dist_mi"),
                        *[F.col(c) for c in carried]))
    scored = (
        pairs.groupBy("site_id", "storm_id").agg(
            at.alias("_at"), F.max("wind_kt").cast("double").alias("peak_wind_kt"),
            F.min_by(F.struct("name", "year"), F.struct(*order)).alias("_first"),
            F.coalesce(F.avg(F.when(F.col("next_lat").isNotNull(), mid.cast("double"))),
                       F.lit(0.0)).alias("watershed_track_frac"))
        .join(selected, ["site_id", "storm_id"], "left_semi")
        .select("site_id", "storm_id", "_first.*", "_at.*", "peak_wind_kt", "watershed_track_frac")
        .withColumnsRenamed({"lat": "closest_lat", "lon": "closest_lon"})
        .withColumns({
            "month": F.month(order[0]),
            "decayed_wind_kt": storm.decayed_wind_kt("min_dist_mi", "peak_wind_kt"),
            "orographic_factor": storm.orographic_factor("closest_lon", "closest_lat", "motion_deg",
                                                         "site_lon"),
            "moisture_factor": storm.moisture_factor(
                "closest_lat", F.coalesce("peak_wind_kt", F.lit(25.0)), F.month(order[0]),
                "site_lat"),
            "watershed_proximity": ring_proximity(
                ring_distance_mi("closest_lat", "closest_lon", ring))})
    )
    if gradients is None:
        lifted = scored.withColumn("upslope_w_ms", F.lit(0.0))
    else:
        points = gradients.select("grid_id").distinct().select(
            "grid_id", F.lit(crest[0]).alias("lat"), F.lit(crest[1]).alias("lon"))
        slopes = grids.sample(points, gradients, ["dh_dlat", "dh_dlon"]).select(
            F.col("grid_id").alias("site_grid_id"), "dh_dlat", "dh_dlon")
        if not named:
            # One row, also without any grid, so the join adds a column to every storm.
            only = gradients.agg(F.min("grid_id").alias("site_grid_id"))
            scored = scored.crossJoin(F.broadcast(only))
        lift = storm.upslope_ms(
            "dh_dlat", "dh_dlon", F.lit(crest[0]),
            F.coalesce(F.col("motion_deg") + 180.0, F.lit(DEFAULT_WIND_FROM)), "decayed_wind_kt")
        lifted = (scored.join(slopes, "site_grid_id", "left")
                  .withColumn("upslope_w_ms", F.when(
                      F.col("dh_dlat").isNotNull() & (F.col("decayed_wind_kt") > 5.0), lift)
                      .otherwise(0.0)))
    return lifted.withColumn("rainfall_risk_score", storm.rainfall_score(
        "peak_wind_kt", "min_dist_mi", "orographic_factor", "moisture_factor", "upslope_w_ms",
        "watershed_proximity", "watershed_track_frac")).drop("site_lat", "site_lon", "site_grid_id", "dh_dlat", "dh_dlon")


def whole_tracks_near(tracks: DataFrame, radius_mi: float = dims.DEFAULT_RADIUS_MI,
                      sites: Sites = HOME) -> DataFrame:
    """Every fix of the storms that came inside the radius."""
    ids = fixes_near(tracks, radius_mi, sites).select("storm_id").distinct()
    return tracks.join(ids, "storm_id", "left_semi")
