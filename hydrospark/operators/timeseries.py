"""Regular series, lags, rolling frames and forward labels, for every series of a table at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.plans.chunks import (
    ROW, chunk_of, chunk_window, numbered, own_rows, running_totals, seconds, unborrowed,
    with_halo, with_neighbours,
)
from hydrospark.plans.pick import preferred
from hydrospark.schema import SERIES_KEY, SOURCE_PREFERENCE

HOUR_S = 3600
DAY_S = 86400
CHUNK_ROWS = 2160  # ninety days of hours per task and series
NEIGHBOUR_SPAN_S = 30 * DAY_S


def _bucket(ts: Column | str, step_s: int) -> Column:
    sec = F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_seconds(F.floor(sec / F.lit(step_s)) * step_s)


def step_of(ts: str, step_s: int) -> Column:
    """Whole-number position of a row on the regular grid."""
    return F.floor(seconds(ts) / F.lit(step_s))


def best_source(df: DataFrame, keys: Sequence[str] = SERIES_KEY,
                prefer: Sequence[str] = SOURCE_PREFERENCE) -> DataFrame:
    """Only the single best source present per series; sources are never blended."""
    return preferred(df, keys, "source", prefer)


def first_metric(df: DataFrame, aliases: dict[str, Sequence[str]],
                 keys: Sequence[str] = ("entity_type", "entity_id")) -> DataFrame:
    """Rename metrics to an alias, using per entity the first listed metric that has data."""
    lookup = [(m, a) for a, names in aliases.items() for m in names]
    alias = F.when(F.lit(False), "")
    for m, a in lookup:
        alias = alias.when(F.col("metric") == m, a)
    named = df.withColumn("alias", alias.otherwise(None)).filter(F.col("alias").isNotNull())
    kept = preferred(named, [*keys, "alias"], "metric", [m for m, _ in lookup],
                     keep_unlisted=False)
    return kept.withColumn("metric", F.col("alias")).drop("alias")


def bucket_max(df: DataFrame, step_s: int = HOUR_S, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Maximum per bucket, so that a crest between samples survives."""
    return (df.groupBy(*keys, _bucket("ts", step_s).alias("ts"))
            .agg(F.max("value").alias("value")))


def bucket_mean(df: DataFrame, step_s: int = DAY_S, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    return (df.groupBy(*keys, _bucket("ts", step_s).alias("ts"))
            .agg(F.avg("value").alias("value")))


def bucket_last(df: DataFrame, step_s: int = HOUR_S, keys: Sequence[str] = SERIES_KEY,
                tie: str | None = None) -> DataFrame:
    """Last value per bucket; equal times are settled by `tie`, then by value."""
    rank = F.struct("ts", *([tie] if tie else []), "value")
    return (df.filter(F.col("value").isNotNull())
            .groupBy(*keys, _bucket("ts", step_s).alias("ts"))
            .agg(F.max_by("value", rank).alias("value")))


def fill_forward(df: DataFrame, step_s: int = HOUR_S, keys: Sequence[str] = SERIES_KEY,
                 span_s: int = NEIGHBOUR_SPAN_S) -> DataFrame:
    """One row per step between a series' first and last, each holding the latest value.

    Every observed step expands to the steps before the next observed one: no spine, no join.
    """
    keys = list(keys)
    cut = with_neighbours(df.select(*keys, "ts", "value"), keys, ["ts"], span_s)
    runs = unborrowed(cut.withColumn("_next", F.lead("ts").over(chunk_window(keys, "ts"))))
    start = F.unix_timestamp("ts")
    stop = F.coalesce(F.unix_timestamp("_next") - step_s, start)
    steps = F.sequence(start, stop, F.lit(step_s).cast("bigint"))
    return (runs.select(*keys, F.explode(steps).alias("_s"), "value")
            .select(*keys, F.timestamp_seconds("_s").alias("ts"), "value"))


def regular(df: DataFrame, step_s: int = HOUR_S, prefer: Sequence[str] | None = SOURCE_PREFERENCE,
            keys: Sequence[str] = SERIES_KEY, tie: str | None = None) -> DataFrame:
    """Best source, last value per step, gaps filled: every series of the table in one plan.

    Raw rows are reduced to one row per series, source and step before the source is chosen, so the
    join that chooses it never sees raw rows.
    """
    keys = list(keys)
    if prefer is None:
        return fill_forward(bucket_last(df, step_s, keys, tie), step_s, keys)
    stepped = bucket_last(df, step_s, [*keys, "source"], tie)
    chosen = preferred(stepped, keys, "source", prefer)
    # Sources outside the preference list are blended only where no listed one exists.
    merged = chosen.groupBy(*keys, "ts").agg(
        F.max_by("value", F.struct("source", "value")).alias("value"))
    return fill_forward(merged, step_s, keys)


# ---- frames on a regular series -------------------------------------------------------------

def lag_columns(window, value: str, lags: Sequence[int], name: str) -> dict[str, Column]:
    return {f"{name}__lag{k}": F.lag(value, k).over(window) for k in lags}


def delta_columns(window, value: str, lags: Sequence[int], name: str) -> dict[str, Column]:
    return {f"{name}__delta{k}": F.col(value) - F.lag(value, k).over(window) for k in lags}


AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "sum": F.sum}


def rolling_columns(window, value: str, windows: Sequence[int], aggs: Sequence[str], name: str
                    ) -> dict[str, Column]:
    return {
        f"{name}__roll{w}_{a}": AGGREGATES[a](value).over(window.rowsBetween(-(w - 1), 0))
        for w in windows for a in aggs
    }


def _placed(df: DataFrame, keys, step_s: int, dense: bool) -> tuple[DataFrame, Column]:
    """The rows and their positions: steps of the grid where every step has a row, else row numbers.

    `dense` is the caller's word that no step is missing, as after `fill_forward`; it saves a shuffle.
    """
    if dense:
        return df, step_of("ts", step_s)
    return numbered(df, list(keys), "ts", NEIGHBOUR_SPAN_S), F.col(ROW)


def _framed(df: DataFrame, keys, step_s: int, back: int, ahead: int, chunk_rows: int, dense: bool
            ) -> DataFrame:
    rows, position = _placed(df, keys, step_s, dense)
    return with_halo(rows, position, max(chunk_rows, back, ahead, 1), back, ahead)


def lags(df: DataFrame, ks: Sequence[int], *, keys=SERIES_KEY, step_s: int = HOUR_S,
         name: str = "x", chunk_rows: int = CHUNK_ROWS, dense: bool = False) -> DataFrame:
    w = chunk_window(keys, "ts")
    cut = _framed(df, keys, step_s, max(ks), 0, chunk_rows, dense)
    return own_rows(cut.withColumns(lag_columns(w, "value", ks, name)))


def deltas(df: DataFrame, ks: Sequence[int], *, keys=SERIES_KEY, step_s: int = HOUR_S,
           name: str = "x", chunk_rows: int = CHUNK_ROWS, dense: bool = False) -> DataFrame:
    w = chunk_window(keys, "ts")
    cut = _framed(df, keys, step_s, max(ks), 0, chunk_rows, dense)
    return own_rows(cut.withColumns(delta_columns(w, "value", ks, name)))


def rolling(df: DataFrame, windows: Sequence[int], aggs: Sequence[str] = ("mean", "max", "min", "std"),
            *, keys=SERIES_KEY, step_s: int = HOUR_S, name: str = "x",
            chunk_rows: int = CHUNK_ROWS, dense: bool = False) -> DataFrame:
    """Trailing frames that include the current row; a shorter frame at the head is used as is."""
    w = chunk_window(keys, "ts")
    cut = _framed(df, keys, step_s, max(windows) - 1, 0, chunk_rows, dense)
    return own_rows(cut.withColumns(rolling_columns(w, "value", windows, aggs, name)))


def antecedent_chunk_rows(decay: float, window: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """Chunk length that keeps decay ** -(chunk + window) inside double range."""
    return max(window, min(chunk_rows, int(460.0 / -math.log(decay)) - window))


def antecedent_columns(window_spec, position: Column, value: Column, decay: float, window: int
                       ) -> tuple[Column, Column]:
    """(growing running sum, decayed weighted sum from it) inside one chunk.

    Sum of decay**i * p[t-i] for i < window equals decay**t * (C[t] - C[t-window]) with C the running
    sum of p * decay**-t: two frames of constant cost instead of one frame of `window` terms per row.
    """
    grown = F.coalesce(value, F.lit(0.0)) * F.exp(-position * math.log(decay))
    running = F.sum(grown).over(window_spec.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.lag("_running", window).over(window_spec), F.lit(0.0))
    return running, F.exp(position * math.log(decay)) * (F.col("_running") - earlier)


def antecedent(df: DataFrame, decay: float = 0.85, window: int = 14, *, keys=SERIES_KEY,
               step_s: int = HOUR_S, name: str = "precip", chunk_rows: int = CHUNK_ROWS,
               dense: bool = False) -> DataFrame:
    """Exponentially weighted antecedent sum over `window` steps; missing values count as 0."""
    size = antecedent_chunk_rows(decay, window, chunk_rows)
    rows, step = _placed(df, keys, step_s, dense)
    cut = with_halo(rows, step, size, window - 1, 0)
    w = chunk_window(keys, "ts")
    # Position counted from one window before the chunk start keeps every exponent small.
    local = (step - F.col("_chunk") * size + window).cast("double")
    running, index = antecedent_columns(w, local, F.col("value"), decay, window)
    out = cut.withColumn("_running", running)
    label = f"{name}__api{window}_d{int(decay * 100)}"
    return own_rows(out.withColumn(label, index).drop("_running"))


def future_columns(window, value: str, horizons: Sequence[int], thresholds: Sequence[float] = (),
                   compat: bool = False, full: Column | None = None) -> dict[str, Column]:
    """Forward labels over (t, t+h]. Null in the last h-1 rows, where the frame is not full.

    A missing future maximum gives a missing label; `compat` counts it as "not exceeded" instead.
    """
    out: dict[str, Column] = {}
    for h in horizons:
        reach = F.lead(F.lit(1), h - 1).over(window).isNotNull() if h > 1 else F.lit(True)
        peak = F.when(reach, F.max(value).over(window.rowsBetween(1, h)))
        out[f"y_future_max_{h}h"] = peak
        out[f"y_future_rise_{h}h"] = peak - F.col(value)
        out[f"y_future_val_{h}h"] = F.lead(value, h).over(window)
        for thr in thresholds:
            label = (peak >= F.lit(thr)).cast("int")
            out[f"y_peak_above_{thr}_{h}h"] = F.coalesce(label, F.lit(0)) if compat else label
    return out


def targets(df: DataFrame, horizons: Sequence[int], thresholds: Sequence[float] = (), *,
            value: str = "value", keys=SERIES_KEY, step_s: int = HOUR_S, compat: bool = False,
            chunk_rows: int = CHUNK_ROWS, dense: bool = False) -> DataFrame:
    w = chunk_window(keys, "ts")
    cut = _framed(df, keys, step_s, 0, max(horizons), chunk_rows, dense)
    return own_rows(cut.withColumns(future_columns(w, value, horizons, thresholds, compat)))


# ---- daily and short-run helpers ------------------------------------------------------------

def forward_sum(value: str, days: int, window) -> Column:
    return F.sum(value).over(window.rowsBetween(0, days - 1))


def past_sum(value: str, days: int, window) -> Column:
    return F.sum(value).over(window.rowsBetween(-(days - 1), 0))


def hourly_rate(value: str, window, hours: float = 24.0) -> Column:
    return (F.col(value) - F.lag(value).over(window)) / hours


def largest_total(df: DataFrame, width: int, *, keys, step_s: int = HOUR_S,
                  chunk_rows: int = CHUNK_ROWS, dense: bool = False) -> DataFrame:
    """Largest total over any `width` consecutive rows; the whole sum of a shorter series."""
    keys = list(keys)
    w = chunk_window(keys, "ts")
    cut = _framed(df, keys, step_s, width - 1, 0, max(chunk_rows, width), dense)
    frame = w.rowsBetween(-(width - 1), 0)
    framed = own_rows(cut.withColumns({"_total": F.sum("value").over(frame),
                                       "_rows": F.count(F.lit(1)).over(frame)}))
    full = F.max(F.when(F.col("_rows") == width, F.col("_total")))
    return framed.groupBy(*keys).agg(
        F.coalesce(full, F.sum("value")).alias(f"max_{width}"),
        F.sum("value").alias("total"),
        F.max(F.struct(F.col("value"), (-F.unix_timestamp("ts")).alias("t"))).alias("_peak"),
    ).select(
        *keys, f"max_{width}", "total", F.col("_peak.value").alias("peak_value"),
        F.when(F.col("_peak.value") > 0, F.timestamp_seconds(-F.col("_peak.t"))).alias("peak_ts"))


def cumulative_share(df: DataFrame, *, keys, order: Sequence[str] = ("ts",),
                     span_s: int = NEIGHBOUR_SPAN_S) -> DataFrame:
    """Running sum and its share of the whole, per key."""
    out = running_totals(df, list(keys), list(order), chunk_of(order[0], span_s),
                         {"running": F.col("value")}, {"total": "running"})
    return out.withColumn("share", F.col("running") / F.nullif("total", F.lit(0.0)))


def recent_rate(df: DataFrame, readings: int = 12, *, keys=SERIES_KEY) -> DataFrame:
    """Slope between the ends of the last `readings` rows; null for fewer than two or no elapsed
    time. Each task keeps only its last rows per series before the shuffle."""
    from hydrospark.plans.pick import top_rows

    kept = top_rows(df.select(*keys, "ts", "value"), keys, readings, F.desc("ts"), F.desc("value"))
    ends = kept.groupBy(*keys).agg(
        F.min_by("value", F.struct("ts", "value")).alias("first_value"),
        F.max_by("value", F.struct("ts", "value")).alias("last_value"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    hours = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(3.6e9)
    return ends.withColumn("rate_ft_per_hr", F.when(
        (F.col("n") >= 2) & (hours > 0), (F.col("last_value") - F.col("first_value")) / hours))


def pivot_metric(df: DataFrame, ids: Sequence[str], *, column: str = "entity_id",
                 tie: str | None = None) -> DataFrame:
    """Wide table by time, one column per listed id, last value on ties."""
    rank = F.col(tie) if tie else F.col("value")
    return df.groupBy("ts").pivot(column, list(ids)).agg(F.max_by("value", rank))
