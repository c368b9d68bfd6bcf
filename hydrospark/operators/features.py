"""Feature and training frames for every target gauge in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators import timeseries as ts
from hydrospark.plans.chunks import CHUNK, ROW, chunk_of, chunk_window, numbered, own_rows, with_halo
from hydrospark.schema import PRECIP_METRICS, SOIL_DEEP_METRICS, SOIL_TOP_METRICS, SOURCE_PREFERENCE

STAGE = "self__stage_ft"


@dataclass(frozen=True)
class FrameConfig:
    """What a frame holds. `upstream` names the upstream slots, so the columns are known up front:
    a target without one of them gets nulls there."""

    upstream: Sequence[str] = ()
    lags: Sequence[int] = (1, 3, 6, 12, 24)
    rolls: Sequence[int] = (3, 6, 12, 24, 72)
    upstream_rolls: Sequence[int] = (6, 24)
    precip_rolls: Sequence[int] = (6, 24, 72)
    soil_rolls: Sequence[int] = (24, 72)
    api_decay: float = 0.99
    api_window: int = 336
    horizons: Sequence[int] = (6, 24, 72)
    thresholds: Sequence[float] = ()
    weather: bool = True
    spread_daily: bool = False
    compat_labels: bool = False
    step_s: int = ts.HOUR_S
    chunk_rows: int = ts.CHUNK_ROWS
    dense: bool = False  # the caller's word that no series has a hole, as after hourly_series
    metrics: dict = field(default_factory=lambda: {
        "stage": ["stage_ft"], "precip": PRECIP_METRICS, "soil_top": SOIL_TOP_METRICS,
        "soil_deep": SOIL_DEEP_METRICS})


AGGS = ("mean", "max", "min", "std")


def _block_names(cfg: FrameConfig) -> dict[str, list[str]]:
    lag, delta = [f"lag{k}" for k in cfg.lags], [f"delta{k}" for k in cfg.lags]
    names = {"self": [STAGE] + [f"{STAGE}__{x}" for x in lag]
             + [f"{STAGE}__roll{w}_{a}" for w in cfg.rolls for a in AGGS]
             + [f"{STAGE}__{x}" for x in delta]}
    for up in cfg.upstream:
        base = f"up_{up}__stage_ft"
        names[up] = [f"{base}__{x}" for x in lag] + [
            f"{base}__roll{w}_{a}" for w in cfg.upstream_rolls for a in AGGS]
    if cfg.weather:
        names["precip"] = [f"precip__roll{w}_{a}" for w in cfg.precip_rolls for a in ("sum", "max")]
        names["precip"].append(f"precip__api{cfg.api_window}_d{int(cfg.api_decay * 100)}")
        names["soil_top"] = ["soil_top"] + [
            f"soil_top__roll{w}_{a}" for w in cfg.soil_rolls for a in ("mean", "max")]
        names["soil_deep"] = ["soil_deep"]
    return names


def feature_columns(cfg: FrameConfig) -> list[str]:
    return [c for block in _block_names(cfg).values() for c in block]


def label_columns(cfg: FrameConfig) -> list[str]:
    out = []
    for h in cfg.horizons:
        out += [f"y_future_max_{h}h", f"y_future_rise_{h}h", f"y_future_val_{h}h"]
        out += [f"y_peak_above_{t}_{h}h" for t in cfg.thresholds]
    return out


def hourly_series(history: DataFrame, cfg: FrameConfig, prefer=SOURCE_PREFERENCE,
                  tie: str | None = None) -> DataFrame:
    """Regular series named stage / precip / soil_top / soil_deep per entity."""
    named = ts.first_metric(history, cfg.metrics)
    return ts.regular(named, cfg.step_s, prefer, tie=tie)


def _series_features(series: DataFrame, cfg: FrameConfig) -> DataFrame:
    """Lags, rolling frames and the antecedent index of every series in one window stage.

    Stage, rain and soil share most frames, so all series take one pass and one shuffle; which
    columns a series contributes is decided afterwards.
    """
    pairs = {(w, a) for w in cfg.rolls for a in AGGS}
    if cfg.upstream:
        pairs |= {(w, a) for w in cfg.upstream_rolls for a in AGGS}
    back = max(max(cfg.lags), max(w for w, _ in pairs) - 1)
    size = cfg.chunk_rows
    if cfg.weather:
        pairs |= {(w, a) for w in cfg.precip_rolls for a in ("sum", "max")}
        pairs |= {(w, a) for w in cfg.soil_rolls for a in ("mean", "max")}
        back = max(back, cfg.api_window - 1, max(w for w, _ in pairs) - 1)
        size = ts.antecedent_chunk_rows(cfg.api_decay, back + 1, size)
    size = max(size, back)
    if cfg.dense:
        step, rows = ts.step_of("ts", cfg.step_s), series
    else:
        step, rows = F.col(ROW), numbered(series, ["entity_id", "metric"], "ts", ts.NEIGHBOUR_SPAN_S)
    cut = with_halo(rows, step, size, back, 0)
    w = chunk_window(["entity_id", "metric"], "ts")
    columns = ts.lag_columns(w, "value", cfg.lags, "x") | ts.delta_columns(w, "value", cfg.lags, "x")
    for width, agg in sorted(pairs):
        columns |= ts.rolling_columns(w, "value", [width], [agg], "x")
    if not cfg.weather:
        return own_rows(cut.withColumns(columns))
    local = (step - F.col(CHUNK) * size + back + 1).cast("double")
    running, index = ts.antecedent_columns(w, local, F.col("value"), cfg.api_decay, cfg.api_window)
    return own_rows(cut.withColumns(columns | {"_running": running})
                    .withColumn("x__api", index).drop("_running"))


def _uses(targets: DataFrame, edges: DataFrame | None, cfg: FrameConfig) -> DataFrame:
    """Which series feeds which target, and in what role: entity, metric, target, slot."""
    def use(entity: str, metric: str, slot: str) -> DataFrame:
        return targets.select(F.col(entity).alias("entity_id"), F.lit(metric).alias("metric"),
                              "target_id", F.lit(slot).alias("slot"))

    out = use("target_id", "stage", "self")
    if cfg.upstream and edges is not None:
        out = out.unionByName(edges.select(
            F.col("upstream_id").alias("entity_id"), F.lit("stage").alias("metric"), "target_id",
            F.concat(F.lit("up_"), "slot").alias("slot")))
    if cfg.weather:
        for metric in ("precip", "soil_top", "soil_deep"):
            out = out.unionByName(use("weather_entity", metric, metric))
    return out


def _source(column: str) -> str:
    """The series column a feature column is taken from."""
    if column in (STAGE, "soil_top", "soil_deep"):
        return "value"
    tail = column.rsplit("__", 1)[1]
    return "x__api" if tail.startswith("api") else f"x__{tail}"


def _in_roles(series: DataFrame, uses: DataFrame, cfg: FrameConfig) -> DataFrame:
    """One row per target, hour and feeding series, with that series' feature columns filled."""
    needed = uses.select("entity_id", "metric").distinct()
    rows = series.select("entity_id", "metric", "ts", "value").join(
        needed, ["entity_id", "metric"], "left_semi")
    if cfg.weather and cfg.spread_daily:
        rows = rows.withColumn("value", F.when(
            F.col("metric") == "precip", F.col("value") / 24.0).otherwise(F.col("value")))
    slots = {"self": "self", "precip": "precip", "soil_top": "soil_top", "soil_deep": "soil_deep",
             **{up: f"up_{up}" for up in cfg.upstream}}
    joined = _series_features(rows, cfg).join(uses, ["entity_id", "metric"])
    return joined.select("target_id", "ts", *[
        F.when(F.col("slot") == slots[block], F.col(_source(c))).alias(c)
        for block, columns in _block_names(cfg).items() for c in columns])


def training_frame(series: DataFrame, targets: DataFrame, edges: DataFrame | None = None,
                   cfg: FrameConfig = FrameConfig(), labels: bool = True,
                   dropna_features: bool = False) -> DataFrame:
    """Features and labels, one row per target and hour in which any of its series has data.

    `targets` holds `target_id` and, with weather, `weather_entity`; `edges` holds `target_id`,
    `upstream_id` and `slot`. The series are read once. The rows of all roles meet in one shuffle on
    (target, calendar chunk), which serves the full outer alignment on time and the numbering of the
    hours; the label windows take a second one, by row number.
    """
    columns = feature_columns(cfg)
    ahead = max(cfg.horizons) if labels else 0
    stacked = _in_roles(series, _uses(targets, edges, cfg), cfg)
    if not labels:
        out = stacked.groupBy("target_id", "ts").agg(*[F.max(c).alias(c) for c in columns])
        return out.dropna(subset=columns) if dropna_features else out
    # The hours of a target are those of all its series together, so they have holes and are numbered.
    span = chunk_of("ts", ts.NEIGHBOUR_SPAN_S)
    wide = (stacked.withColumn(CHUNK, span).repartition("target_id", CHUNK)
            .groupBy("target_id", CHUNK, "ts").agg(*[F.max(c).alias(c) for c in columns]))
    rows = numbered(wide, ["target_id"], "ts", ts.NEIGHBOUR_SPAN_S)
    cut = with_halo(rows, F.col(ROW), max(cfg.chunk_rows, ahead), 0, ahead)
    framed = cut.withColumns(ts.future_columns(
        chunk_window(["target_id"], "ts"), STAGE, cfg.horizons, cfg.thresholds, cfg.compat_labels))
    out = own_rows(framed).select("target_id", "ts", *columns, *[f"`{c}`" for c in label_columns(cfg)])
    return out.dropna(subset=columns) if dropna_features else out


def write_frame(frame: DataFrame, path: str) -> None:
    """A folder for each target; rows are clustered by target first, so that each has few files."""
    span = chunk_of("ts", 12 * ts.NEIGHBOUR_SPAN_S)
    (frame.repartition(F.col("target_id"), span).write.mode("overwrite")
     .partitionBy("target_id").parquet(path))


def read_frame(spark: SparkSession, path: str, cfg: FrameConfig) -> DataFrame:
    """A stored frame by its declared types: ids keep their leading zeros."""
    fields = [("ts", "timestamp"), *[(c, "double") for c in feature_columns(cfg)],
              *[(c, "int" if c.startswith("y_peak") else "double") for c in label_columns(cfg)],
              ("target_id", "string")]
    return spark.read.schema(", ".join(f"`{c}` {t}" for c, t in fields)).parquet(path)
