"""Boosted-tree forecasts: one model for each target and task, walk-forward backtest, saved models, latest forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions.stage import level_from_rise
from hydrospark.operators import boosting, evaluation as ev
from hydrospark.operators.features import STAGE
from hydrospark.plans.pick import best_row
from hydrospark.session import checkpoint_root, run_dir

MIN_LABELLED = 10


@dataclass(frozen=True)
class ModelSpec:
    horizon_h: int
    kind: str = "regression"
    threshold: float | None = None
    predict_rise: bool = True
    folds: int = ev.FOLDS
    rounds: int = 40
    depth: int = 5
    step: float = 0.1
    bins: int = 64

    def __post_init__(self):
        if self.kind not in ("regression", "classification"):
            raise ValueError(f"unknown kind: {self.kind}")
        if self.kind == "classification" and self.threshold is None:
            raise ValueError("classification requires a threshold")

    @property
    def target_col(self) -> str:
        if self.kind == "classification":
            return f"y_peak_above_{self.threshold}_{self.horizon_h}h"
        return f"y_future_{'rise' if self.predict_rise else 'max'}_{self.horizon_h}h"

    @property
    def name(self) -> str:
        suffix = "" if self.threshold is None else f"_thr{self.threshold}"
        return f"{self.kind}{suffix}_h{self.horizon_h}"


def feature_names(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns
            if not c.startswith("y_") and c not in ("target_id", "ts")]


BY = ["target_id", "kind", "horizon_h", "threshold"]


def _one(specs: Sequence[ModelSpec], *names: str) -> tuple:
    """The value that all specs share of each field."""
    shared = {tuple(getattr(s, n) for n in names) for s in specs}
    if len(shared) != 1:
        raise ValueError(f"specs that learn together need the same {', '.join(names)}")
    return shared.pop()


def planned(frame: DataFrame, specs: Sequence[ModelSpec]) -> DataFrame:
    """Labelled rows of every task (its place in `specs`) with their walk-forward folds, by target and task.

    (target_id, task, ts, label, current, position, n, warm_up, fold_size, fold, train_end)
    """
    missing = [s.target_col for s in specs if s.target_col not in frame.columns]
    if missing:
        raise KeyError(missing[0])
    current = F.col(STAGE) if STAGE in frame.columns else F.lit(None)
    labels = [F.struct(F.lit(i).alias("task"), F.col(f"`{s.target_col}`").cast("double").alias("label")) for i, s in enumerate(specs)]
    long = (frame.select("target_id", "ts", current.cast("double").alias("current"), F.explode(F.array(*labels)).alias("l"))
            .select("target_id", "ts", "current", "l.*").filter(F.col("label").isNotNull()))
    return ev.fold_ids(long, ("target_id", "task"), k=_one(specs, "folds")[0])


def _spec_table(spark: SparkSession, specs: Sequence[ModelSpec]) -> DataFrame:
    return spark.createDataFrame(
        [(i, s.kind, s.horizon_h, s.threshold, s.target_col, s.kind == "regression" and s.predict_rise) for i, s in enumerate(specs)],
        "task int, kind string, horizon_h int, threshold double, target_col string, target_is_rise boolean")


def described(rows: DataFrame, specs: Sequence[ModelSpec]) -> DataFrame:
    """Rows with a `task` and the kind, horizon_h, threshold, target_col and target_is_rise that it stands for."""
    return rows.join(F.broadcast(_spec_table(rows.sparkSession, specs)), "task").drop("task")


def _rows(frame: DataFrame, specs: Sequence[ModelSpec], names: Sequence[str]) -> tuple[DataFrame, list]:
    """Features with the plan of each row, written; and (target, task, n, warm_up, fold_size) of every pair."""
    spark = frame.sparkSession
    plan = planned(frame, specs)
    path = run_dir(spark, "plan")
    plan.write.parquet(path)
    plan = spark.read.schema(plan.schema).parquet(path)
    sizes = plan.groupBy("target_id", "task").agg(*[F.max(c).alias(c) for c in ("n", "warm_up", "fold_size")]).collect()
    of_row = plan.groupBy("target_id", "ts").agg(
        F.collect_list(F.struct("task", "label", "position", "fold")).alias("plan"), F.max("current").alias("current"))
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features")
    path = run_dir(spark, "rows")
    frame.select("target_id", "ts", features).join(of_row, ["target_id", "ts"]).write.parquet(path)
    return spark.read.parquet(path), sizes


def learn(frame: DataFrame, specs: Sequence[ModelSpec], path: str | None = None, final: bool = True) -> DataFrame:
    """Walk-forward backtest, and the final models of every target and spec, all in one run.

    Returns the tested rows: target_id, kind, horizon_h, threshold, target_is_rise, ts, actual, pred, current, fold. Each
    target learns from its own rows alone, each fold from those before its cut. Where those are of one class or
    fewer than MIN_LABELLED, their mean is predicted, so that every fold's rows stay. Bin edges come from a target's
    whole history of features; labels play no part in them. With a `path`, the final models
    are written below it as a table (`trees`) and as one metadata file each (`meta`).
    """
    spark, specs = frame.sparkSession, list(specs)
    checkpoint_root(spark)
    names = feature_names(frame)
    rounds, depth, step, bins, folds = _one(specs, "rounds", "depth", "step", "bins", "folds")
    growth = boosting.Growth(rounds, depth, step, bins)
    rows, sizes = _rows(frame, specs, names)
    of_target: dict[str, list] = {}
    for r in sizes:
        kind = specs[r["task"]].kind
        cuts = [int(r["warm_up"] + f * r["fold_size"]) for f in range(folds)] if r["n"] > r["warm_up"] + folds else []
        of_target.setdefault(r["target_id"], []).extend(
            [(r["target_id"], r["task"], f, kind, cut) for f, cut in enumerate(cuts)]
            + [(r["target_id"], r["task"], boosting.FINAL, kind, 0)] * final)
    targets, out = sorted(of_target), run_dir(spark, "tested")
    at_once = max(1, boosting.MODELS // (len(specs) * (folds + 1)))
    for at in range(0, len(targets), at_once):
        batch = targets[at:at + at_once]
        own = rows.filter(F.col("target_id").isin(batch))
        edges = boosting.edges_of(own, len(names), bins)
        packed = boosting.blocks(own, edges, len(specs))
        models = boosting.starts(packed, [m for t in batch for m in sorted(of_target[t])], growth, len(names), MIN_LABELLED)
        boosting.grow(packed, models, growth, len(names))
        boosting.tested(packed, models, len(names)).write.mode("append").parquet(out)
        if path:
            trees = spark.createDataFrame(boosting.saved_rows(models, edges), boosting.SAVED).drop("kind")
            described(trees, specs).drop("target_col").write.mode("append" if at else "overwrite").parquet(f"{path}/trees")
    if not targets:
        spark.createDataFrame([], boosting.TESTED).write.parquet(out)
    done = described(spark.read.schema(boosting.TESTED).parquet(out), specs)
    if path:
        counts = spark.createDataFrame([(r["target_id"], r["task"], r["n"]) for r in sizes], "target_id string, task int, n_train_rows long")
        write_metadata(done, described(counts, specs), names, f"{path}/meta")
    return done.select(*BY, "target_is_rise", "ts", "actual", "pred", "current", "fold")


def score_backtest(tested: DataFrame) -> DataFrame:
    """One row per target, kind, horizon and threshold: means over folds, the naive rule on the same folds, the rising
    regime and the verdicts of the gates."""
    by_fold = [*BY, "fold"]
    regression, classes = tested.filter("kind = 'regression'"), tested.filter("kind = 'classification'")
    # a level is compared with the present one, a rise with none
    risen = regression.withColumn("current", F.when(F.col("target_is_rise"), F.lit(0.0)).otherwise(F.col("current")))
    # by the columns of BY, of which the threshold may be null
    mae = ev.fold_mean(ev.regression_metrics(regression, by_fold), BY, "mae")
    auc = ev.fold_mean(ev.ranking_metrics(classes, by_fold), BY, "auc")
    naive = ev.naive_regression(risen, BY, current="current").withColumn(
        "baseline_kind", F.lit(None).cast("string"))
    event = ev.rising_regime(risen, BY, current="current")
    kinds = regression.groupBy(*BY).agg(F.max("target_is_rise").alias("target_is_rise"))
    scored = ev.regression_gate(_beside(_beside(_beside(mae, naive), event), kinds).withColumn(
        "baseline_kind", F.when(F.col("target_is_rise"), "no-change").otherwise("persistence")))
    ranked = ev.classification_gate(_beside(auc, ev.naive_classification(classes, BY, F.col("threshold"))))
    return scored.unionByName(ranked, allowMissingColumns=True)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables by the columns of BY, nulls equal."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in BY})
    same = [left[c].eqNullSafe(renamed[f"_{c}"]) for c in BY]
    return left.join(renamed, same, "left").drop(*[f"_{c}" for c in BY])


def backtest(frame: DataFrame, specs: Sequence[ModelSpec]) -> tuple[DataFrame, DataFrame]:
    """Tested rows of every target and spec, and their scores."""
    tested = learn(frame, specs, final=False)
    return tested, score_backtest(tested)


def backtest_summary(tested: DataFrame) -> DataFrame:
    """Pooled metrics of every target, kind, horizon and threshold over all its tested rows."""
    return (ev.regression_metrics(tested.filter("kind = 'regression'"), BY)
            .unionByName(ev.ranking_metrics(tested.filter("kind = 'classification'"), BY), allowMissingColumns=True))


def metadata(tested: DataFrame) -> DataFrame:
    """The metrics of every model as its metadata file holds them: the columns of BY and `metrics`."""
    by_fold = [*BY, "fold"]
    each = (ev.regression_metrics(tested.filter("kind = 'regression'"), by_fold)
            .unionByName(ev.ranking_metrics(tested.filter("kind = 'classification'"), by_fold), allowMissingColumns=True))
    figures = ["n", "mae", "rmse", "r2", "auc", "ap", "positive_rate"]
    per_fold = each.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("fold", *figures))).alias("per_fold"))
    s = _beside(score_backtest(tested), per_fold)
    event = F.struct(F.lit("rising").alias("regime"), F.lit(ev.RISING_FT).alias("cutoff_ft"), F.col("n_rising").alias("n_rows"),
                     "n_total", F.col("event_mae").alias("model_mae"), F.col("event_baseline_mae").alias("baseline_mae"))
    baseline = F.struct(F.col("baseline_mae").alias("mae"), F.col("baseline_auc").alias("auc"), F.col("baseline_kind").alias("kind"),
                        F.col("baseline_folds").alias("n_folds"))
    return s.select(*BY, F.struct(
        "per_fold", "overall_mae", "overall_auc", "n_folds", "target_is_rise", baseline.alias("baseline"), "beats_baseline_overall",
        "beats_baseline", F.when(F.col("kind") == "regression", event).alias("event")).alias("metrics"))


def write_metadata(tested: DataFrame, models: DataFrame, names: Sequence[str], path: str) -> None:
    """One metadata file for each of the models (the columns of BY, target_col, n_train_rows), which
    `evaluation.read_sidecars` finds; a model without tested rows has no metrics."""
    keys = models.select(*BY, "target_col", "n_train_rows")
    rows = _beside(keys, metadata(tested)).withColumn("feature_cols", F.array(*[F.lit(c) for c in names]))
    name = F.concat_ws("_", "kind", F.concat(F.lit("thr"), F.col("threshold")), F.concat(F.lit("h"), F.col("horizon_h")))
    (rows.withColumns({"trained_ts": F.current_timestamp().cast("string"), "of_target": F.col("target_id"), "model": name})
     .repartition("of_target", "model").write.mode("overwrite").partitionBy("of_target", "model").json(path))


def saved(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The models written below a path, as found there: their metadata and their trees.

    A metadata file that cannot be read is left out, and its model with it.
    """
    return ev.read_sidecars(spark, f"{path}/meta"), spark.read.parquet(f"{path}/trees")


def latest_rows(frame: DataFrame) -> DataFrame:
    """Last row per target that has a current stage."""
    usable = frame.filter(F.col(STAGE).isNotNull())
    return best_row(usable, ["target_id"], "ts", last=True)


def forecast(frame: DataFrame, path: str, published_only: bool = True) -> DataFrame:
    """Forecast of every saved model for its target's latest row.

    A rise is turned into a level on the present stage. A model is shown only if its own metadata say that it is
    trusted and beats its naive rule; without `published_only` all are, and `published` tells.
    """
    sidecars, trees = saved(frame.sparkSession, path)
    columns = sidecars.select(F.explode("feature_cols").alias("c")).distinct().count()
    names = feature_names(frame)
    if columns and columns != len(names):
        raise ValueError(f"the models were trained on {columns} features, the frame has {len(names)}")
    verdict = _beside(sidecars.select(*BY), ev.trust(sidecars).select(*BY, "published"))
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features")
    latest = latest_rows(frame).select("target_id", "ts", F.col(STAGE).cast("double").alias("current_ft"), features)
    rows = boosting.scored(latest.join(trees, "target_id"))
    rise = F.col("target_is_rise")
    out = rows.select(*BY, "ts", "current_ft", F.when(rise, F.col("pred")).alias("predicted_rise_ft"),
                      F.when(rise, level_from_rise("pred", "current_ft")).otherwise(F.col("pred")).alias("prediction"))
    known = verdict.withColumnsRenamed({c: f"_{c}" for c in BY})
    out = out.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BY]).drop(*[f"_{c}" for c in BY])
    return out.filter("published").drop("published") if published_only else out
