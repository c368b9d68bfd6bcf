"""Walk-forward folds, forecast metrics, naive baselines and publication gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.plans.chunks import (
    chunk_of, edge_chunk, quantile_chunk, running_totals,
)

FOLDS = 5
RISING_FT = 0.5
MIN_ROWS, MIN_RISING = 100, 10
MIN_EVENT_FOLDS = 2
POSITION_SPAN_S = 30 * 86400


def fold_ids(df: DataFrame, keys: Sequence[str] = ("target_id",), ts: str = "ts", k: int = FOLDS,
             span_s: int = POSITION_SPAN_S) -> DataFrame:
    """Expanding walk-forward folds by time order within each key.

    Adds `position`, `n`, `warm_up`, `fold_size`, `fold` (null in the warm-up) and `train_end`: a
    fold trains on positions below its `train_end`. Positions come from chunk counts, so a long key is not one sort task.
    """
    placed = running_totals(df, list(keys), [ts], chunk_of(ts, span_s),
                            {"position": F.lit(1)}, {"n": "position"})
    first = F.greatest(F.lit(10), F.floor(F.col("n") / 5))
    size = F.greatest(F.lit(1), F.floor((F.col("n") - first) / k))
    sized = placed.withColumns({"position": F.col("position") - 1, "warm_up": first,
                                "fold_size": size})
    tested = (F.col("n") > F.col("warm_up") + k) & (F.col("position") >= F.col("warm_up"))
    number = F.floor((F.col("position") - F.col("warm_up")) / F.col("fold_size"))
    return (sized.withColumn("fold", F.when(tested, F.least(number, F.lit(k - 1)).cast("int")))
            .withColumn("train_end", F.col("warm_up") + F.col("fold") * F.col("fold_size")))


def regression_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual",
                       pred: str = "pred") -> DataFrame:
    """n, MAE, RMSE and R² on rows where both values are known."""
    y, p = F.col(actual), F.col(pred)
    ok = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    yt, err = F.when(ok, y), F.when(ok, y - p)
    squares, spread, n = F.sum(err * err), F.var_pop(yt) * F.count(yt), F.count(yt)
    r2 = F.when(spread > 0, 1.0 - squares / spread).otherwise(
        F.when(squares == 0, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(n > 1, r2).alias("r2"))


def ranking_metrics(df: DataFrame, by: Sequence[str], label: str = "actual", score: str = "pred",
                    chunks: int = 64) -> DataFrame:
    """n, ROC area, average precision and positive rate; the first two are null for one class.

    Rows collapse to one per distinct score first. The running counts those metrics need come from
    chunks of the score range, so no task ever sorts all scores of a model.
    """
    by = list(by)
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    known = df.filter(y.isNotNull() & s.isNotNull() & ~F.isnan(y) & ~F.isnan(s))
    steps = known.groupBy(*by, s.alias("_score")).agg(
        F.sum(y).alias("_pos"), F.count("*").alias("_n"))
    cut = quantile_chunk(steps, by, "_score", chunks).withColumn(
        "_part", edge_chunk("_score")).drop("_edges")
    run = running_totals(cut, by, ["_score"], F.col("_part"),
                         {"_cum_pos": F.col("_pos"), "_cum_n": F.col("_n").cast("double")},
                         {"_all_pos": "_cum_pos", "_all_n": "_cum_n"})
    neg = F.col("_n") - F.col("_pos")
    below_neg = F.col("_cum_n") - F.col("_cum_pos") - neg
    # Counted from the highest score down to and including this one.
    top_pos = F.col("_all_pos") - F.col("_cum_pos") + F.col("_pos")
    top_n = F.col("_all_n") - F.col("_cum_n") + F.col("_n")
    all_pos, all_neg = F.max("_all_pos"), F.max("_all_n") - F.max("_all_pos")
    two = (all_pos > 0) & (all_neg > 0)
    return run.groupBy(*by).agg(
        F.max("_all_n").cast("bigint").alias("n"),
        F.when(two, F.sum(F.col("_pos") * (below_neg + neg / 2)) / (all_pos * all_neg)).alias("auc"),
        F.when(two, F.sum(F.col("_pos") * top_pos / top_n) / all_pos).alias("ap"),
        (all_pos / F.max("_all_n")).alias("positive_rate"))


def calibration(df: DataFrame, by: Sequence[str], label: str = "actual", score: str = "pred",
                bins: int = 10) -> DataFrame:
    """Mean prediction and observed frequency per equal-width bin, the last bin closed."""
    at = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).cast("int")
    return df.groupBy(*by, at.alias("bin")).agg(
        F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("observed"),
        F.count("*").alias("n"))


def naive_regression(df: DataFrame, by: Sequence[str], actual: str = "actual",
                     current: str | None = None) -> DataFrame:
    """Mean error of "no change" (rise target) or of persistence (level target) per fold, averaged
    over folds."""
    by = list(by)
    guess = F.lit(0.0) if current is None else F.col(current)
    folds = df.filter(F.col("fold").isNotNull()).groupBy(*by, "fold").agg(
        F.avg(F.abs(F.col(actual) - guess)).alias("_mae"))
    kind = "no-change" if current is None else "persistence"
    return folds.groupBy(*by).agg(F.avg("_mae").alias("baseline_mae"),
                                  F.count("_mae").alias("baseline_folds"),
                                  F.lit(kind).alias("baseline_kind"))


def naive_classification(df: DataFrame, by: Sequence[str], threshold: float | Column,
                         actual: str = "actual", current: str = "current") -> DataFrame:
    """ROC area of "already above" per fold, averaged over the folds that hold both classes.

    The area of a yes/no guess is the mean of its two hit rates, so counts are enough.
    """
    by = list(by)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    y = F.col(actual) == 1
    yes = F.coalesce(F.col(current) >= limit, F.lit(False))
    counts = df.filter(F.col("fold").isNotNull() & F.col(actual).isNotNull()).groupBy(
        *by, "fold").agg(
        F.count_if(y).alias("p"), F.count_if(~y).alias("q"),
        F.count_if(y & yes).alias("hit"), F.count_if(~y & ~yes).alias("calm"))
    area = F.when((F.col("p") > 0) & (F.col("q") > 0),
                  (F.col("hit") / F.col("p") + F.col("calm") / F.col("q")) / 2)
    return counts.withColumn("_auc", area).groupBy(*by).agg(
        F.avg("_auc").alias("baseline_auc"), F.count("_auc").alias("baseline_folds"),
        F.lit("persistence").alias("baseline_kind"))


def rising_regime(df: DataFrame, by: Sequence[str], actual: str = "actual", pred: str = "pred",
                  current: str | None = None, cutoff_ft: float = RISING_FT) -> DataFrame:
    """Model and naive error where the river really rises; null with too few such rows."""
    y = F.col(actual)
    base = F.lit(0.0) if current is None else F.col(current)
    rising = (y - base) >= cutoff_ft
    n, total = F.count_if(rising), F.count("*")
    enough = (total >= MIN_ROWS) & (n >= MIN_RISING)
    return df.groupBy(*by).agg(
        total.alias("n_total"), n.alias("n_rising"),
        F.when(enough, F.avg(F.when(rising, F.abs(y - F.col(pred))))).alias("event_mae"),
        F.when(enough, F.avg(F.when(rising, F.abs(y - base)))).alias("event_baseline_mae"))


def fold_mean(per_fold: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    return per_fold.groupBy(*by).agg(F.avg(metric).alias(f"overall_{metric}"),
                                     F.count("*").alias("n_folds"))


def regression_gate(scored: DataFrame) -> DataFrame:
    """Verdicts from `overall_mae`, `baseline_mae`, `event_mae`, `event_baseline_mae`: the rising
    regime decides where it could be measured, the overall verdict stays beside it."""
    overall = F.col("overall_mae") < F.col("baseline_mae")
    event = F.col("event_mae") < F.col("event_baseline_mae")
    return (scored.withColumn("beats_baseline_overall", overall)
            .withColumn("beats_baseline", F.coalesce(event, overall)))


def classification_gate(scored: DataFrame) -> DataFrame:
    beats = F.col("overall_auc") > F.col("baseline_auc")
    return scored.withColumns({"beats_baseline_overall": beats, "beats_baseline": beats})


SIDECAR = """target_id string, horizon_h int, kind string, target_col string, threshold double,
  feature_cols array<string>, n_train_rows bigint, trained_ts string,
  metrics struct<per_fold: array<struct<n: bigint, mae: double, rmse: double, r2: double, auc: double,
      ap: double, positive_rate: double, fold: int>>,
    overall_mae: double, overall_auc: double, n_folds: int, target_is_rise: boolean,
    baseline: struct<mae: double, auc: double, kind: string, n_folds: int>,
    beats_baseline_overall: boolean, beats_baseline: boolean,
    event: struct<regime: string, cutoff_ft: double, n_rows: bigint, n_total: bigint,
      model_mae: double, baseline_mae: double>>"""


def read_sidecars(spark, path: str) -> DataFrame:
    """Model metadata files; an unreadable file is left out."""
    return (spark.read.schema(SIDECAR + ", _corrupt string")
            .option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").json(path)
            .filter(F.col("_corrupt").isNull() & F.col("kind").isNotNull()).drop("_corrupt"))


def trust(sidecars: DataFrame) -> DataFrame:
    """Whether each model's figures support showing it.

    A classifier needs its events seen in two folds or more, an area that is known and not one half,
    and no loss to the naive rule. `published` asks for both this and the gate.
    """
    m = F.col("metrics")
    events = F.transform(m["per_fold"], lambda f: F.rint(
        F.coalesce(f["positive_rate"], F.lit(0.0)) * F.coalesce(f["n"], F.lit(0))).cast("bigint"))
    positives = F.aggregate(events, F.lit(0).cast("bigint"), lambda a, v: a + v)
    with_events = F.size(F.filter(events, lambda v: v > 0))
    known_auc = F.abs(m["overall_auc"] - 0.5) > 1e-9
    beats = m["beats_baseline"]
    regression = F.coalesce(beats, m["overall_mae"].isNotNull())
    is_class = F.col("kind") == "classification"
    out = sidecars.select(
        "target_id", "kind", "horizon_h", "threshold", "n_train_rows",
        F.coalesce(m["n_folds"], F.size(m["per_fold"])).alias("n_folds"),
        m["overall_mae"].alias("mae"), m["baseline"]["mae"].alias("baseline_mae"),
        m["event"]["model_mae"].alias("event_mae"),
        m["event"]["baseline_mae"].alias("event_baseline_mae"),
        F.when(known_auc, m["overall_auc"]).alias("auc"),
        m["baseline"]["auc"].alias("baseline_auc"), beats.alias("beats_baseline"),
        m["beats_baseline_overall"].alias("beats_baseline_overall"),
        F.when(is_class, positives).alias("positive_events"),
        F.when(is_class, with_events).alias("folds_with_events"),
        regression.alias("_regression"), F.coalesce(known_auc, F.lit(False)).alias("_known"))
    classification = (F.col("_known") & (F.col("folds_with_events") >= MIN_EVENT_FOLDS)
                      & F.coalesce("beats_baseline", F.lit(True)))
    trusted = F.when(F.col("kind") == "classification", classification).otherwise(
        F.col("_regression"))
    return (out.withColumn("trustworthy", trusted)
            .withColumn("published", F.col("trustworthy")
                        & F.coalesce("beats_baseline", F.lit(True)))
            .drop("_regression", "_known"))


def percent(probability: Column | str) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    whole = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * 100).cast("int")
    return F.when(p.isNotNull(), whole)

