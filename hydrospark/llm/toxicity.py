"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, pairs of neighbours and pairs with one word between them that a text has,
hashed to 2**18 weights. Every coordinate has its own learning rate and L1 keeps most weights at zero, so
that the weights are a small table to broadcast. Shards of the labelled rows are trained side by
side from one state, and the mean of their states starts the next round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.blocks import packed, unpacked
from hydrospark.llm.decontaminate import LETTERS
from hydrospark.llm.shared import Words, as_bytes, grams, mixed, staged

WEIGHTS_LOG2 = 18


@dataclass(frozen=True)
class Spec:
    """Learning parameters; `sample` bounds the labelled rows that are fitted on, `shard` those of a task."""

    sample: int = 16_000
    shard: int = 4_000
    rounds: int = 3
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.01
    threshold: float = 0.7


def features(known: Words, text: bytes | None) -> np.ndarray:
    """Weight indices of a text, with repeats."""
    words = known.of(text)
    apart = mixed(words[:-2] * np.uint64(3) + words[2:] * np.uint64(0x9E3779B97F4A7C15)) if len(words) > 2 else words[:0]
    every = np.concatenate([mixed(words), grams(words, 2), apart])
    return (every >> np.uint64(64 - WEIGHTS_LOG2)).astype(np.int64)


def weights(z: np.ndarray, n: np.ndarray, spec: Spec) -> np.ndarray:
    """The weights that a state stands for: zero up to the L1 bound, none but the bias exempt."""
    l1 = np.full(z.shape, spec.l1)
    if len(z):
        l1[-1] = 0.0
    w = -(z - np.sign(z) * l1) / ((spec.beta + np.sqrt(n)) / spec.alpha + spec.l2)
    w[np.abs(z) <= l1] = 0.0
    return w


def _chosen(z, n, at, spec: Spec) -> np.ndarray:
    """As `weights`, for the given places, of which the last is the bias."""
    return weights(z[at], n[at], spec)


def _train(spec: Spec, started: bool):
    """A shard's state (shard, z, n) after a round, from its rows and the state that it starts from, zero if none."""
    def run(table: pa.Table, start: pa.Table | None = None) -> pa.Table:
        z, n = (unpacked(start.column(c)[0].as_py(), np.float64) for c in "zn") if start else (
            np.zeros((1 << WEIGHTS_LOG2) + 1), np.zeros((1 << WEIGHTS_LOG2) + 1))
        known, rows = Words(LETTERS), []
        for text, label in zip(as_bytes(table.column("text").combine_chunks()), table.column("label").to_pylist(),
                               strict=True):
            rows.append((np.append(np.unique(features(known, text)), 1 << WEIGHTS_LOG2), label))
        order = np.random.default_rng(7)
        for _ in range(spec.epochs):
            for k in order.permutation(len(rows)):
                at, label = rows[k]
                w = _chosen(z, n, at, spec)
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = p - label
                root = np.sqrt(n[at])
                n[at] += g * g
                z[at] += g - (np.sqrt(n[at]) - root) / spec.alpha * w
        return pa.table({"shard": table.column("shard").slice(0, 1), "z": pa.array([packed(z)], pa.binary()),
                         "n": pa.array([packed(n)], pa.binary())})

    return run if started else lambda table: run(table)


def _mean(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.sort_by("shard")
    return tuple(np.mean([unpacked(b, np.float64) for b in table.column(c).to_pylist()], axis=0) for c in "zn")


def _shared(table: pa.Table) -> pa.Table:
    """The mean state, for every shard that has one."""
    z, n = (pa.array([packed(x)] * len(table), pa.binary()) for x in _mean(table))
    return pa.table({"shard": table.column("shard"), "z": z, "n": n})


def _fitted(spec: Spec):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"weights": pa.array([packed(weights(*_mean(table), spec))], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", spec: Spec = Spec(),
        id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights, the bias last. `learn` says on an id which labelled rows may be learnt from.

    At most spec.sample labelled ids are used, those with the smallest hash of the id; their texts
    are whole. Null labels and ids are left out, and of an id's rows one is used. The states of the
    shards go from task to task; only the weights reach the driver.
    """
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(learn)
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(spec.sample))
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(chosen), "id").dropDuplicates(["id"]))
    shards = max(1, -(-chosen.count() // spec.shard))
    rows = staged(texts.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).drop("id"), "labelled")
    schema = "shard long, z binary, n binary"
    states = rows.groupBy("shard").applyInArrow(_train(spec, False), schema)
    for _ in range(spec.rounds - 1):
        start = states.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_shared, schema)
        states = rows.groupBy("shard").cogroup(start.groupBy("shard")).applyInArrow(_train(spec, True), schema)
    model = states.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_fitted(spec), "weights binary").collect()
    return unpacked(bytes(model[0].weights), np.float64) if model else np.zeros((1 << WEIGHTS_LOG2) + 1)


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias = model.value
        w = np.zeros(1 << WEIGHTS_LOG2)
        w[places] = values
        known = Words(LETTERS)
        for batch in batches:
            scores = []
            for text in as_bytes(batch.column(1)):
                at = features(known, text)
                at = np.unique(at[w[at] != 0])
                scores.append(float(1 / (1 + np.exp(-np.clip(w[at].sum() + bias, -35, 35)))))
            score = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), score, pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: np.ndarray, threshold: float = Spec.threshold, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts have the score of no feature."""
    places = np.flatnonzero(model[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((places, model[places], float(model[-1])))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _score(shared, threshold), "doc_id long, score double, predicted int")


def _keep(model, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias = model.value
        w = np.zeros(1 << WEIGHTS_LOG2)
        w[places] = values
        known, limit = Words(LETTERS), np.log(threshold / (1 - threshold))
        for batch in batches:
            keep = []
            for text in as_bytes(batch.column(text_at)):
                at = features(known, text)
                keep.append(bool(w[np.unique(at[w[at] != 0])].sum() + bias < limit))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: np.ndarray, threshold: float = Spec.threshold, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns, in one pass."""
    places = np.flatnonzero(model[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((places, model[places], float(model[-1])))
    return docs.mapInArrow(_keep(shared, threshold, docs.columns.index(text_col)), docs.schema)
