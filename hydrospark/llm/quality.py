"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic scores.

Statistics of every text are measured once. Cosines of random projections of the standardised
statistics approximate a Gaussian kernel; partitions add up the normal equations of a ridge
regression on them; pooled adjacent violators on held-back labels turn its output into a
probability that never falls as the output grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.blocks import packed, summed
from hydrospark.llm.shared import Words, as_bytes, staged

#: Names of the statistics, all of them 0 for an empty text.
STATISTICS = ("log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digits", "beyond_ascii", "commas_stops",
              "marks", "symbols", "pipes", "distinct_words", "next_repeats", "top_word", "near_repeats", "lines_per_word",
              "repeated_lines", "bare_lines")

_CLASSES = np.zeros(256, dtype=np.int64)
for _k, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,;:", b"!?",
                               b"#*$%&<>@^~=+_\\/{}[]", b"|")):
    _CLASSES[list(_members)] = _k + 1


@dataclass(frozen=True)
class Spec:
    features: int = 256
    width: float = 3.0
    ridge: float = 1e-2
    bins: int = 512
    seed: int = 11
    threshold: float = 0.7


def statistics(known: Words, text: bytes | None) -> list[float]:
    if not text or not (parts := text.split()):
        return [0.0] * len(STATISTICS)
    size, words = len(text), known.of(text)
    n = len(words)
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=8)[1:] / size
    lengths = np.fromiter(map(len, parts), np.int64, n)
    _, times = np.unique(words, return_counts=True)
    lines = [line for line in text.split(b"\n") if line.strip()]
    near = max((float(np.mean(words[k:] == words[:-k])) for k in (2, 3, 4) if n > k), default=0.0)
    return [np.log1p(size), np.log1p(n), np.log(lengths.mean()), lengths.std() / lengths.mean(), *kinds.tolist(),
            len(times) / n ** 0.85, float(np.mean(words[1:] == words[:-1])) if n > 1 else 0.0, times.max() / n, near,
            len(lines) / n, 1 - len(set(lines)) / len(lines),
            sum(not line.rstrip().endswith((b".", b"!", b"?", b":")) for line in lines) / len(lines)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        rows = [statistics(known, text) for text in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["doc_id", "stats"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _measure, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.offsets) * np.sqrt(2 / len(self.offsets))
        return np.hstack([z, np.ones((len(x), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), dtype=np.float64).reshape(len(batch), len(STATISTICS))


def _normal(model, part_name: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, total = model.value, None
        for batch in batches:
            z, y = m.features(_matrix(batch)), batch.column("label").to_numpy()
            own = np.hstack([(z.T @ z).ravel(), z.T @ y])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part_name], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                 pa.array([packed(total)], pa.binary())], names=["name", "part", "counts"])

    return run


def _bins(model, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.value.raw(_matrix(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(edges, raw), pa.int64()), batch.column("label")], names=["bin", "label"])

    return run


def isotonic(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to `values` by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, sizes, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, k2 = blocks.pop()
            v1, w1, k1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.empty(0)


def fit(stats: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", spec: Spec = Spec(),
        id_col: str = "doc_id") -> Model:
    """Fitted on all labelled rows that `learn`, a condition on `id`, lets through.

    A quarter of them, by a hash of the id, is left for the isotonic step. Null labels and ids are
    left out. Without labelled rows every score is 0.5.
    """
    spark, p = stats.sparkSession, len(STATISTICS)
    given = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(learn)
             .groupBy("id").agg(F.max("label").alias("label")))
    rows = staged(stats.join(given, stats["doc_id"] == given["id"]).select(
        "stats", "label", (F.pmod(F.xxhash64("id"), F.lit(4)) == 3).alias("calibrate")), "labelled")
    sums = rows.where("not calibrate").select(*[F.get("stats", F.lit(i)).alias(f"x{i}") for i in range(p)]).agg(
        *[f(f"x{i}") for i in range(p) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = (np.array([v or 0.0 for v in sums[k::2]]) for k in (0, 1))
    random = np.random.default_rng(spec.seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), random.normal(size=(p, spec.features)) / spec.width,
                  random.uniform(0, 2 * np.pi, spec.features), np.zeros(spec.features + 1),
                  np.array([0.0]), np.array([0.5]))
    shared = spark.sparkContext.broadcast(model)
    parts = summed(rows.where("not calibrate").select("stats", "label").mapInArrow(
        _normal(shared), "name int, part int, counts binary"), "normal", np.float64)
    if not parts:
        return model
    d = spec.features + 1
    a, b = parts[0][:d * d].reshape(d, d), parts[0][d * d:]
    penalty = spec.ridge * np.eye(d) * max(1.0, a[-1, -1]) / spec.features
    penalty[-1, -1] = 0.0
    model = Model(model.mean, model.scale, model.directions, model.offsets, np.linalg.solve(a + penalty, b),
                  model.knots, model.levels)
    edges = np.linspace(-0.5, 1.5, spec.bins + 1)
    shared = spark.sparkContext.broadcast(model)
    seen = sorted(rows.where("calibrate").select("stats", "label").mapInArrow(
        _bins(shared, edges), "bin long, label double").groupBy("bin")
        .agg(F.sum("label").alias("y"), F.count("*").alias("n")).collect())
    if not seen:
        return model
    at, y, n = (np.array(c, dtype=np.float64) for c in zip(*seen, strict=True))
    # half a row of either label in each bin keeps the ends off 0 and 1
    level = isotonic((y + 0.25) / (n + 0.5), n)
    knots = -0.5 + (at - 0.5) * 2 / spec.bins
    return Model(model.mean, model.scale, model.directions, model.offsets, model.weights, knots, level)


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return run


def score(stats: DataFrame, model: Model, threshold: float = Spec.threshold) -> DataFrame:
    """(doc_id, score, predicted) of every row of `measure`."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    return stats.mapInArrow(_score(shared, threshold), "doc_id long, score double, predicted int")
