"""Boosted trees for many small models at once: one model for each target, task and fold.

Rows lie in blocks of one target and stretch of time, as bins of their features. The trees of all models grow level by level
together: a job sums, for each model and open node, the gradients by feature and bin over the blocks, and each model's
sums meet in one task that picks the best split of its nodes. Only splits reach the driver. A job works out the present
state of a row from the trees so far, so nothing but the blocks has to outlive a lost executor.

Models are taken in batches of at most `MODELS`, which bounds the trees that are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.session import run_dir

MODELS = 512
#: Hours of one block of rows.
BLOCK_H = 8192
#: Stands for the final model, which learns from all rows of its target.
FINAL = -1
_CLASS, _REGRESSION = "classification", "regression"


@dataclass(frozen=True)
class Growth:
    """Rounds, depth, step, bins (one of them for missing values), ridge, and the least weight of a leaf: rows of a
    regression, summed variances of a class."""

    rounds: int = 40
    depth: int = 5
    step: float = 0.1
    bins: int = 64
    ridge: float = 1.0
    least: float = 10.0
    least_class: float = 0.5


@dataclass
class Model:
    """A model's place, its first guess and its trees as complete binary trees by level (feature -1: a leaf)."""

    target: str
    task: int
    fold: int
    kind: str
    cut: int
    base: float
    grows: bool
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    used: int = 0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the first guess and the leaves that rows of bins reach."""
        out = np.full(len(x), self.base)
        for t in range(self.used):
            out += self.value[t, self.nodes(x, t)]
        return out

    def nodes(self, x: np.ndarray, tree: int, levels: int | None = None) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        feature, split = self.feature[tree], self.split[tree]
        depth = (len(feature) + 1).bit_length() - 2 if levels is None else levels
        for _ in range(depth):
            f = feature[at].astype(np.int64)
            down = f >= 0
            if not down.any():
                break
            right = x[rows, np.maximum(f, 0)] > split[at]
            at = np.where(down, 2 * at + 1 + right, at)
        return at


def _rate(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def edges_of(rows: DataFrame, features: int, bins: int) -> dict[str, list[np.ndarray]]:
    """Bin edges by target and feature: even shares of the target's known values."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    found = rows.groupBy("target_id").agg(*[
        F.percentile_approx(F.get("features", F.lit(i)), shares, 1000).alias(f"e{i}") for i in range(features)])
    return {r["target_id"]: [np.unique(np.array([v for v in (r[f"e{i}"] or []) if v == v], float)) for i in range(features)]
            for r in found.collect()}


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of values: 0 where one is missing, else one more than the edges below it."""
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        column = values[:, i]
        out[:, i] = np.where(np.isnan(column), 0, np.searchsorted(e, column, side="left") + 1)
    return out


_BLOCK = "target_id string, part long, task int, ts binary, x binary, current binary, label binary, position binary, fold binary"


_BLOCK_ARROW = pa.schema([("target_id", pa.string()), ("part", pa.int64()), ("task", pa.int32())]
                         + [(c, pa.binary()) for c in ("ts", "x", "current", "label", "position", "fold")])


def blocks(rows: DataFrame, edges: dict, tasks: int) -> DataFrame:
    """Blocks of rows (target_id, ts, features, current, plan), one for each target, stretch and task, written.

    `plan` lists (task, label, position, fold) of the tasks in which the row has a label.
    """
    held = rows.sparkSession.sparkContext.broadcast(edges)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        n, target = table.num_rows, table.column("target_id")[0].as_py()
        x = np.array(table.column("features").to_pylist(), float).reshape(n, -1)
        label, position, fold = np.full((tasks, n), np.nan), np.full((tasks, n), -1, np.int32), np.full((tasks, n), -1, np.int8)
        for i, plan in enumerate(table.column("plan").to_pylist()):
            for p in plan or []:
                label[p["task"], i], position[p["task"], i] = p["label"], p["position"]
                fold[p["task"], i] = -1 if p["fold"] is None else p["fold"]
        current = np.array([np.nan if v is None else v for v in table.column("current").to_pylist()], float)
        at = np.asarray(table.column("ts").cast(pa.int64()), np.int64)
        x, part = binned(x, held.value[target]), table.column("part")[0].as_py()
        return pa.Table.from_pylist([{"target_id": target, "part": part, "task": i, **{
            name: a.tobytes() for name, a in zip(("ts", "x", "current", "label", "position", "fold"),
                                                 (at, x, current, label[i], position[i], fold[i]), strict=True)}}
            for i in range(tasks)], schema=_BLOCK_ARROW)

    part = F.floor(F.unix_timestamp("ts") / (BLOCK_H * 3600)).alias("part")
    path = run_dir(rows.sparkSession, "blocks")
    (rows.select("target_id", part, F.unix_micros("ts").alias("ts"), "features", "current", "plan")
     .groupBy("target_id", "part").applyInArrow(pack, _BLOCK).write.parquet(path))
    return rows.sparkSession.read.schema(_BLOCK).parquet(path)


def _read(batch: pa.RecordBatch, features: int) -> Iterator[tuple]:
    for r in batch.to_pylist():
        at = np.frombuffer(r["ts"], np.int64)
        yield ((r["target_id"], r["task"]), r["part"], at, np.frombuffer(r["x"], np.uint8).reshape(len(at), features),
               np.frombuffer(r["current"]), np.frombuffer(r["label"]), np.frombuffer(r["position"], np.int32), np.frombuffer(r["fold"], np.int8))


def _by_block(models) -> dict[tuple, list]:
    """Numbered models by target and task, with the trees that they have so far."""
    out: dict[tuple, list] = {}
    for i, m in models:
        now = slice(0, m.used + 1)
        out.setdefault((m.target, m.task), []).append((i, replace(m, feature=m.feature[now], split=m.split[now], value=m.value[now])))
    return out


def _learns(model: Model, position: np.ndarray) -> np.ndarray:
    """Rows that a model learns from: labelled ones, of a fold those before its cut."""
    known = position >= 0
    return np.flatnonzero(known if model.fold == FINAL else known & (position < model.cut))


def _sums(m: Model, x: np.ndarray, label: np.ndarray, rows: np.ndarray, bins: int, level: int) -> np.ndarray:
    """Gradients and weights of a model's rows by open node, feature and bin."""
    own, y, features = x[rows], label[rows], x.shape[1]
    margin = m.margins(own)
    if m.kind == _CLASS:
        p = _rate(margin)
        g, h = y - p, p * (1 - p)
    else:
        g, h = y - margin, np.ones(len(y))
    node = m.nodes(own, m.used, level) - ((1 << level) - 1)
    still = node >= 0
    own, g, h, node = own[still], g[still], h[still], node[still]
    cell = ((node[:, None] * features + np.arange(features)) * bins + own).ravel()
    shape = (1 << level, features, bins)
    return np.stack([np.bincount(cell, np.repeat(w, features), np.prod(shape)).reshape(shape) for w in (g, h)])


def _histograms(models, features: int, growth: Growth, level: int, whole: bool):
    """Sums of each model over a block; where the block is `whole`, the only one of its target, its splits at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, _, x, _, label, position, _ in _read(batch, features):
                for number, m in models.value.get(block, ()):
                    rows = _learns(m, position)
                    if not len(rows):
                        continue
                    sums = _sums(m, x, label, rows, growth.bins, level)
                    if whole:
                        yield _split_row(number, sums, growth, m.kind == _CLASS).to_batches()[0]
                    else:
                        yield pa.RecordBatch.from_pydict({"model": pa.array([number], pa.int32()), "part": pa.array([part], pa.int64()),
                                                          "sums": pa.array([sums.tobytes()], pa.binary())})

    return run


def _split_row(number: int, sums: np.ndarray, growth: Growth, is_class: bool) -> pa.Table:
    found = best_splits(sums, growth, growth.least_class if is_class else growth.least)
    keep = np.flatnonzero(found[0] >= 0)
    return pa.table({"model": pa.array([number], pa.int32()), "node": pa.array([keep.tolist()], pa.list_(pa.int32())),
                     **{n: pa.array([v[keep].tolist()], pa.list_(t)) for n, v, t in zip(
                         ("feature", "split", "left", "right"), found, (pa.int32(),) * 2 + (pa.float64(),) * 2, strict=True)}})


_SPLITS = "model int, node array<int>, feature array<int>, split array<int>, left array<double>, right array<double>"


def best_splits(sums: np.ndarray, growth: Growth, least: float) -> tuple[np.ndarray, ...]:
    """Of each node's sums (2, nodes, features, bins): feature (-1: none), split bin, and the leaf values left and right."""
    g, h = np.cumsum(sums, axis=3)
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    right_g, right_h = all_g - g, all_h - h
    value = lambda a, b: a / (b + growth.ridge)
    gain = g * value(g, h) + right_g * value(right_g, right_h) - all_g * value(all_g, all_h)
    gain = np.where((h >= least) & (right_h >= least), gain, -np.inf).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    nodes = np.arange(len(g))
    split = best % g.shape[2]
    feature = best // g.shape[2]
    ok = gain[nodes, best] > 1e-9
    at = (nodes, feature, split)
    return (np.where(ok, feature, -1), split, value(g[at], h[at]) * growth.step, value(right_g[at], right_h[at]) * growth.step)


def _choose(growth: Growth, features: int, level: int, classes: frozenset):
    def run(table: pa.Table) -> pa.Table:
        number, total = table.column("model")[0].as_py(), np.zeros((2, 1 << level, features, growth.bins))
        for data in table.sort_by("part").column("sums").to_pylist():
            total += np.frombuffer(data).reshape(total.shape)
        return _split_row(number, total, growth, number in classes)

    return run


def starts(packed: DataFrame, wanted: Sequence[tuple], growth: Growth, features: int, least: int) -> list[Model]:
    """Models (target, task, fold, kind, cut) with their first guess: the mean label, for a class its log odds.

    One with fewer than `least` rows, or of one class, keeps that guess; one without any row has none.
    """
    of: dict[tuple, list] = {}
    for i, (target, task, fold, _, cut) in enumerate(wanted):
        of.setdefault((target, task), []).append((i, fold, cut))
    asked = packed.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _, _, _, label, position, _ in _read(batch, features):
                out = []
                for i, fold, cut in asked.value.get(block, ()):
                    y = label[(position >= 0) & ((fold == FINAL) | (position < cut))]
                    if len(y):
                        out.append((i, len(y), float(y.sum()), float(y.min()), float(y.max())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out), (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)],
                        names=["model", "n", "total", "low", "high"])

    counted = {r["model"]: r for r in packed.mapInArrow(run, "model int, n long, total double, low double, high double")
               .groupBy("model").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
                                     F.max("high").alias("high")).collect()}
    nodes, out = (2 << growth.depth) - 1, []
    for i, (target, task, fold, kind, cut) in enumerate(wanted):
        seen = counted.get(i)
        base = float("nan") if seen is None else seen["total"] / seen["n"]
        grows = seen is not None and seen["n"] >= least and seen["low"] < seen["high"]
        if kind == _CLASS and seen is not None:
            share = min(max(base, 1e-6), 1 - 1e-6)
            base = float(np.log(share / (1 - share)))
        out.append(Model(target, task, fold, kind, cut, base, grows, *[np.full((growth.rounds, nodes), v, t) for v, t in (
            (-1, np.int16), (0, np.uint8), (0.0, float))]))
    return out


def grow(packed: DataFrame, models: list[Model], growth: Growth, features: int) -> None:
    """Grow the trees of all models, in place."""
    spark = packed.sparkSession
    classes, cores = frozenset(i for i, m in enumerate(models) if m.kind == _CLASS), spark.sparkContext.defaultParallelism
    several = [r["target_id"] for r in packed.select("target_id", "part").distinct().groupBy("target_id").count().filter("count > 1").collect()]
    if packed.rdd.getNumPartitions() < cores:
        packed = packed.repartition(cores)
    packed = packed.persist()
    one, many = packed.filter(~F.col("target_id").isin(several)), packed.filter(F.col("target_id").isin(several))
    try:
        for _ in range(growth.rounds):
            active = [(i, m) for i, m in enumerate(models) if m.grows]
            for level in range(growth.depth):
                if not active:
                    break
                sent, found = spark.sparkContext.broadcast(_by_block(active)), []
                if any(m.target not in several for _, m in active):
                    found += one.mapInArrow(_histograms(sent, features, growth, level, True), _SPLITS).collect()
                if any(m.target in several for _, m in active):
                    found += (many.mapInArrow(_histograms(sent, features, growth, level, False), "model int, part long, sums binary")
                              .groupBy("model").applyInArrow(_choose(growth, features, level, classes), _SPLITS).collect())
                split_any = {r["model"] for r in found if _put(models[r["model"]], r, level)}
                if not level:  # a root that cannot be split adds nothing now or later
                    for i, m in active:
                        m.grows = i in split_any
                active = [(i, m) for i, m in active if i in split_any]
                sent.unpersist()
            for m in models:
                m.used += m.grows
    finally:
        packed.unpersist()


def _put(model: Model, splits, level: int) -> bool:
    """Put the splits of one level into the tree that grows; whether there were any."""
    first, tree, some = (1 << level) - 1, model.used, False
    for node, feature, split, left, right in zip(*(splits[c] for c in ("node", "feature", "split", "left", "right")), strict=True):
        if feature >= 0:
            at, some = first + node, True
            model.feature[tree, at], model.split[tree, at] = feature, split
            model.value[tree, 2 * at + 1], model.value[tree, 2 * at + 2] = left, right
    return some


TESTED = "target_id string, task int, ts timestamp, actual double, pred double, current double, fold int"


def tested(packed: DataFrame, models: list[Model], features: int) -> DataFrame:
    """Every row that a fold tests, with the prediction of that fold's model."""
    sent = packed.sparkSession.sparkContext.broadcast(_by_block((i, m) for i, m in enumerate(models) if m.fold != FINAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, at, x, current, label, _, fold in _read(batch, features):
                for _, m in sent.value.get(block, ()):
                    rows = np.flatnonzero(fold == m.fold)
                    if not len(rows):
                        continue
                    pred = m.margins(x[rows])
                    n, now = len(rows), current[rows]
                    yield pa.RecordBatch.from_pydict({
                        "target_id": [m.target] * n, "task": pa.array([m.task] * n, pa.int32()),
                        "ts": pa.array(at[rows], pa.timestamp("us", "UTC")), "actual": label[rows],
                        "pred": _rate(pred) if m.kind == _CLASS else pred, "current": pa.array(now, mask=np.isnan(now)),
                        "fold": pa.array([m.fold] * n, pa.int32())})

    return packed.mapInArrow(run, TESTED)


SAVED = ("target_id string, task int, kind string, base double, trees int, feature binary, limits binary, value binary, "
         "split binary")


def saved_rows(models: list[Model], edges: dict) -> list[tuple]:
    """Final models with their splits as values: left is missing or at most the threshold."""
    out = []
    for m in models:
        if m.fold != FINAL or m.base != m.base:
            continue
        limit = np.full(m.feature.shape, -np.inf)
        for t, node in zip(*np.nonzero(m.feature >= 0), strict=True):
            e, s = edges[m.target][m.feature[t, node]], m.split[t, node]
            limit[t, node] = -np.inf if s == 0 else e[s - 1] if s <= len(e) else np.inf
        used = slice(0, m.used)
        out.append((m.target, m.task, m.kind, m.base, m.used, m.feature[used].tobytes(), limit[used].tobytes(),
                    m.value[used].tobytes(), m.split[used].tobytes()))
    return out


def scored(rows: DataFrame) -> DataFrame:
    """Rows (target_id, features) joined with saved models, with `pred`; other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred = []
            for r in batch.select(["kind", "base", "trees", "feature", "limits", "value", "features"]).to_pylist():
                trees = r["trees"]
                feature, limit, value = (np.frombuffer(r[c], t).reshape(trees, -1) if trees else np.empty((0, 1)) for c, t in (
                    ("feature", np.int16), ("limits", float), ("value", float)))
                x, total = r["features"], r["base"]
                for t in range(trees):
                    at = 0
                    while (f := feature[t, at]) >= 0:
                        right = x[f] is not None and x[f] == x[f] and x[f] > limit[t, at]
                        at = 2 * at + 1 + int(right)
                    total += value[t, at]
                pred.append(float(_rate(total)) if r["kind"] == _CLASS else total)
            kept = batch.drop_columns(["feature", "limits", "value", "split", "features"])
            yield kept.append_column("pred", pa.array(pred, pa.float64()))

    inner = [f for f in rows.schema.fields if f.name not in ("feature", "limits", "value", "split", "features")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner) + ", pred double"
    return rows.mapInArrow(run, schema)
