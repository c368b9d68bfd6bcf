"""Whitening of embeddings by their leading principal components, found by Jacobi-Davidson.

The covariance is never formed. All that the method asks of it is the product with a few vectors, and that is a Spark
job: every partition of the fit list centres its vectors, multiplies, and hands on one small matrix. The driver holds
the search subspace alone (dimension by at most `Spec.basis` columns). Rayleigh-Ritz on the subspace gives approximate
pairs; for each pair still open the correction equation, projected off the locked and the present vector, is solved by
a few steps of MINRES, all pairs sharing the jobs of their products; the corrections extend the subspace. A pair whose
residual is at the rounding of double precision is locked and projected out of what follows. At the end fresh
products confirm all residuals.

Entries become whole numbers, floor(256 * c). The fit list holds each distinct vector once, so that a group of copies
counts as one; distinct vectors are counted within tasks before the shuffle.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are left out, as are those of
another length than most distinct vectors have (the longer of equally common lengths). There are as many components as asked
for, as dimensions, or as directions with a variance above rounding, whichever is least: an empty table, or one whose
vectors are all equal, gives an empty result. Repeated rows and null ids stay as rows. `deviation` is exact and raises beyond
64 bits. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from hydrospark.llm.shared import staged

EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Spec:
    """Components, and how many more are found so that none above them is missed; the largest subspace and what a restart
    keeps; MINRES steps and outer steps at most; vectors of a block."""

    components: int = 4
    guard: int = 1
    basis: int = 32
    kept: int = 8
    inner: int = 8
    outer: int = 200
    block: int = 4096
    seed: int = 5


@dataclass(frozen=True)
class Components:
    """n vectors of the fit list, their sums by dimension, and the eigenpairs, largest first."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    identity_error: float
    products: int


def whole_numbers(rows: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole, x as longs."""
    off = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~off)
            .select("vec_id", F.transform("v", lambda c: F.floor(c * 256)).alias("x")))


def _blocks(rows_of_block: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_of_block):
                part = batch.column(0).slice(start, rows_of_block)
                x = np.asarray(part.flatten(), np.int64).reshape(-1, length)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()),
                                                  "sums": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))})

    return run


def _reduced(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple, length: int) -> np.ndarray:
    """Sum over all blocks of a small matrix that `part` makes of a block's vectors.

    One matrix for each partition leaves the tasks; of more than 1024 partitions they are added 256 sums at a time first.
    """
    schema = "place int, total binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += part(np.frombuffer(data, np.int64).reshape(-1, length))
        yield pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": [total.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("total").to_pylist())
        return pa.table({"place": table.column("place").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    rows = blocks.select("x").mapInArrow(run, schema)
    if blocks.rdd.getNumPartitions() > 1024:
        rows = rows.groupBy(F.pmod("place", F.lit(256))).applyInArrow(add, schema)
    return sum((np.frombuffer(r.total).reshape(shape) for r in sorted(rows.collect())), np.zeros(shape))


def _orthonormal(columns: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """The columns made orthonormal to each other and to the given bases; those that vanish are left out."""
    out = np.empty((columns.shape[0], 0))
    for c in columns.T:
        size = np.linalg.norm(c)
        if not np.isfinite(size) or size == 0:
            continue
        c = c / size
        for _ in range(2):
            for base in (*against, out):
                c = c - base @ (base.T @ c)
            left = np.linalg.norm(c)
            if left < 1e-10:
                break
            c = c / left
        else:
            out = np.column_stack((out, c))
    return out


def _minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each, all stepped together; `drop` is the wanted reduction."""
    x, v_old, w_old, w = (np.zeros_like(right) for _ in range(4))
    beta = np.linalg.norm(right, axis=0)
    first = np.where(beta > 0, beta, 1)
    v, eta = right / first, beta.copy()
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    for _ in range(steps):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        v_new = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        delta = c * alpha - c_old * s * beta
        rho_1, rho_2, rho_3 = np.hypot(delta, beta_new), s * alpha + c_old * c * beta, s_old * beta
        safe = np.where(rho_1 > 0, rho_1, 1)
        c_old, c, s_old, s = c, delta / safe, s, beta_new / safe
        w_old, w = w, (v - rho_3 * w_old - rho_2 * w) / safe
        x += np.where(rho_1 > 0, c * eta, 0) * w
        eta = -s * eta
        v_old, v, beta = v, v_new / np.where(beta_new > 0, beta_new, 1), beta_new
        if np.all(np.abs(eta) <= drop * first):
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive matrix, their vectors and their residuals, by products alone."""
    wanted, random = min(spec.components + spec.guard, size), np.random.default_rng(spec.seed)
    locked, scale = np.empty((size, 0)), 0.0
    basis = _orthonormal(random.standard_normal((size, min(size, 2 * wanted))), [])
    image = product(basis)
    for outer in range(spec.outer):
        theta, turn = _ritz(basis, image)
        basis, image = basis @ turn, image @ turn
        scale = max(scale, theta.max(initial=0.0))
        limit = max(size, 16) * EPS * scale
        rest = image - theta * basis
        rest -= locked @ (locked.T @ rest)
        whole = basis.shape[1] + locked.shape[1] >= size
        good = (np.linalg.norm(rest, axis=0) <= limit) | whole
        done = min(int(np.argmin(np.append(good, False))), wanted - locked.shape[1])
        locked = np.hstack((locked, basis[:, :done]))
        basis, image, theta, rest = basis[:, done:], image[:, done:], theta[done:], rest[:, done:]
        if locked.shape[1] == wanted:
            locked = _orthonormal(locked, [])
            fresh = product(locked)
            values, turn = _ritz(locked, fresh)
            locked, fresh = locked @ turn, fresh @ turn
            residuals = np.linalg.norm(fresh - values * locked, axis=0)
            if residuals.max(initial=0.0) <= 4 * limit:
                return values[:spec.components], locked[:, :spec.components], residuals[:spec.components]
            basis, locked = _orthonormal(np.hstack((locked, basis[:, :spec.kept])), []), np.empty((size, 0))
            image = product(basis)
            continue
        targets = min(wanted - locked.shape[1], basis.shape[1])
        held, shift = basis[:, :targets], theta[:targets]

        def off(t: np.ndarray) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - held * (held * t).sum(axis=0)

        new = np.empty((size, 0))
        if targets:
            step = _minres(lambda t: off(product(off(t)) - shift * off(t)), -rest[:, :targets], spec.inner, max(0.5 ** (outer + 1), 1e-3))
            if basis.shape[1] + targets > spec.basis:
                few = max(spec.kept, targets)
                basis, image = basis[:, :few], image[:, :few]
            new = _orthonormal(off(step), [locked, basis])
        if not new.shape[1]:
            new = _orthonormal(random.standard_normal((size, 1)), [locked, basis])
        basis, image = np.hstack((basis, new)), np.hstack((image, product(new)))
    raise ArithmeticError(f"no convergence in {spec.outer} steps")


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the matrix on a subspace, largest first, and their vectors in it."""
    inner = basis.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], turn[:, ::-1]


def _fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Every distinct vector of the length that most have, and that length (0: no vectors)."""
    every = staged(rows.select("x").distinct(), "vectors")
    top = every.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = top.length if top else 0
    return every.filter(F.size("x") == length), length


def components(rows: DataFrame, spec: Spec = Spec()) -> Components | None:
    """Leading principal components of the distinct vectors in (vec_id, x); nothing where no direction has a variance."""
    fit, length = _fit_list(rows)
    if not length:
        return None
    blocks = staged(fit.mapInArrow(_blocks(spec.block, length), "n long, x binary, sums array<long>"), "blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    by_place = blocks.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s"))
    sums = [r.s for r in by_place.orderBy("place").collect()]
    mean = np.array([s / n for s in sums])
    held, used = blocks.select("x").persist(StorageLevel.MEMORY_AND_DISK), [0]

    def product(columns: np.ndarray) -> np.ndarray:
        used[0] += 1

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ columns)

        return _reduced(held, part, columns.shape, length) / n

    def squares(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return np.array([(centred * centred).sum()])

    try:
        trace = float(_reduced(held, squares, (1,), length)[0]) / n
        if trace <= 0:
            return None
        values, vectors, residuals = jacobi_davidson(product, length, spec)
        some = values > max(length, 16) * EPS * values[0]
        values, vectors, residuals = values[some], vectors[:, some], residuals[some]
        white = vectors / np.sqrt(values)
        middle = _reduced(held, lambda x: ((x - mean) @ white).sum(axis=0), values.shape, length) / n

        def spread(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ white - middle
            return z.T @ z

        off = _reduced(held, spread, (len(values), len(values)), length) / n - np.eye(len(values))
    finally:
        held.unpersist()
    return Components(n, sums, trace, values, vectors, residuals, float(np.abs(off).max()), used[0])


def whitened(table: DataFrame, spec: Spec = Spec(), vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(table, vector, vec_id)
    found = components(rows, spec)
    if found is None:
        return rows.select("vec_id", F.lit(0).alias("component"), *[F.lit(0).cast(kind).alias(name) for name, kind in (
            ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).limit(0)
    n, length = F.lit(found.n).cast("long"), len(found.sums)
    sums = F.lit(np.array(found.sums, np.int64))
    mean = F.lit(np.array([s / found.n for s in found.sums]))
    deviation = F.aggregate(F.zip_with("x", sums, lambda x, s: (n * x - s) * (n * x - s)), F.lit(0).cast("long"), lambda a, b: a + b)
    parts = [F.struct(F.lit(i + 1).alias("component"), (F.aggregate(
        F.zip_with("c", F.lit(found.vectors[:, i].copy()), lambda c, u: c * u), F.lit(0.0), lambda a, b: a + b)
        / F.lit(float(np.sqrt(e)))).alias("whitened"), F.lit(float(e / found.trace)).alias("explained")) for i, e in enumerate(found.values)]
    return (rows.filter(F.size("x") == length)
            .select("vec_id", n.alias("n"), deviation.alias("deviation"), F.zip_with("x", mean, lambda x, m: x - m).alias("c"))
            .select("vec_id", "n", "deviation", F.explode(F.array(*parts)).alias("p"))
            .select("vec_id", "p.component", "n", "deviation", "p.whitened", "p.explained",
                    F.lit(found.identity_error).alias("identity_error")))
