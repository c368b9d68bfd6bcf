"""Word hashing and table helpers that the text operators share.

Words are hashed once per distinct word and held in a bounded dictionary; everything after that
(grams, minima, sets) is numpy arithmetic on 64-bit integers, modulo 2**64.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a text that are hashed at a time, and the rest of the word that they end in.
STRIDE = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word, so that minima and leading bits are even."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Hashes of the words of texts, an unsigned 64-bit integer each, by numpy alone.

    A word's hash is a polynomial over random values of its bytes, taken from running sums over the
    text: no word is ever an object of its own. `translation` maps bytes first; bytes that it
    makes white space separate words, and others are white space as for bytes.split.
    """

    def __init__(self, translation: bytes | None = None):
        mapped = np.frombuffer(translation or bytes(range(256)), np.uint8)
        values = np.random.default_rng(0x5EED).integers(0, 2**64, 256, dtype=np.uint64)
        self._value, self._solid = values[mapped], ~np.isin(mapped, [32, 9, 10, 11, 12, 13])
        self._value[~self._solid] = 0
        self._up, self._down = _powers(_MULTIPLIER, 1), _powers(_INVERSE, 1)

    def of(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        if len(text) > STRIDE:
            return np.concatenate([self._hashed(part) for part in self._strides(text)])
        return self._hashed(text)

    def _hashed(self, text: bytes) -> np.ndarray:
        codes = np.frombuffer(text, np.uint8)
        n = len(codes)
        if n >= len(self._up):
            size = 1 << int(n).bit_length()
            self._up, self._down = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)
        solid = np.zeros(n + 2, dtype=bool)
        solid[1:-1] = self._solid[codes]
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._value[codes] * self._up[:n], out=sums[1:])
        return mixed((sums[end] - sums[begin]) * self._down[begin])

    def _strides(self, text: bytes):
        """The text cut at white space, so that a long one needs little memory; a word is never cut."""
        at = 0
        while at < len(text):
            end = min(len(text), at + STRIDE)
            while end < len(text) and self._solid[text[end]]:
                end += 1
            yield text[at:end]
            at = end


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; empty when there are fewer than k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total, power = words[:n].copy(), 1
    for i in range(1, k):
        power = power * _MULTIPLIER % 2**64
        total += words[i:i + n] * np.uint64(power)
    return mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    values = np.sort(values)
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the position of its smallest (the rightmost of equals)."""
    n = len(values) - width + 1
    best, where = values[:n].copy(), np.zeros(n, dtype=np.int64)
    for i in range(1, width):
        other = values[i:i + n]
        lower = other <= best
        best[lower] = other[lower]
        where[lower] = i
    return where + np.arange(n)


def runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + length) over sorted starts, as disjoint (begin, end) arrays."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > length) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new - 1, [len(starts) - 1]))
    return starts[first], starts[last] + length


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is neither installed nor on their path.

    A cluster gets the package with --py-files or installed; this serves runs from a checkout.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH", "") + os.pathsep + os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *[p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]])


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    from hydrospark.session import run_dir

    spark: SparkSession = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
