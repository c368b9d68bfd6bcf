"""Bounded arrays over a whole corpus: summed counters and bitmaps, reduced in a tree of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.shared import staged

#: Partial arrays that one task of the tree adds up.
FAN_IN = 64


def packed(values: np.ndarray) -> bytes:
    """Bytes of an integer array, equal places of the numbers side by side, compressed."""
    width = values.dtype.itemsize
    plain = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(plain).tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def summed(parts: DataFrame, label: str, dtype=np.int64) -> dict[int, np.ndarray]:
    """Sums of equally long arrays by `name` from rows (name int, part int, counts binary).

    Arrays are added FAN_IN at a time in tasks until one is left for each name, or at most FAN_IN where
    they are not of whole numbers; only those, of a size fixed by the operator, reach the driver.
    """
    rows, left = staged(parts, label), 1 if np.issubdtype(dtype, np.integer) else FAN_IN
    schema = "name int, part int, counts binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpacked(b, dtype) for b in table.column("counts").to_pylist())
        return pa.table({"name": table.column("name").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "counts": pa.array([packed(total)], pa.binary())})

    while (most := rows.groupBy("name").count().agg(F.max("count")).first()[0] or 0) > left:
        groups = -(-most // FAN_IN)
        rows = staged(rows.withColumn("part", F.pmod("part", F.lit(groups)).cast("int"))
                      .groupBy("name", "part").applyInArrow(add, schema), label)
    out: dict[int, np.ndarray] = {}
    for name, counts in rows.select("name", "counts").collect():
        array = unpacked(bytes(counts), dtype)
        out[name] = out[name] + array if name in out else array
    return out


def set_bits(index: np.ndarray, bits: int) -> np.ndarray:
    """A packed bitmap of `bits` bits with the given ones set."""
    flags = np.zeros(bits, dtype=bool)
    flags[index.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def has_bits(bitmap: np.ndarray, index: np.ndarray) -> np.ndarray:
    index = index.astype(np.int64)
    return (bitmap[index >> 3] >> (index & 7).astype(np.uint8)) & 1 > 0


def bitmap_of(keys: DataFrame, bits_log2: int) -> np.ndarray:
    """Bitmap over the leading `bits_log2` bits of a long column `key`, made in tasks by ranges.

    A bounded filter: it may say yes for a key that is absent, never no for one that is present.
    """
    low = max(0, bits_log2 - 17)

    def block(table: pa.Table) -> pa.Table:
        index = table.column("bit").to_numpy()
        return pa.table({"range": table.column("range").slice(0, 1).cast(pa.int64()), "block": pa.array(
            [set_bits(index, 1 << (bits_log2 - low)).tobytes()], pa.binary())})

    bit = F.shiftrightunsigned("key", 64 - bits_log2)
    rows = (keys.select(F.shiftrightunsigned(bit, bits_log2 - low).alias("range"),
                        bit.bitwiseAND(F.lit((1 << (bits_log2 - low)) - 1)).alias("bit")).distinct()
            .groupBy("range").applyInArrow(block, "range long, block binary").collect())
    bitmap = np.zeros(1 << (bits_log2 - 3), dtype=np.uint8)
    size = 1 << (bits_log2 - low - 3)
    for place, data in rows:
        bitmap[place * size:(place + 1) * size] = np.frombuffer(bytes(data), dtype=np.uint8)
    return bitmap


def power_above(n: float, least: int, most: int) -> int:
    """The exponent of the first power of two from n on, within bounds."""
    return int(min(most, max(least, np.ceil(np.log2(max(n, 1))))))


def census_layout(parts: int) -> tuple[int, int]:
    """Ranges and bits (as powers of two) of a census over so many tasks: work for each range stays the same."""
    ranges = power_above(2 * parts, 3, 14)
    return ranges, max(power_above(parts * 2**21, 20, 28), ranges + 3)


def census_rows(points: list[np.ndarray], ranges_log2: int, part: int) -> list[tuple]:
    """(range, part, packed points, which of them several documents have) of the points, distinct in each document."""
    shift = np.uint64(64 - ranges_log2 - 32)
    every, times = np.unique(np.concatenate(points) >> shift, return_counts=True)
    edges = np.searchsorted((every >> np.uint64(32)).astype(np.int64), np.arange((1 << ranges_log2) + 1))
    rest, rows = every.astype(np.uint32), []
    for r in range(1 << ranges_log2):
        s = slice(edges[r], edges[r + 1])
        if s.start < s.stop:
            rows.append((r, part, packed(np.diff(rest[s], prepend=np.uint32(0))), np.packbits(times[s] > 1).tobytes()))
    return rows


def shared_points(census: DataFrame, ranges_log2: int, bits_log2: int) -> np.ndarray:
    """Bitmap of the points that several documents have, from rows (name, counts, several) of `census_rows`.

    A point that two flushes of a task hold may be one document's: the bitmap is a filter that may
    say yes too often, never no for a shared point.
    """
    block = bits_log2 - ranges_log2

    def of_range(table: pa.Table) -> pa.Table:
        once, several = [], []
        for blob, flags in zip(table.column("counts").to_pylist(), table.column("several").to_pylist(), strict=True):
            points = np.cumsum(unpacked(blob, np.uint32), dtype=np.uint32)
            once.append(points)
            several.append(points[np.unpackbits(np.frombuffer(flags, np.uint8), count=len(points)) > 0])
        every = np.sort(np.concatenate(once))
        shared = np.concatenate([every[1:][every[1:] == every[:-1]], *several])
        return pa.table({"range": table.column("name").slice(0, 1), "block": pa.array(
            [set_bits(shared >> np.uint32(32 - block), 1 << block).tobytes()], pa.binary())})

    bitmap, size = np.zeros(1 << (bits_log2 - 3), dtype=np.uint8), 1 << (block - 3)
    for place, data in census.groupBy("name").applyInArrow(of_range, "range int, block binary").collect():
        bitmap[place * size:(place + 1) * size] = np.frombuffer(bytes(data), dtype=np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their leading bits in the bitmap."""
    return has_bits(bitmap, values >> np.uint64(64 - (len(bitmap).bit_length() + 2)))
