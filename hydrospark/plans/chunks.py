"""Ordered work inside a key, cut into time chunks.

A window partitioned by a series key puts the whole series into one task. Each helper here splits a
series into chunks of its order column and carries just enough across the cut, so that the result
equals the uncut window while a hot series spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
HOME = "_home"
EDGE = "_edge"


def seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def chunk_of(ts: str, span_s: int) -> Column:
    return F.floor(seconds(ts) / F.lit(span_s))


ROW = "_row"


def numbered(df: DataFrame, keys: Sequence[str], ts: str, span_s: int) -> DataFrame:
    """Adds `_row`, the place of a row in its series, counted by calendar chunks.

    Frames count rows, so only this position is right for `with_halo` on a series with holes.
    """
    return running_totals(df, keys, [ts], chunk_of(ts, span_s), {ROW: F.lit(1)})


def with_halo(df: DataFrame, position: Column, size: int, back: int = 0, ahead: int = 0
              ) -> DataFrame:
    """Cut a series whose rows have consecutive whole-number positions into chunks of `size`.

    A row is also copied into every chunk whose rows reach it with a frame of `back` preceding and
    `ahead` following rows. Compute over `chunk_window`, then keep the rows `own_rows` selects.
    Positions with holes between them would copy too few rows: number such a series first.
    """
    home = F.floor(position / F.lit(size))
    if not back and not ahead:
        return df.withColumn(CHUNK, home).withColumn(HOME, F.lit(True))
    first = F.floor((position - ahead) / F.lit(size))
    last = F.floor((position + back) / F.lit(size))
    return (df.withColumn(HOME, home)
            .withColumn(CHUNK, F.explode(F.sequence(first, last)))
            .withColumn(HOME, F.col(HOME) == F.col(CHUNK)))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(HOME).drop(CHUNK, HOME, ROW)


def chunk_window(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], span_s: int
                    ) -> DataFrame:
    """Chunks of an irregular series, each with the last row before it and the first row after it.

    `order[0]` is the time column. Rows borrowed from next door are marked in `_edge`; lag and lead
    by one over `chunk_window` are then exact for the others, which `unborrowed` keeps.
    The borrowed rows come from one partial aggregate per chunk, and the only unchunked window runs
    over chunks, whose number is set by the calendar.
    """
    columns = df.columns
    cut = df.withColumn(CHUNK, chunk_of(order[0], span_s))
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns if c not in order])
    rank = F.struct(*[F.col(c) for c in order])
    ends = cut.groupBy(*keys, CHUNK).agg(
        F.min_by(row, rank).alias("head"), F.max_by(row, rank).alias("tail"))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    borrowed = (
        ends.withColumn("before", F.lag("tail").over(by_chunk))
        .withColumn("after", F.lead("head").over(by_chunk))
        .select(CHUNK, F.explode(F.array("before", "after")).alias("row"))
        .filter(F.col("row").isNotNull())
        .select(*[F.col(f"row.{c}").alias(c) for c in columns], CHUNK, F.lit(True).alias(EDGE))
    )
    return cut.withColumn(EDGE, F.lit(False)).unionByName(borrowed)


def unborrowed(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(EDGE)).drop(CHUNK, EDGE)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   chunk: Column, totals: dict[str, Column], whole: dict[str, str] | None = None
                   ) -> DataFrame:
    """Inclusive running sums per key in `order`, by chunk sums plus sums inside the chunk.

    `chunk` must rise with the order. `totals` maps a new column to the expression it accumulates;
    `whole` maps a new column to the entry of `totals` whose sum over the entire key it holds.
    """
    cut = df.withColumn(CHUNK, chunk)
    for name, expr in totals.items():
        cut = cut.withColumn(f"_v_{name}", expr)
    sums = cut.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, -1)
    entire = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
        *[F.sum(f"_s_{source}").over(entire).alias(name)
          for name, source in (whole or {}).items()])
    within = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = _null_safe_join(cut, offsets, [*keys, CHUNK])
    for name in totals:
        out = out.withColumn(name, F.col(f"_o_{name}") + F.coalesce(
            F.sum(f"_v_{name}").over(within), F.lit(0)))
    return out.drop(CHUNK, *[f"_{p}_{n}" for n in totals for p in "vo"])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    test = None
    for k, r in names.items():
        same = F.col(k).eqNullSafe(F.col(r))
        test = same if test is None else test & same
    return left.join(right, test).drop(*names.values())


def quantile_chunk(df: DataFrame, keys: Sequence[str], value: str, chunks: int = 64) -> DataFrame:
    """Adds `_edges`, at most `chunks` cut points of `value` per key, and joins it back.

    Only the balance of the chunks depends on the approximation, never a result.
    """
    points = F.array(*[F.lit((i + 1) / chunks) for i in range(chunks - 1)])
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, points, 1000).alias("_edges"))
    if not keys:
        return df.crossJoin(F.broadcast(edges))  # one row
    return _null_safe_join(df, edges, keys)


def edge_chunk(value: str) -> Column:
    """Number of cut points below the value, a rising chunk number."""
    return F.size(F.filter("_edges", lambda e: e < F.col(value)))
