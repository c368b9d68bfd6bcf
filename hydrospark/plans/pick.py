"""Keep one row, or a few, per key by aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: Sequence[str], *order: Column | str, last: bool = False
             ) -> DataFrame:
    """First (or last) row per key in `order`, as a min-by aggregate with a map-side part."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    rank = F.struct(*order)
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    return (df.groupBy(*keys).agg(pick.alias("_row"))
            .select(*[c if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]))


def top_rows(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str,
             rank: str | None = None) -> DataFrame:
    """At most `k` rows per key. Spark cuts each task to k rows per key before the shuffle, because
    the filter is on a row number, so a hot key costs k rows per task."""
    name = rank or "_rank"
    out = (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
           .filter(F.col(name) <= k))
    return out if rank else out.drop(name)


def preferred(df: DataFrame, keys: Sequence[str], column: str, preference: Sequence[str],
              keep_unlisted: bool = True) -> DataFrame:
    """Rows of the most preferred value of `column` present for each key.

    Unlisted values count only where no listed one exists. The best rank per key is a small partial
    aggregate; the join back is by key with the large side split by the adaptive skew join.
    """
    ranks = F.array(*[F.lit(p) for p in preference])
    at = F.array_position(ranks, F.col(column)).cast("int")
    ranked = df.withColumn("_rank", F.when(at > 0, at).otherwise(len(preference) + 1))
    if not keep_unlisted:
        ranked = ranked.filter(F.col("_rank") <= len(preference))
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    return (ranked.join(best, list(keys)).filter(F.col("_rank") == F.col("_best"))
            .drop("_rank", "_best").select(*df.columns))
