"""The long-form history store: month-partitioned Parquet, idempotent appends, targeted deletes.

A month's folder holds one folder for each append, `append_no=N`. Appends get even numbers and add files alone; a full
rewrite of a month (a re-pull, a delete, a compaction) gets an odd one and supersedes all numbers below it.
Everything is written beside the store first and then moved in by renaming one folder a month, so that readers see a
month before or after a change and never between, and a job that fails loses nothing. Reading keeps the last append's row of
a key; months of a single append need no such step. One job may write to a store at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from hydrospark.plans.pick import best_row
from hydrospark.schema import HISTORY, HISTORY_COLS, HISTORY_KEY

MONTH = "year_month"
APPEND = "append_no"
STORED = StructType([*HISTORY.fields, StructField(MONTH, StringType())])
_FILES = StructType([*STORED.fields, StructField(APPEND, LongType())])
SEQ = "_seq"


def month_of(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


def normalise(df: DataFrame) -> DataFrame:
    """Long rows with UTC times and usable values; everything else is dropped."""
    value = F.col("value").try_cast("double")
    return (df.withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("value", F.when(~F.isnan(value), value))
            .dropna(subset=["ts", "value"]))


def keep_last(df: DataFrame, seq: str = SEQ) -> DataFrame:
    """One row per key, the latest by `seq` and then by value. A max-by aggregate: no window, and
    repeated copies of one key collapse before the shuffle."""
    kept = best_row(df.select(*HISTORY_COLS, seq), HISTORY_KEY, seq, "value", last=True)
    return kept.drop(seq)


def _place(spark: SparkSession, path: str):
    """The file system of a folder, and the folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Value and path of the folders `column=value` below a folder, none where it does not exist."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return {}
    names = [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()]
    return {n.split("=", 1)[1]: f"{path}/{n}" for n in sorted(names) if n.startswith(f"{column}=")}


def _appends(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The numbers of each month that are in force, from the folders' names alone."""
    out = {}
    for month, folder in _folders(spark, path, MONTH).items():
        numbers = sorted(int(n) for n in _folders(spark, folder, APPEND))
        whole = max((n for n in numbers if n % 2), default=-1)
        if numbers:
            out[month] = [n for n in numbers if n >= whole]
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORED)


def _read(spark: SparkSession, path: str, appends: dict[str, list[int]]) -> list[DataFrame]:
    def of(months: list[str]) -> DataFrame:
        folders = [f"{path}/{MONTH}={m}/{APPEND}={n}" for m in months for n in appends[m]]
        return spark.read.schema(_FILES).option("basePath", path).parquet(*folders)

    single, several = ([m for m in appends if (len(appends[m]) > 1) == more] for more in (False, True))
    parts = [of(single).drop(APPEND)] if single else []
    if several:
        last = best_row(of(several), [*HISTORY_KEY, MONTH], APPEND, "value", last=True)
        parts.append(last.select(*HISTORY_COLS, MONTH))
    return parts


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """One logical table over any number of store folders; missing folders count as empty."""
    parts = [part for p in paths for part in _read(spark, p, _appends(spark, p))]
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark)


def partitions(spark: SparkSession, *paths: str) -> DataFrame:
    """Months present, from the folders' names; no data file is opened."""
    months = sorted({m for p in paths for m in _appends(spark, p)})
    return spark.createDataFrame([(m,) for m in months], f"{MONTH} string")


def in_range(df: DataFrame, start: str | None = None, end: str | None = None, **equal: str
             ) -> DataFrame:
    """Inclusive UTC time range and equality on any key column.

    The month bound is stated as well as the time bound, because the time column alone does not
    prune partition folders.
    """
    if start is not None:
        lower = F.lit(start).cast("timestamp")
        df = df.filter(F.col("ts") >= lower)
        if MONTH in df.columns:
            df = df.filter(F.col(MONTH) >= F.date_format(lower, "yyyy-MM"))
    if end is not None:
        upper = F.lit(end).cast("timestamp")
        df = df.filter(F.col("ts") <= upper)
        if MONTH in df.columns:
            df = df.filter(F.col(MONTH) <= F.date_format(upper, "yyyy-MM"))
    for name, wanted in equal.items():
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    return df


def load(spark: SparkSession, *paths: str, start: str | None = None, end: str | None = None,
         **equal: str) -> DataFrame:
    return in_range(read(spark, *paths), start, end, **equal).select(*HISTORY_COLS)


#: A task keeps so many months open and needs no sort by month; beyond them Spark sorts.
WRITERS = 100


@contextmanager
def _open_months(spark: SparkSession) -> Iterator[None]:
    """Let tasks write several months side by side, so that the order of their rows is left as it is."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(WRITERS))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _adaptive(df: DataFrame) -> bool:
    return df.sparkSession.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows dealt by month and sorted by series and time.

    Adaptive execution cuts a hot month into pieces of even size and puts small months together by the sizes it has
    measured, so the rows are made once. Without it they are dealt by ranges, for which Spark reads them twice.
    The id comes first: a sort compares the first bytes of its first column and opens two rows only where those are equal.
    """
    order = ["entity_id", "entity_type", "metric", "ts"]
    rows = df.select(*HISTORY_COLS, MONTH)
    dealt = rows.hint("rebalance", MONTH) if _adaptive(df) else rows.repartitionByRange(MONTH, *order)
    return dealt.sortWithinPartitions(*order)


def _commit(df: DataFrame, path: str, whole: bool = False) -> list[str]:
    """Write rows beside the store, then move each month in; `whole` supersedes what the month held."""
    spark, staged = df.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    with _open_months(spark):
        _laid_out(df).write.option("compression", "zstd").partitionBy(MONTH).parquet(staged)
    held = _appends(spark, path)
    number = 2 * (max((n for numbers in held.values() for n in numbers), default=0) // 2 + 1) + whole
    months = _folders(spark, staged, MONTH)
    for month, folder in months.items():
        files, target = _place(spark, f"{path}/{MONTH}={month}/{APPEND}={number}")
        files.mkdirs(target.getParent())
        if not files.rename(_place(spark, folder)[1], target):
            raise OSError(f"could not move {folder}")
        for old in held.get(month, []) if whole else []:
            files.delete(_place(spark, f"{path}/{MONTH}={month}/{APPEND}={old}")[1], True)
    files, target = _place(spark, staged)
    files.delete(target, True)
    return list(months)


def _batch(df: DataFrame, seq: str | None) -> DataFrame:
    """Usable rows of a batch, one for each key: the last by `seq`."""
    rows = normalise(df)
    if not seq:
        # The largest value of a key. A maximum of numbers is hashed, where one of whole rows would sort them all.
        last = rows.groupBy(*HISTORY_KEY).agg(F.max("value").alias("value")).select(*HISTORY_COLS)
    else:
        last = keep_last(rows.withColumn(SEQ, F.col(seq).cast("bigint")))
    return last.withColumn(MONTH, month_of())


def _write(df: DataFrame, path: str, whole: bool) -> list[str]:
    if _adaptive(df):
        return _commit(df, path, whole)
    # The rows are read twice (range bounds, rows); keep them rather than parse them anew.
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _commit(rows, path, whole)
    finally:
        rows.unpersist()


def append(df: DataFrame, path: str, seq: str | None = None) -> list[str]:
    """Add long rows to the store: new rows win over stored ones with the same key, and later
    `seq` wins inside the batch. Only files are added, nothing stored is read or written again."""
    return _write(_batch(df, seq), path, False)


def rewrite(df: DataFrame, path: str, seq: str | None = None) -> list[str]:
    """Replace the months present in `df` outright, as an explicit re-pull of a backfill does."""
    return _write(_batch(df, seq), path, True)


def compact(spark: SparkSession, path: str, least: int = 2) -> list[str]:
    """Merge the appends of each month that has at least so many; the rows that are read stay the same."""
    many = {m: numbers for m, numbers in _appends(spark, path).items() if len(numbers) >= max(least, 2)}
    return _commit(reduce(DataFrame.unionByName, _read(spark, path, many)), path, True) if many else []


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not listed; the key columns are those of `keys`."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def delete_counts(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows scanned and removed per month."""
    marked = keys.distinct().withColumn("_hit", F.lit(1))
    return (df.join(marked, keys.columns, "left")
            .groupBy(MONTH)
            .agg(F.count("*").alias("scanned"), F.count("_hit").alias("removed")))


def delete(spark: SparkSession, path: str, keys: DataFrame, dry_run: bool = False) -> DataFrame:
    """Drop listed entities. Months without a match are not rewritten. Returns the counts."""
    stored = read(spark, path)
    counts = delete_counts(stored, keys)
    found = sorted((r[MONTH], r["scanned"], r["removed"]) for r in counts.collect())
    report = spark.createDataFrame(found, "year_month string, scanned bigint, removed bigint")
    months = [m for m, _, removed in found if removed]
    if dry_run or not months:
        return report
    hit = stored.filter(F.col(MONTH).isin(months))
    emptied = [m for m, scanned, removed in found if removed and removed == scanned]
    _commit(without(hit, keys), path, True)
    # A month left with no rows has nothing to move in, so its folder is dropped by name.
    for m in emptied:
        files, folder = _place(spark, f"{path}/{MONTH}={m}")
        files.delete(folder, True)
    return report


def audit(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per entity type plus a total row: rows, months, time span, metrics, sources."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    return (df.withColumn(MONTH, month_of())
            .rollup("entity_type")
            .agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"),
                 F.max("ts").alias("last_ts"), distinct("entity_id").alias("entities"),
                 distinct("metric").alias("metrics"), distinct("source").alias("sources"),
                 distinct(MONTH).alias("partitions"))
            .withColumn("entity_type", F.coalesce("entity_type", F.lit("all"))))
