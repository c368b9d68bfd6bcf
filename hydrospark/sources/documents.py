"""Reading landed files as a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """One row per file: `value` and one column per key, a pattern whose first group is taken from
    the file's path, for example `site_id=r"/(\\d+)\\.json$"`."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    name = F.input_file_name()
    return df.select("value", *[F.regexp_extract(name, pattern, 1).alias(key)
                                for key, pattern in keys.items()])


def parsed(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The document parsed into `doc`; a broken document gives nulls, not a failed job."""
    return df.withColumn("doc", F.from_json(column, schema)).drop(column)
