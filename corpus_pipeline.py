"""From documents to token ids in five stages, each written as Parquet and read again by the next.

1. toxicity: documents that score 0.7 or more go.
2. near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more on 5-word shingles, the one with the
   smallest id stays.
3. decontaminate: documents that share ten words in a row with a benchmark item go.
4. secrets: the characters of found secrets are masked.
5. encode: byte-level BPE ids of every remaining text, checked by decoding them.

A stage judges all that its predecessor kept. Null texts are clean, have no duplicates and no ids. Rows
with a null doc_id stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm import bpe, decontaminate, ngram_join, secret_scan, toxicity
from hydrospark.llm.shared import importable, staged
from hydrospark.session import configure, run_dir


#: Rows of an Arrow batch. A task holds the texts of one outside its heap, and its Python worker holds them twice.
BATCH_ROWS = 2048


def _ready(spark: SparkSession) -> None:
    importable(configure(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    return toxicity.keep_clean(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return ngram_join.keep_first(docs, n=5, similarity=(8, 10))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"), window=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return secret_scan.without_secrets(docs, secret_scan.Ledger(spark, run_dir(spark, "ledger")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    path, pattern = bpe.default_table()
    done = bpe.decode(bpe.encode(docs, path, pattern), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontaminate", drop_benchmark_passages), ("secrets", mask_secrets), ("encode", encode)]

#: A fitted model decides the first stage and merge ranks the last, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
