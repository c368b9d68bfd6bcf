"""The registered queries of the text operators, at production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm import (
    bpe, decontaminate, exact_dedup, langid, ngram_join, outliers, pii, quality, ranked, secret_scan, substrings, toxicity, whitening)
from hydrospark.llm.oracle import ORACLE_SQL  # noqa: F401 - read by the entry module
from hydrospark.llm.shared import importable, staged
from hydrospark.session import configure, run_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.default_table()
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _remainder(parts: int):
    """crc32 of an id written as text, modulo `parts`."""
    return lambda column: F.crc32(F.col(column).cast("string").cast("binary")) % parts


def _held_out(scored: DataFrame, parts: int, held: int) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(_remainder(parts)("doc_id") == held, F.lit(False)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality.measure(_table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats, _table(spark, sf_dir, "labels"), _remainder(4)("id") != 2)
    return _held_out(quality.score(stats, model), 4, 2).select("doc_id", "held_out", "score", "predicted")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(_table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(_table(spark, sf_dir, "documents")).drop("distance")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = langid.fit(docs, _remainder(3)("id") != 1)
    return _held_out(langid.predict(docs, trees), 3, 1).select("doc_id", "held_out", "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), _remainder(3)("id") != 1)
    return _held_out(toxicity.score(docs, model), 3, 1).select("doc_id", "held_out", "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=13, with_text=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.Ledger(spark, run_dir(spark, "ledger")).scan(docs)
    base = F.filter("found", lambda s: s["base"])

    def of_kind(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("found")).alias("spans"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), secret="registered query")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_quality, op3_ngram_join, op4_outliers, op5_decontaminate, op6_language, op7_toxicity,
    op8_substring_dedup, op9_secrets, op10_surrogates, op11_whitening, op12_ranked_search, op13_exact_dedup)}
