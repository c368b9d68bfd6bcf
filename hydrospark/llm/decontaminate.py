"""Passages shared with a test set, by winnowed fingerprints.

Both sides keep the smallest of every `WIDTH` consecutive `GRAM`-word hashes. WIDTH + GRAM - 1 words
that two texts share hold one common kept hash, so every shared window of that many words meets in
the join of fingerprints; each meeting is extended to both sides over the words carried with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.blocks import bitmap_of, has_bits, power_above
from hydrospark.llm.shared import Words, as_bytes, grams, mixed, spare, staged, window_minima

GRAM = 5

#: ASCII letters in lower case and digits stay, as do bytes beyond ASCII; the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                for b in range(256))

_FINGERPRINTS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                           ("fp", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()),
                           ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])
_SPARK = ("id long, text_hash long, n_words long, fp long, pos int, size int, before array<long>, "
          "after array<long>")


def _short_grams(words: np.ndarray, size: int) -> np.ndarray:
    return mixed(grams(words, size) + np.uint64(size * 0x632BE5AB))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sides(words: np.ndarray, at: np.ndarray, reach: int) -> tuple[list, list]:
    """The words before (nearest first) and after each gram, up to `reach` of either."""
    signed, n = _signed(words), len(words)
    before = [signed[max(0, p - reach):p][::-1] for p in at]
    after = [signed[min(n, p + GRAM):p + GRAM + reach] for p in at]
    return before, after


def _fingerprints(window: int, shorter: list[int], bitmap, item_side: bool):
    width = window - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, filter_ = Words(LETTERS), None if bitmap is None else bitmap.value
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple] = []
            for doc, text, text_hash in zip(ids, as_bytes(batch.column(1)), hashes, strict=True):
                words = known.of(text)
                n = len(words)
                rows.append((doc, text_hash, n, None, None, None, None, None))
                found = []
                if n >= window:
                    kept = grams(words, GRAM)
                    at = np.unique(window_minima(kept, width))
                    found.append((kept[at], at, GRAM))
                for size in ([n] if item_side and 0 < n < window else [] if item_side else shorter):
                    if n >= size:
                        found.append((_short_grams(words, size), np.arange(n - size + 1), size + window))
                for fps, at, size in found:
                    if filter_ is not None:
                        hit = has_bits(filter_, fps >> np.uint64(64 - (len(filter_).bit_length() + 2)))
                        fps, at = fps[hit], at[hit]
                    if size == GRAM:
                        before, after = _sides(words, at, window - GRAM)
                    else:
                        before = after = [None] * len(at)
                    rows.extend((doc, text_hash, n, f, p, size, b, a) for f, p, b, a in
                                zip(_signed(fps).tolist(), at.tolist(), before, after, strict=True))
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), _FINGERPRINTS, strict=True)], schema=_FINGERPRINTS)


def _same_words(left: str, right: str, reach: int) -> Column:
    """How many leading entries of two word lists agree."""
    agree = F.transform(F.sequence(F.lit(0), F.lit(reach - 1)),
                        lambda i: F.coalesce(F.get(left, i) == F.get(right, i), F.lit(False)))
    first_off = F.array_position(agree, False)
    return F.when(first_off == 0, F.lit(reach)).otherwise(first_off - 1).cast("int")


def _read(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                     F.xxhash64(text_col).alias("text_hash"))


def overlaps(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
             text_col: str = "text", item_id_col: str = "item_id",
             item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, text_hash, n_words) of every document, and the shared spans.

    Spans are (id, text_hash, item, begin, end) in words, end exclusive, each of `window` words or
    more or a whole shorter item. Overlapping spans of one passage may each appear. Null and empty
    texts have no words; a document is known by its id and text, so repeated rows agree; further
    columns are not read. Short items are looked for by their whole length, so their number of
    lengths, below `window`, is all that adds to the work on a document.
    """
    spark = docs.sparkSession
    tests = staged(_read(items, item_id_col, item_text_col)
                   .mapInArrow(_fingerprints(window, [], None, True), _SPARK), "items").where("fp is not null")
    shorter = sorted(r[0] - window for r in tests.where(F.col("size") > window).select("size").distinct().collect())
    bits = power_above(32 * tests.count(), 12, 27)
    bitmap = spark.sparkContext.broadcast(bitmap_of(tests.select(F.col("fp").alias("key")), bits))
    rows = staged(_read(docs, id_col, text_col)
                  .mapInArrow(_fingerprints(window, shorter, bitmap, False), _SPARK), "fingerprints")
    test = tests.select("fp", "size", F.col("id").alias("item"), F.col("before").alias("item_before"),
                        F.col("after").alias("item_after")).distinct()
    met = rows.where("fp is not null").join(test, ["fp", "size"])
    reach = window - GRAM
    left, right = _same_words("before", "item_before", reach), _same_words("after", "item_after", reach)
    short = F.col("size") > window
    spans = (met.select("id", "text_hash", "item", "pos", "size", left.alias("l"), right.alias("r"))
             .where(short | (F.col("l") + F.col("r") + GRAM >= window))
             .select("id", "text_hash", "item",
                     F.when(short, F.col("pos")).otherwise(F.col("pos") - F.col("l")).alias("begin"),
                     F.when(short, F.col("pos") + F.col("size") - window)
                     .otherwise(F.col("pos") + GRAM + F.col("r")).alias("end")))
    return rows.where("fp is null").select("id", "text_hash", "n_words"), spans.distinct()


def report(docs: DataFrame, items: DataFrame, window: int = 10, **columns) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted as text), contaminated."""
    all_docs, spans = overlaps(docs, items, window, **columns)
    by_doc = ["id", "text_hash"]
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach")),
        lambda done, s: F.struct(
            (done["words"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], done["reach"]))).alias("words"),
            F.greatest(done["reach"], s["end"]).alias("reach")), lambda done: done["words"])
    hits = spans.groupBy(by_doc).agg(
        F.collect_set(F.struct("begin", "end")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
                       covered.cast("long").alias("n_hit"), "items")
    joined = all_docs.join(hits, F.col("id").eqNullSafe(F.col("hit_id"))
                           & (F.col("text_hash") == F.col("hit_hash")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                         F.size(items_).cast("long").alias("n_items"), items_.alias("items"),
                         (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The documents without a shared span, with all their columns; rows with equal id and text go together."""
    _, spans = overlaps(docs, items, window, id_col, text_col)
    bad_id, bad_hash = spare(docs, "bad_id"), spare(docs, "bad_hash")
    bad = spans.select(F.col("id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col(bad_id))
                     & (F.xxhash64(docs[text_col]) == F.col(bad_hash)), "left_anti")
