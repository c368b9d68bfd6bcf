"""Language by prediction by partial matching: code lengths under frozen byte context trees.

For each language a tree of byte contexts up to three bytes long holds how often each byte followed.
A byte that a context has not seen is escaped to the next shorter one, with the escape probability of
distinct followers over all, down to the uniform distribution over 256 bytes. The trees are frozen
after training and laid out as one table of code lengths by (context, byte, language), so that a
text's exact code length in every language is a sum of looked-up rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrospark.llm.shared import as_bytes

ORDER = 3
#: Bytes that stand before a text, as its first context.
BEFORE = b"   "
_LATIN = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Spec:
    """`sample` bounds the documents of a language that are learnt from, `cells` the table of a worker:
    of the longest contexts, the most frequent are kept."""

    sample: int = 1500
    cells: int = 8_000_000


def _codes(text: bytes) -> np.ndarray:
    b = np.frombuffer(BEFORE + text, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if text:
                by.setdefault(lang, []).append(_codes(text))
        for lang, codes in by.items():
            code, times = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(times)],
                names=["lang", "code", "times"])


@dataclass(frozen=True)
class Trees:
    """Counts of (context, byte) of every language: what a worker needs to lay out the table."""

    langs: list[str]
    lang: np.ndarray
    code: np.ndarray
    times: np.ndarray
    cells: int

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each byte, row of each context of three symbols, code lengths by (row, symbol) and language."""
        n_lang = len(self.langs)
        used = np.unique(np.concatenate([(self.code >> s) & 255 for s in (24, 16, 8, 0)]))
        symbol = np.zeros(256, dtype=np.int64)  # bytes never seen share symbol 0: no context tells them apart
        symbol[used] = np.arange(1, len(used) + 1)
        size = len(used) + 1
        a, b, c, d = (symbol[(self.code >> s) & 255] for s in (24, 16, 8, 0))
        lengths = np.full((1, size, n_lang), 1 / 256, dtype=np.float32)
        above = np.zeros(1, dtype=np.int64)  # rows of the shorter contexts, by their symbols
        for order, key in ((0, np.zeros_like(a)), (1, c), (2, b * size + c), (3, (a * size + b) * size + c)):
            contexts, total = np.unique(key, return_inverse=True)
            if order == ORDER and len(contexts) > (most := self.cells // (size * n_lang)):
                kept = np.argsort(-np.bincount(total, weights=self.times), kind="stable")[:most]
                kept.sort()
                inside = np.isin(total, kept)
                contexts, total = contexts[kept], np.searchsorted(kept, total)
            else:
                inside = np.ones(len(key), dtype=bool)
            where = above[contexts % max(1, size ** max(0, order - 1))] if order else np.zeros(1, dtype=np.int64)
            own = lengths[where].copy()
            flat = (total * size + d) * n_lang + self.lang
            seen = np.bincount(flat[inside], weights=self.times[inside],
                               minlength=own.size).reshape(own.shape)
            n, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
            known = n > 0
            escaped = np.where(known, own * kinds / np.maximum(n + kinds, 1), own)
            own = np.where(seen > 0, seen / np.maximum(n + kinds, 1), escaped).astype(np.float32)
            first = len(lengths)
            lengths = np.concatenate([lengths, own])
            # a context without a row of its own has that of the next shorter one
            above = np.tile(above, size) if order else above.copy()
            above[contexts] = first + np.arange(len(contexts))
        return symbol, above.astype(np.int32), -np.log2(lengths).reshape(-1, n_lang)


def fit(docs: DataFrame, learn: Column, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Trees:
    """Context trees of every language among the rows that `learn`, a condition on `id`, lets through.

    At most spec.sample whole documents a language are used, those with the smallest hash of the id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull()).where(learn)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (ids.select("id", "lang").withColumn("place", F.row_number().over(order))
              .where(F.col("place") <= spec.sample).drop("place").distinct())
    counted = (rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text").where("text is not null")
               .mapInArrow(_count, "lang string, code long, times long")
               .groupBy("lang", "code").agg(F.sum("times").alias("times")).toArrow())
    langs = sorted(set(counted.column("lang").to_pylist()))
    at = {lang: i for i, lang in enumerate(langs)}
    order_ = np.lexsort((counted.column("code").to_numpy(), [at[x] for x in counted.column("lang").to_pylist()]))
    lang = np.array([at[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)[order_]
    return Trees(langs, lang, counted.column("code").to_numpy()[order_],
                 counted.column("times").to_numpy()[order_], spec.cells)


def has_letter(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _score(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        langs = model.langs
        symbol, row, lengths = model.table() if langs else (None, None, None)
        size = int(symbol.max()) + 1 if langs else 0
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(1)):
                if not langs or not text or not has_letter(text):
                    out.append(("und", 0.0))
                    continue
                bits = np.zeros(len(langs))
                for at in range(0, len(text), 1 << 20):  # long texts in strides, each with its context
                    s = symbol[np.frombuffer((BEFORE + text if not at else text[at - 3:])[:(1 << 20) + 3], np.uint8)]
                    context = row[(s[:-3] * size + s[1:-2]) * size + s[2:-1]].astype(np.int64)
                    bits += lengths[context * size + s[3:]].sum(axis=0, dtype=np.float64)
                best = int(np.argmin(bits))
                out.append((langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of the shortest code and its share of 2**-bits.

    `und` with score 0 for a null or empty text or one without a letter, or where nothing was learnt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _score(shared), "doc_id long, lang_pred string, score double")
