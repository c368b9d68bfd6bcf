"""Ranked search with range-maximum sparse tables over posting lists.

Documents are dealt into shards as they are read. A shard keeps one posting list for each asked term, by ascending
document, and over each list a sparse table of maxima, so that the greatest impact of a term within any interval of
documents takes two look-ups. An interval's bound is the sum over an item's terms of weight times that maximum. The search
is best first: of an item's open intervals those of the highest bounds are taken, each is split at the document where
the term that adds most has its maximum, that document is scored exactly, and the two intervals left and right of it go back
with bounds of their own. An interval whose bound cannot reach the item's k-th best document is dropped, so every
answer is exact.

The work on Spark: one pass over the documents writes the shards and the counts; the document frequencies are summed;
a first pass over the shards takes the few best splits of each item and gives a k-th best score that holds for the
whole corpus; the second pass searches every shard to its end against that score. Each shard hands on at most k
documents an item. Items are taken in blocks of `Spec.items`, which bounds what is broadcast: their terms, a weight each
and k-th scores. Posting lists are kept for terms of the block alone; N, L and all frequencies cover all documents.

Defined results: null and empty texts have no terms and are never ranked; an item without terms, or whose terms no
document holds, has no rows; repeated rows of documents are ranked each; repeated rows of an item (equal id and text) are one
item; items of one id and different texts are ranked apart. Equal scores are ordered by ascending id, documents
without an id last. Ids of documents are whole numbers. Other columns are not read. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.llm.blocks import packed, unpacked
from hydrospark.llm.decontaminate import LETTERS
from hydrospark.llm.shared import Words, as_bytes, staged

#: Stands for a missing document id: behind all others.
NO_ID = 2**63 - 1
_LOW = np.int64(0xFFFFFFFF)


@dataclass(frozen=True)
class Spec:
    """k best documents; documents and postings of one shard; items of one block; splits taken at a time."""

    k: int = 10
    docs: int = 4096
    postings: int = 1 << 19
    items: int = 4096
    splits: int = 32


_SHARDS = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()),
                     ("terms", pa.binary()), ("places", pa.binary()), ("times", pa.binary()),
                     ("held", pa.list_(pa.int32())), ("holders", pa.list_(pa.int64()))])
_SHARDS_SPARK = ("n_docs long, n_words long, ids binary, sizes binary, terms binary, places binary, times binary, "
                 "held array<int>, holders array<long>")


def _shard(ids: list, sizes: list, slots: list, times: list) -> pa.RecordBatch:
    """One row: documents by ascending id, postings by term and document, packed."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = np.concatenate(slots) if slots else np.empty(0, np.int64)
    docs = np.repeat(place, [len(s) for s in slots])
    by = np.lexsort((docs, terms))
    held, holders = np.unique(terms, return_counts=True)
    n = np.array(sizes, np.int64)
    return pa.RecordBatch.from_pylist([{
        "n_docs": int((n > 0).sum()), "n_words": int(n.sum()), "ids": packed(np.array(ids, np.int64)[order]),
        "sizes": packed(n[order]), "terms": packed(terms[by].astype(np.int32)),
        "places": packed(docs[by].astype(np.int32)), "times": packed((np.concatenate(times) if times else terms)[by].astype(np.int32)),
        "held": held.astype(np.int32), "holders": holders}], schema=_SHARDS)


def _postings(vocabulary, spec: Spec):
    """Documents to shards: the counts of all, the postings of the terms asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(LETTERS), vocabulary.value
        ids, sizes, slots, times, held = [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = words.of(text)
                at = np.searchsorted(known, found)
                at[at == len(known)] = 0
                slot, tf = np.unique(at[known[at] == found], return_counts=True) if len(known) else (at[:0], at[:0])
                ids.append(NO_ID if doc is None else doc)
                sizes.append(len(found))
                slots.append(slot)
                times.append(tf)
                held += len(slot)
                if len(ids) >= spec.docs or held >= spec.postings:
                    yield _shard(ids, sizes, slots, times)
                    ids, sizes, slots, times, held = [], [], [], [], 0
        if ids:
            yield _shard(ids, sizes, slots, times)

    return run


class Shard:
    """The posting lists of one shard with a sparse table of maxima over each of them.

    All lists lie one behind the other. Entry i of level j is the greatest of the 2^j entries from i on: the impact in
    the upper half, the complement of its place in the lower, so that the earliest document of equal impacts wins.
    """

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.ids, sizes = unpacked(row["ids"], np.int64), unpacked(row["sizes"], np.int64)
        terms, self.places = (unpacked(row[c], np.int32).astype(np.int64) for c in ("terms", "places"))
        tf = unpacked(row["times"], np.int32).astype(np.int64)
        m = 25 + 75 * sizes * n_docs // max(n_words, 1)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.places])
        self.terms, self.width = terms, np.int64(len(self.ids))
        self.keys = terms * self.width + self.places
        n = len(terms)
        longest = int(np.bincount(terms).max()) if n else 0
        self.level_of = np.zeros(longest + 1, np.int64)
        self.level_of[1:] = np.floor(np.log2(np.arange(1, longest + 1))).astype(np.int64)
        table = np.zeros((max(longest, 1).bit_length(), n), np.int64)
        table[0] = self.impacts << 32 | (_LOW - np.arange(n))
        for j in range(1, len(table)):
            half, end = 1 << (j - 1), n - (1 << j) + 1
            np.maximum(table[j - 1, :max(end, 0)], table[j - 1, half:half + max(end, 0)], out=table[j, :max(end, 0)])
        self.table, self.n = table.reshape(-1), n

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The greatest entry of each range of postings [a, b), 0 where it is empty."""
        size = b - a
        level = self.level_of[size]
        out = np.zeros(a.shape, np.int64)
        some = size > 0
        at = (level * self.n)[some]
        out[some] = np.maximum(self.table[at + a[some]], self.table[at + b[some] - (1 << level[some])])
        return out

    def search(self, slots: np.ndarray, weights: np.ndarray, spec: Spec, least: tuple[int, int], rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best documents that beat `least` (score, id) or equal it; all splits, or so many rounds."""
        a, b = np.searchsorted(self.terms, slots), np.searchsorted(self.terms, slots + 1)
        some = (b > a) & (weights > 0)
        slots, weights, a, b = slots[some], weights[some], a[some][None], b[some][None]
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        top = self.best(a, b)
        low, bound = np.zeros(1, np.int64), ((top >> 32) * weights).sum(axis=1)
        base, at_once = slots * self.width, max(1, spec.splits * 32 // max(len(slots), 32))
        while rounds is None or rounds > 0:
            keep = (bound > least[0]) | ((bound == least[0]) & (self.ids[np.minimum(low, self.width - 1)] <= least[1]))
            keep &= bound > 0
            if not keep.any():
                break
            low, bound, a, b, top = low[keep], bound[keep], a[keep], b[keep], top[keep]
            take = np.zeros(len(bound), bool)
            take[np.argpartition(-bound, at_once - 1)[:at_once] if len(bound) > at_once else slice(None)] = True
            ta, tb, tt = a[take], b[take], top[take]
            gains = (tt >> 32) * weights
            lead = gains.argmax(axis=1)
            place = self.places[_LOW - (tt[np.arange(len(lead)), lead] & _LOW)]
            key = base + place[:, None]
            cut = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(cut, self.n - 1)] == key
            exact = (np.where(hit, self.impacts[np.minimum(cut, self.n - 1)], 0) * weights).sum(axis=1)
            scores, ids = np.concatenate((scores, exact)), np.concatenate((ids, self.ids[place]))
            best = np.lexsort((ids, -scores))[:spec.k]
            scores, ids = scores[best], ids[best]
            if len(scores) == spec.k and (-scores[-1], ids[-1]) < (-least[0], least[1]):
                least = int(scores[-1]), int(ids[-1])
            na, nb = np.concatenate((ta, cut + hit)), np.concatenate((cut, tb))
            nt = self.best(na, nb)
            rest = ~take
            a, b, top = np.concatenate((a[rest], na)), np.concatenate((b[rest], nb)), np.concatenate((top[rest], nt))
            low = np.concatenate((low[rest], low[take], place + 1))
            bound = np.concatenate((bound[rest], ((nt >> 32) * weights).sum(axis=1)))
            rounds = None if rounds is None else rounds - 1
        return scores, ids


_HITS = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(asked, spec: Spec, n_docs: int, n_words: int, rounds: int | None):
    """Shards to the best documents of each item in each of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], n_docs, n_words)
                q, docs, scores = [], [], []
                for item, slots, weights, least in asked.value:
                    found, ids = shard.search(slots, weights, spec, least, rounds)
                    q.append(np.full(len(ids), item, np.int64))
                    docs.append(ids)
                    scores.append(found)
                if q:
                    yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in (q, docs, scores)], schema=_HITS)

    return run


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked from 1."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("doc_id"))
    return hits.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weight(n_docs: int, holders: int) -> int:
    """Weight of a term that so many of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def _block(docs: DataFrame, items: list, spec: Spec) -> DataFrame:
    """q, doc_id, score and rank of the items (q, text) of one block."""
    spark, words = docs.sparkSession, Words(LETTERS)
    terms = {q: np.unique(words.of((text or "").encode()), return_counts=True) for q, text in items}
    known = np.unique(np.concatenate([t for t, _ in terms.values()]))
    shards = staged(docs.mapInArrow(_postings(spark.sparkContext.broadcast(known), spec), _SHARDS_SPARK), "shards")
    n_docs, n_words = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    counted = (shards.select(F.explode(F.arrays_zip("held", "holders")).alias("t"))
               .groupBy(F.col("t.held").alias("slot")).agg(F.sum("t.holders").alias("n")).collect())
    weights = np.zeros(len(known), np.int64)
    for slot, n in counted:
        weights[slot] = weight(n_docs, n)
    asked = [(q, slots := np.searchsorted(known, t), weights[slots] * times, (0, NO_ID)) for q, (t, times) in terms.items() if len(t)]

    def search(asked: list, rounds: int | None) -> DataFrame:
        return shards.select("ids", "sizes", "terms", "places", "times").mapInArrow(
            _searched(spark.sparkContext.broadcast(asked), spec, n_docs, n_words, rounds), "q long, doc_id long, score long")

    seen = _first(search(asked, 2), spec.k).filter(F.col("rank") == spec.k).collect()
    least = {r.q: (r.score, r.doc_id) for r in seen}
    return _first(search([(q, s, w, least.get(q, none)) for q, s, w, none in asked], None), spec.k)


def search(docs: DataFrame, items: DataFrame, spec: Spec = Spec(), text: str = "text", doc_id: str = "doc_id",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    asked = staged(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
                   .withColumn("q", F.monotonically_increasing_id()), "items")
    blocks = -(-asked.count() // spec.items)
    read = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    out = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "text").collect()
        if rows:
            out.append(_block(read, [tuple(r) for r in rows], spec))
    if not out:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, out).join(asked.select("q", "item_id"), "q")
    return best.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
