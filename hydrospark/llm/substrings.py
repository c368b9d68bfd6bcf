"""Passages that occur in several documents, by prefix-partitioned suffix trees.

Every word position starts a suffix, of which `window` words matter. Suffixes are dealt out to
groups by a prefix: four words where few suffixes start with them, eight or the whole window where
many do, so that a group fits in memory. In a group the sorted suffixes are the leaves of its
subtree, and neighbours that agree on `window` words lie below one deep node. A deep node that
several documents reach is a repeat, owned by the smallest document id; runs of such nodes at
following positions are the maximal repeats.

Two steps keep the groups small. A census finds the sync points (smallest of several 6-word
prefixes, the same wherever a window stands) that only one document has: no window around them can
repeat, so their suffixes are never dealt out. And each scan task first settles the nodes among its
own documents: later documents are marked there, and only the first one of each node travels on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.blocks import (
    census_layout, census_rows, in_bitmap, packed, shared_points, summed, unpacked,
)
from hydrospark.llm.shared import Words, as_bytes, distinct, grams, mixed, runs, staged, window_minima

SYNC = 6
PREFIXES = (4, 8)
#: Counters of the prefix census.
CENSUS_LOG2 = 16
#: Sync points or suffixes that a task holds before it passes them on.
HELD = 2_000_000

_PACKED = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), ("path", pa.binary()), ("ids", pa.binary()),
                     ("hashes", pa.binary()), ("places", pa.binary())])
_PACKED_SPARK = "kind int, grp int, path binary, ids binary, hashes binary, places binary"
_SPANS = pa.schema([("id", pa.int64()), ("text_hash", pa.int32()), ("spans", pa.binary())])


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.hash(text_col).alias("text_hash"))


def _census(window: int, ranges_log2: int):
    """Sync points of the documents of a task as (range, sorted 32-bit rests), and prefix counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part = Words(), TaskContext.get().partitionId()
        held, n_held = [], 0
        counts = {k: np.zeros(1 << CENSUS_LOG2, dtype=np.int64) for k in PREFIXES}

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if not text or doc is None:
                    continue
                words = known.of(text)
                if len(words) < window:
                    continue
                for k in PREFIXES:
                    starts = grams(words, k)[:len(words) - window + 1]
                    np.add.at(counts[k], (starts >> np.uint64(64 - CENSUS_LOG2)).astype(np.int64), 1)
                sync = grams(words, SYNC)
                points = distinct(sync[distinct(window_minima(sync, window - SYNC + 1))])
                held.append(points)
                n_held += len(points)
                if n_held >= HELD:
                    yield from _points(census_rows(held, ranges_log2, part))
                    held, n_held = [], 0
        if held:
            yield from _points(census_rows(held, ranges_log2, part))
        yield from _points([(-k, part, packed(c), None) for k, c in counts.items()])

    def _points(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            name, part, values, several = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int32()), pa.array(part, pa.int32()), pa.array(values, pa.binary()),
                 pa.array(several, pa.binary())], names=["name", "part", "counts", "several"])

    return run


def _settle(path: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which suffixes share a deep node with one of a smaller document: leaves in order, one pass."""
    order = np.lexsort((owner, path))
    p, d = path[order], owner[order]
    first = np.ones(len(p), dtype=bool)
    first[1:] = p[1:] != p[:-1]
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.empty(len(p), dtype=bool)
    out[order] = d > least
    return out


def _dealt(kind: int, group: np.ndarray, path, ids, hashes, places) -> list[tuple]:
    """One row for each group, its columns packed in the order of documents and places."""
    order = np.lexsort((places, hashes, ids, group))
    group = group[order]
    cut = np.flatnonzero(np.diff(group)) + 1
    rows = []
    for a, b in zip([0, *cut], [*cut, len(group)], strict=True) if len(group) else ():
        take = order[a:b]
        rows.append((kind, int(group[a]), None if path is None else path[take].tobytes(),
                     packed(np.diff(ids[take], prepend=0)), packed(hashes[take]),
                     packed(np.diff(places[take].astype(np.int32), prepend=np.int32(0)))))
    return rows


def _undealt(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def joined(name: str, dtype, summed_: bool) -> np.ndarray:
        parts = [unpacked(b, dtype) for b in table.column(name).to_pylist()]
        return np.concatenate([np.cumsum(p, dtype=dtype) if summed_ else p for p in parts])

    return joined("ids", np.int64, True), joined("hashes", np.int32, False), joined("places", np.int32, True)


def _by_document(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows[at:at + 512]), _PACKED, strict=True)], schema=_PACKED)


def _suffixes(window: int, groups: int, bitmap, census, limit: int):
    width = window - SYNC + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, points = Words(), bitmap.value
        heavy = {k: c > limit for k, c in census.value.items()}
        top = np.uint64(64 - CENSUS_LOG2)
        held: list[tuple] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            path, prefix, places = (np.concatenate([h[c] for h in held]) for c in range(3))
            sizes = [len(h[0]) for h in held]
            ids = np.repeat(np.array([h[3] for h in held], np.int64), sizes)
            hashes = np.repeat(np.array([h[4] for h in held], np.int32), sizes)
            late = _settle(path, ids)
            yield from _rows(_dealt(0, _by_document(ids[late], groups), None, ids[late], hashes[late], places[late]))
            first = ~late
            yield from _rows(_dealt(1, (mixed(prefix[first]) % np.uint64(groups)).astype(np.int64), path[first],
                                    ids[first], hashes[first], places[first]))

        for batch in batches:
            for doc, text, text_hash in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)),
                                            batch.column(2).to_pylist(), strict=True):
                if not text or doc is None:
                    continue
                words = known.of(text)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                sync = grams(words, SYNC)
                at = window_minima(sync, width)
                starts = np.flatnonzero(in_bitmap(points, sync)[at])
                if not len(starts):
                    continue
                path = grams(words, window)[starts]
                prefix = path.copy()
                for k in reversed(PREFIXES):
                    short = grams(words, k)[starts]
                    light = ~heavy[k][(short >> top).astype(np.int64)]
                    prefix[light] = short[light]
                held.append((path, prefix, starts, doc, text_hash))
                n_held += len(starts)
                if n_held >= HELD:
                    yield from flush()
                    held, n_held = [], 0
        if held:
            yield from flush()

    return run


def _subtree(groups: int):
    def run(table: pa.Table) -> pa.Table:
        ids, hashes, places = _undealt(table)
        path = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("path").to_pylist()])
        late = _settle(path, ids)
        rows = _dealt(0, _by_document(ids[late], groups), None, ids[late], hashes[late], places[late])
        return pa.Table.from_batches(_rows(rows), schema=_PACKED)

    return run


def _of_documents(table: pa.Table) -> pa.Table:
    """A row for each document of a group, with the sorted starts of its repeats."""
    ids, hashes, places = _undealt(table)
    order = np.lexsort((places, hashes, ids))
    i, h, p = ids[order], hashes[order], places[order]
    cut = np.flatnonzero((np.diff(i) != 0) | (np.diff(h) != 0)) + 1
    spans = [p[a:b].tobytes() for a, b in zip([0, *cut], [*cut, len(i)], strict=True)]
    first = np.array([0, *cut])
    return pa.table([pa.array(i[first]), pa.array(h[first]), pa.array(spans, pa.binary())], schema=_SPANS)


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans): starts, as packed 32-bit integers, of the `window`-word passages of a
    document that also start in a document with a smaller id. Documents without one have no row.

    Words are split at ASCII white space and compared as they stand (as 64-bit hashes of whole
    windows). Null ids have no order: such rows neither lose nor own a passage.
    """
    spark = docs.sparkSession
    read = _read(docs, id_col, text_col)
    parts = max(1, read.rdd.getNumPartitions())
    ranges_log2, bits_log2 = census_layout(parts)
    census = staged(read.mapInArrow(_census(window, ranges_log2),
                                    "name int, part int, counts binary, several binary"), "census")
    bitmap = shared_points(census.where("name >= 0"), ranges_log2, bits_log2)
    counts = {-k: c for k, c in summed(census.where("name < 0").drop("several"), "prefixes").items()}
    groups = 4 * parts
    limit = max(1000, int(counts[PREFIXES[0]].sum()) // (4 * groups)) if counts else 1000
    shared, tables = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(counts)
    suffixes = staged(read.mapInArrow(_suffixes(window, groups, shared, tables, limit), _PACKED_SPARK), "suffixes")
    deep = suffixes.where("kind = 1").groupBy("grp").applyInArrow(_subtree(groups), _PACKED_SPARK)
    return (suffixes.where("kind = 0").unionByName(deep).groupBy("grp")
            .applyInArrow(_of_documents, "id long, text_hash int, spans binary"))


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                removed = 0
                kept = words
                if spans:
                    starts = np.unique(np.frombuffer(spans, np.int32))
                    kept, done = [], 0
                    for a, b in zip(*(x.tolist() for x in runs(starts, window)), strict=True):
                        kept += words[done:a]
                        removed += b - a
                        done = b
                    kept += words[done:]
                out.append((len(words), removed, b" ".join(kept)))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256.

    A word goes if a window over it also starts in a document with a smaller id; windows are judged
    on the input. Null and empty texts have no words. Repeated rows of one id keep what each other
    has; rows with equal id and text are one document. Further columns are not read.
    """
    spans = repeats(docs, window, id_col, text_col).withColumnsRenamed({"id": "span_id", "text_hash": "span_hash"})
    read = _read(docs, id_col, text_col)
    found = read.join(spans, F.col("id").eqNullSafe(F.col("span_id"))
                      & (F.col("text_hash") == F.col("span_hash")), "left")
    out = found.select("id", "text", "spans").mapInArrow(
        _keep(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out if with_text else out.drop("kept")
