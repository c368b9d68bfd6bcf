"""Similarity join of documents on sets of word n-grams, by token-combination prefixes.

A document's tokens (its distinct n-grams) are ordered from rare to frequent by corpus counts, those
that a census finds in no other document first. Its
prefix is as long as needed for the guarantee below, and signatures index the prefix: a rare token by
itself, frequent tokens by pairs within token classes, so that what many documents hold does not
fill one bucket. With at most d tokens of a document outside its partner, and a prefix of which the
rare tokens plus, for every class, the tokens but one number more than d, the two share a rare token
or a pair. Pairs of one bucket are first pruned by bounds that lose no link, then verified on the
whole sets. Documents with equal sets form one class and are joined once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.blocks import (
    bitmap_of, census_layout, census_rows, in_bitmap, packed, power_above, shared_points, summed,
)
from hydrospark.llm.components import components
from hydrospark.llm.shared import Words, as_bytes, distinct, grams, mixed, spare, staged

#: Counters of token frequencies; estimates are never too low.
COUNTERS_LOG2 = 20
#: Tokens that a task holds before it passes its census on.
HELD = 2_000_000
#: Bits of the parity sketch that bounds the difference of two sets.
SKETCH_BITS = 1024
#: Bits of a class key that hold how common the document's tokens are, and how many they are.
COMMON_BITS, SIZE_BITS = 10, 9
#: Ratio of the sizes that one size class spans.
SIZE_STEP = 1.05
#: Sets of a bucket that are joined row by row; larger buckets are compared block against block. Sets of a block, at
#: least and at most, and blocks of a bucket in between.
FEW, BLOCK_LEAST, BLOCK_MOST, BLOCKS = 32, 128, 4096, 16
#: Pairs of sets that are compared at once.
AT_ONCE = 1 << 16


def token_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; the whole sequence where there are fewer words."""
    if not len(words):
        return words
    if len(words) < n:
        return mixed(grams(words, len(words)) + np.uint64(len(words)))
    return distinct(grams(words, n))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    known = Words(bytes(range(256)).lower())
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            yield doc, token_set(known.of(text), n)


def _count(n: int, ranges_log2: int):
    """Per document its set's size and 128-bit identity; per task the token counters and the census of tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, part, rows, none = np.zeros(1 << COUNTERS_LOG2, dtype=np.int64), TaskContext.get().partitionId(), [], None
        held, n_held = [], 0
        shift = np.uint64(64 - COUNTERS_LOG2)
        for doc, tokens in _sets(batches, n):
            if len(tokens):
                np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                key = xxhash.xxh3_128_intdigest(tokens.tobytes())
                rows.append((doc, len(tokens), _long(key >> 64), _long(key & (2**64 - 1)), none, none, none, none))
                held.append(tokens)
                n_held += len(tokens)
            else:
                rows.append((doc, 0, none, none, none, none, none, none))
            if n_held >= HELD:
                yield _batch([(none,) * 4 + row for row in census_rows(held, ranges_log2, part)])
                held, n_held = [], 0
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        rows.append((none, none, none, none, -1, part, packed(counts), none))
        if held:
            rows += [(none,) * 4 + row for row in census_rows(held, ranges_log2, part)]
        yield _batch(rows)

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("name", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("several", pa.binary())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return run


def _long(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _scales(n: int, t: tuple[int, int]) -> set[int]:
    """Size classes of all partners that a set of n tokens can have."""
    return set(range((-(-n * t[0] // t[1])).bit_length(), (n * t[1] // t[0]).bit_length() + 1))


def signatures(tokens: np.ndarray, level: np.ndarray, frequent: int, t: tuple[int, int]) -> np.ndarray:
    """Signature hashes of a set at similarity t[0] / t[1].

    Tokens of level 0 are held by no other document: they lengthen no bucket and need no signature.
    """
    n = len(tokens)
    if (n + 1) * t[0] > n * t[1]:  # only an equal set can be as similar
        return tokens[:0]
    need = n - -(-n * t[0] // t[1]) + 1
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    n_rare = int(np.searchsorted(level, frequent))
    out = [mixed(tokens[:min(n_rare, need)][level[:min(n_rare, need)] > 0])]
    if n_rare < need:
        rest, need = tokens[n_rare:], need - n_rare
        for scale in _scales(n, t):
            classes = 1 << max(0, scale - 7)
            of = (mixed(rest + np.uint64(7)) % np.uint64(classes)).astype(np.int64)
            seen = np.zeros(n - n_rare, dtype=bool)
            seen[np.unique(of, return_index=True)[1]] = True  # the first token of each class adds nothing
            length = int(np.searchsorted(np.cumsum(~seen), need)) + 1
            group, chosen = of[:length], rest[:length]
            by = np.argsort(group, kind="stable")
            group, chosen = group[by], chosen[by]
            cut = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cut], [*cut, len(group)], strict=True):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    x, y = chosen[a:b][i], chosen[a:b][j]
                    out.append(mixed(np.minimum(x, y) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(x, y)
                                     + np.uint64(scale)))
    return np.unique(np.concatenate(out))


def _parity(tokens: np.ndarray) -> bytes:
    places = (mixed(tokens + np.uint64(11)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SKETCH_BITS) & 1).tobytes()


def _class_key(tokens: np.ndarray, level: np.ndarray) -> int:
    """A 63-bit key: how common the tokens are, the size class, and a hash of the set."""
    common = min(2**COMMON_BITS - 1, int(level.mean() * 16)) if len(tokens) else 0
    size = min(2**SIZE_BITS - 1, int(math.log(len(tokens)) / math.log(SIZE_STEP))) if len(tokens) else 0
    rest = xxhash.xxh3_64_intdigest(tokens.tobytes()) >> (COMMON_BITS + SIZE_BITS + 1)
    return (common << SIZE_BITS | size) << (63 - COMMON_BITS - SIZE_BITS) | rest


def _size_class(key: str):
    return F.shiftright(F.col(key), 63 - COMMON_BITS - SIZE_BITS).bitwiseAND(F.lit(2**SIZE_BITS - 1))


def _levels(counts: np.ndarray) -> np.ndarray:
    return (np.log2(counts + 1) * 4).astype(np.uint8)


def _index(n: int, levels, shared, frequent: int, t: tuple[int, int]):
    """Per distinct set of a task: a class row (key, size, common, sketch) and its signature rows.

    Common is the number of tokens that another document may hold: no intersection is larger.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, shift = levels.value, set(), np.uint64(64 - COUNTERS_LOG2)
        sigs, keys, rows = [], [], []
        for doc, tokens in _sets(batches, n):
            if not len(tokens) or doc is None:
                continue
            level = table[(tokens >> shift).astype(np.int64)]
            key, whole = _class_key(tokens, level), xxhash.xxh3_128_intdigest(tokens.tobytes())
            if whole in seen:
                continue
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(whole)
            held = in_bitmap(shared.value, tokens)
            own = signatures(tokens, np.where(held, level + np.uint8(1), np.uint8(0)), frequent + 1, t)
            rows.append((key, len(tokens), int(held.sum()), _long(whole >> 64), _long(whole & (2**64 - 1)), _parity(tokens)))
            sigs.append(own)
            keys.append(np.full(len(own), key, dtype=np.int64))
            if len(rows) >= 1024:
                yield from _out(sigs, keys, rows)
                sigs, keys, rows = [], [], []
        if rows:
            yield from _out(sigs, keys, rows)

    def _out(sigs, keys, rows) -> Iterator[pa.RecordBatch]:
        names = ["sig", "key", "n", "common", "k1", "k2", "sketch"]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), pa.int64()), *(pa.array(c, t_) for c, t_ in zip(
                zip(*rows), (pa.int64(),) * 5 + (pa.binary(),), strict=True))], names=names)
        sig, key = np.concatenate(sigs).view(np.int64), np.concatenate(keys)
        for a in range(0, len(sig), 50_000):
            part = sig[a:a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(key[a:a + 50_000]), *(pa.nulls(len(part), x) for x in
                 (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _allowed(na, nb, sa, sb, t: tuple[int, int]) -> np.ndarray:
    """Whether sizes and parity sketches allow a link; never denies one.

    Places that differ between two sketches number at most the tokens in one set only.
    """
    apart = np.bitwise_count(sa ^ sb).sum(axis=1).astype(np.int64)
    both = (na + nb - apart) // 2
    return (t[1] * both >= t[0] * (na + nb - both)) & (t[1] * np.minimum(na, nb) >= t[0] * np.maximum(na, nb))


def _near(t: tuple[int, int]):
    """Pairs of sets whose sizes and parity sketches allow a link; never drops a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _allowed(batch.column("na").to_numpy(), batch.column("nb").to_numpy(),
                            _sketches(batch.column("sa")), _sketches(batch.column("sb")), t)
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return run


def _may_link(common_a, common_b, n_a, n_b, t: tuple[int, int]):
    """Whether an intersection of all tokens that both may share would be enough."""
    return (t[0] + t[1]) * F.least(common_a, common_b) >= t[0] * (n_a + n_b)


def _near_in_blocks(t: tuple[int, int]):
    """Pairs between two blocks of one bucket (or within one) that the bounds allow to link; never drops a link."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, of, n, common, block = (table.column(c).to_numpy() for c in ("rep", "of", "n", "common", "block"))
        sketch = _sketches(table.column("sketch"))
        first, last = table.column("first")[0].as_py(), table.column("last")[0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == last)
        found, step = [], max(1, AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[at:at + step], right, indexing="ij"))
            may = (of[i] != of[j]) & ((t[0] + t[1]) * np.minimum(common[i], common[j]) >= t[0] * (n[i] + n[j]))
            if first == last:
                may &= rep[i] < rep[j]
            i, j = i[may], j[may]
            keep = _allowed(n[i], n[j], sketch[i], sketch[j], t)
            found.append((np.minimum(rep[i[keep]], rep[j[keep]]), np.maximum(rep[i[keep]], rep[j[keep]])))
        a, b = (np.concatenate([f[k] for f in found] or [rep[:0]]) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _crowded_pairs(crowd: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components that may link, from rows (bucket, rep, of, n, common, sketch, members).

    A bucket's sets are dealt over blocks by their hashes, and every block meets every other one and
    itself in a group of its own: memory is bounded by two blocks, and the tasks share one bucket.
    """
    blocks = F.ceil(F.col("members") / F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), F.col("members") / BLOCKS)))
    own = F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")
    dealt = (crowd.withColumn("block", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
             .withColumn("first", F.least("block", "other")).withColumn("last", F.greatest("block", "other")))
    return (dealt.select("bucket", "first", "last", "block", "rep", "of", "n", "common", "sketch")
            .groupBy("bucket", "first", "last").applyInArrow(_near_in_blocks(t), "a long, b long").distinct())


def _wanted(n: int, levels, bitmap):
    """The sets whose class key may be wanted, one for each task and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, asked, seen, shift = levels.value, bitmap.value, set(), np.uint64(64 - COUNTERS_LOG2)
        top = 64 - (len(asked).bit_length() + 2)
        rows: list[tuple] = []
        for doc, tokens in _sets(batches, n):
            if not len(tokens) or doc is None:
                continue
            key = _class_key(tokens, table[(tokens >> shift).astype(np.int64)])
            place = int(mixed(np.array([key], np.uint64))[0]) >> top
            whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
            if asked[place >> 3] >> (place & 7) & 1 and whole not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(whole)
                rows.append((key, _long(whole >> 64), _long(whole & (2**64 - 1)), tokens.tobytes()))
            if len(rows) >= 256:
                yield _out(rows)
                rows = []
        if rows:
            yield _out(rows)

    def _out(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t_) for c, t_ in zip(zip(*rows), (pa.int64(),) * 3 + (pa.binary(),), strict=True)],
            names=["key", "k1", "k2", "tokens"])

    return run


def _mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array(mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["key"])


def _verify(t: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(t[1] * both >= t[0] * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return run


def groups(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10), id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest id reachable over links).

    A-Z are lower-cased, words split at ASCII white space, and two documents link when the sizes of
    intersection and union of their n-gram sets are at least as similarity[0] to similarity[1].
    Fewer than n words count as one n-gram; null and empty texts have no set and no links. A row
    without an id keeps its size and has no component. Repeated rows of one id are one node.

    Links are found in two rounds. First every set meets the most common set of each of its
    buckets, which joins large groups of near copies at their centre. Then every pair of a bucket
    whose sizes are near and whose sets are not yet in one component is tested, so that no link between components is lost.
    """
    spark, t = docs.sparkSession, similarity
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges_log2, bits_log2 = census_layout(max(1, read.rdd.getNumPartitions()))
    sized = staged(read.mapInArrow(
        _count(n, ranges_log2),
        "id long, n long, k1 long, k2 long, name int, part int, counts binary, several binary"), "sets")
    counts = summed(sized.where("name = -1").select("name", "part", "counts"), "tokens").get(
        -1, np.zeros(1 << COUNTERS_LOG2, dtype=np.int64))
    members = sized.where("counts is null").select("id", "n", "k1", "k2")
    total = members.count()
    frequent = int(_levels(np.array([max(255, 4 * counts.mean(), total / 1024)]))[0])
    levels = spark.sparkContext.broadcast(_levels(counts))
    shared = spark.sparkContext.broadcast(shared_points(
        sized.where("name >= 0").select("name", "counts", "several"), ranges_log2, bits_log2))
    indexed = staged(read.mapInArrow(_index(n, levels, shared, frequent, t),
                                     "sig long, key long, n long, common long, k1 long, k2 long, sketch binary"), "signatures")
    least = members.where("id is not null and k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    classes = staged(indexed.where("sig is null").select("key", "n", "common", "k1", "k2", "sketch")
                     .dropDuplicates(["key", "k1", "k2"]).join(least, ["k1", "k2"]), "classes")
    rows = indexed.where("sig is not null").select("sig", "key")
    # near copies share most of their signatures, whose buckets hold about the same sets: those that agree in
    # two minima over hashed members are one bucket, so that a pair meets a few times and not once a signature
    several = (rows.groupBy("sig").agg(F.max("key").alias("hi"), F.min("key").alias("lo"),
                                       *(F.min(F.xxhash64("key", F.lit(i))).alias(f"least_{i}") for i in range(2)))
               .where("lo <> hi").select("sig", F.xxhash64("least_0", "least_1").alias("bucket")))
    buckets = staged(rows.join(several, "sig").select("bucket", "key").distinct().withColumn("size", _size_class("key"))
                     .join(classes.select("key", "rep", "n", "common"), "key"), "buckets")
    heads = buckets.groupBy("bucket", "size").agg(F.max("key").alias("head"))

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
                for k in "ab")
        return pairs.distinct().join(a, "a").join(b, "b").mapInArrow(_near(t), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = staged(classes.join(reps, "rep", "left_semi").select("key", "k1", "k2", "rep"), "asked")
        size = power_above(256 * wanted.count(), 16, 27)  # a set that is not wanted is seldom shuffled
        asked = spark.sparkContext.broadcast(bitmap_of(wanted.select("key").mapInArrow(_mixed_keys, "key long"), size))
        sets = staged(read.mapInArrow(_wanted(n, levels, asked), "key long, k1 long, k2 long, tokens binary")
                      .dropDuplicates(["k1", "k2"]).join(wanted.drop("key"), ["k1", "k2"]).select("rep", "tokens"), "wanted")
        a, b = (sets.withColumnsRenamed({"rep": k, "tokens": f"t{k}"}) for k in "ab")
        return staged(pairs.join(a, "a").join(b, "b").mapInArrow(_verify(t), "a long, b long"), "verified")

    stars = (buckets.join(heads, ["bucket", "size"]).where("key <> head")
             .select(F.col("rep").alias("a"), "head", "n", "common").distinct()
             .join(classes.select(F.col("key").alias("head"), F.col("rep").alias("b"), F.col("n").alias("n_b"),
                                  F.col("common").alias("common_b")), "head")
             .where(_may_link(F.col("common"), F.col("common_b"), F.col("n"), F.col("n_b"), t)).select("a", "b"))
    links = verified(staged(near(stars), "stars"))
    named = components(links)
    at = (buckets.join(named, buckets["rep"] == named["node"], "left")
          .select("bucket", "rep", "n", "common", F.coalesce("component", "rep").alias("of")))
    split = (at.groupBy("bucket").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.count("*").alias("members"))
             .where("lo <> hi").select("bucket", "members"))
    open_ = staged(at.join(split, "bucket"), "open")
    few = open_.where(F.col("members") <= FEW)
    x, y = (few.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "of", "n", "common"))) for k in "ab")
    met = (x.join(y, "bucket").where("rep_a < rep_b and of_a <> of_b")
           .where(_may_link(F.col("common_a"), F.col("common_b"), F.col("n_a"), F.col("n_b"), t))
           .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    crowd = open_.where(F.col("members") > FEW).join(classes.select("rep", "sketch"), "rep")
    more = verified(staged(near(met).unionByName(_crowded_pairs(crowd, t)).distinct(), "pairs"))
    of = components(links.unionByName(more))
    known = classes.join(of, classes["rep"] == of["node"], "left")
    sets = known.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"),
                        F.coalesce("component", "rep").alias("component_id"))
    out = members.join(sets, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, with all its columns; rows without an id stay.

    Ids must be whole numbers. Of rows repeated with one id, one whose text has the smallest hash stays.
    """
    gone, again, least = (spare(docs, c) for c in ("gone", "again", "least"))
    rest = (groups(docs, n, similarity, id_col, text_col).where("component_id <> doc_id")
            .select(F.col("doc_id").alias(gone)).distinct())
    ids, text_hash = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    repeated = (docs.where(ids.isNotNull()).groupBy(ids.alias(again)).agg(F.count("*").alias("rows"), F.min(text_hash).alias(least))
                .where("rows > 1").select(again, least))
    once = docs.join(repeated, ids == F.col(again), "left_anti")
    one = docs.join(repeated, (ids == F.col(again)) & (text_hash == F.col(least)), "left_semi").dropDuplicates([id_col])
    kept = once.unionByName(one)
    return kept.join(rest, kept[id_col].cast("long") == F.col(gone), "left_anti")
