import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hydrospark.llm import langid, quality, toxicity
from hydrospark.llm.blocks import packed, summed, unpacked

def anything():
    return F.lit(True)



def sentences(seed, vocabulary, count, size):
    pick = random.Random(seed)
    return [" ".join(pick.choice(vocabulary) for _ in range(size)) for _ in range(count)]


EN = "the of and with this that from have their which would about".split()
DE = "der die und nicht eine sich auch nach wird über zwischen können".split()


def test_toxicity(spark, table):
    texts = sentences(1, EN, 240, 30)
    docs = table(*[(i, t if i % 4 else t + " you awful moron") for i, t in enumerate(texts)], (900, None), (901, ""),
                 (None, "of awful moron"), (3, texts[3]))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(5, None), (None, 1), (3, 0)],
                                   "doc_id long, toxic int")
    spec = toxicity.Spec(l1=1.0)
    model = toxicity.fit(docs, labels, F.col("id") % 3 != 1, spec=spec)
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 3 == 1]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 244
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(
        r.doc_id for r in rows if r.doc_id is not None and not r.predicted)
    assert (model != 0).sum() < 200
    nothing = toxicity.fit(docs, labels.limit(0), anything())
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_keeps_the_driver_small(spark, table, monkeypatch):
    """Four shards trained side by side: as by plain arrays, and no state of a shard comes to the driver."""
    four = spark.range(1000).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(4))).groupBy("shard").agg(F.min("id").alias("id"))
    ids = {r.shard: r.id for r in four.collect()}
    texts = {s: " ".join(f"s{s}w{k}" for k in range(40)) + " common words" + " bad" * (s % 2) for s in ids}
    docs = table(*[(i, texts[s]) for s, i in ids.items()])
    labels = spark.createDataFrame([(i, s % 2) for s, i in ids.items()], "doc_id long, toxic int")
    spec = toxicity.Spec(l1=0.1, sample=4, shard=1)
    frame, got, collect = type(docs), [], type(docs).collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pytest.fail("a state is sent by the driver"))
    model = toxicity.fit(docs, labels, anything(), spec=spec)
    assert sum(len(v) for rows in got for r in rows for v in r if isinstance(v, bytes | bytearray)) == len(packed(model))

    zero = np.zeros((1 << toxicity.WEIGHTS_LOG2) + 1)
    mean = (zero, zero)
    for _ in range(spec.rounds):
        start = pa.table({"z": [packed(mean[0])], "n": [packed(mean[1])]})
        done = [toxicity._train(spec, True)(pa.table({"shard": [s], "text": [texts[s]], "label": [float(s % 2)]}), start) for s in sorted(ids)]
        mean = tuple(np.mean([unpacked(t.column(c)[0].as_py(), np.float64) for t in done], axis=0) for c in "zn")
    assert np.array_equal(model, toxicity.weights(*mean, spec)) and (model != 0).sum() > 10


def test_sums_of_counters(spark, monkeypatch):
    """Whole numbers are added up in tasks: one array for each name reaches the driver."""
    parts = [(k % 2, k, packed(np.full(1000, k, dtype=np.int64))) for k in range(150)]
    rows = spark.createDataFrame(parts, "name int, part int, counts binary")
    got, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: got.append(collect(self)) or got[-1])
    total = summed(rows, "counters")
    assert {k: (set(v.tolist()), len(v)) for k, v in total.items()} == {0: ({sum(range(0, 150, 2))}, 1000), 1: ({sum(range(1, 150, 2))}, 1000)}
    assert [len(r) for r in got if r and "counts" in r[0]] == [2]


def test_quality(spark, table):
    good = sentences(2, EN, 120, 40)
    bad = ["### $$$ %%% &&& " * 10 + t.upper() for t in sentences(3, EN, 120, 20)]
    docs = table(*enumerate(good + bad), (900, None), (901, ""), (None, good[0]), (3, good[3]))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (7, None)], "doc_id long, quality int")
    stats = quality.measure(docs)
    model = quality.fit(stats, labels, F.col("id") % 4 != 2)
    rows = quality.score(stats, model).collect()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 4 == 2]
    assert np.mean([r.predicted == int(r.doc_id < 120) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 244
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    assert {r.score for r in quality.score(stats, quality.fit(stats, labels.limit(0), anything())).collect()} == {0.5}
    assert quality.score(stats.limit(0), model).count() == 0


def test_isotonic_never_falls():
    pick = np.random.default_rng(3)
    values, sizes = pick.random(200), pick.integers(1, 9, 200)
    level = quality.isotonic(values, sizes)
    assert (np.diff(level) >= 0).all()
    assert np.isclose((level * sizes).sum(), (values * sizes).sum())


def test_language(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(sentences(4, EN, 60, 20))]
    rows += [(100 + i, t, "de", None) for i, t in enumerate(sentences(5, DE, 60, 20))]
    rows += [(900, None, None, None), (901, "", "en", None), (902, "12 34 !!", "en", None), (None, "with their", None, None),
             (903, "über zwischen " * 120_000, None, None), (904, "\U0001f642 字", None, None), (3, rows[3][1], "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    trees = langid.fit(docs, F.col("id") % 3 != 1)
    got = langid.predict(docs, trees).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "en" and by[100 + i].lang_pred == "de" for i in range(1, 60, 3))
    assert {(by[i].lang_pred, by[i].score) for i in (900, 901, 902)} == {("und", 0.0)}
    assert by[903].lang_pred == "de" and by[None].lang_pred == "en" and by[904].lang_pred in ("en", "de")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0), anything())).collect()} == {"und"}


@pytest.mark.parametrize("cells", [8_000_000, 2_000])
def test_code_lengths_are_those_of_the_trees(cells):
    """Against counts in dictionaries, with and without a bound on the longest contexts."""
    text = b"abracadabra alakazam " * 3
    codes, times = np.unique(langid._codes(text), return_counts=True)
    trees = langid.Trees(["x"], np.zeros(len(codes), np.int64), codes.astype(np.int64), times, cells)
    symbol, row, lengths = trees.table()
    size = int(symbol.max()) + 1
    counts = [{}, {}, {}, {}]
    for code, n in zip(codes.tolist(), times.tolist(), strict=True):
        g = code.to_bytes(4, "big")
        for order in range(4):
            own = counts[order].setdefault(g[3 - order:3], {})
            own[g[3]] = own.get(g[3], 0) + n
    limit = cells // size
    longest = sorted(counts[3], key=lambda c: -sum(counts[3][c].values()))
    ambiguous = len(longest) > limit

    def p(context, byte, order=3):
        if order < 0:
            return 1 / 256
        own = counts[order].get(context[3 - order:])
        if own is None:
            return p(context, byte, order - 1)
        n, q = sum(own.values()), len(own)
        return own[byte] / (n + q) if byte in own else q / (n + q) * p(context, byte, order - 1)

    for sample in (b"abra", b"kaza", b"zzzz", b"ab\xffa", b"a cb", b"?bra"):
        s = symbol[np.frombuffer(sample, np.uint8)]
        got = lengths[row[(s[0] * size + s[1]) * size + s[2]] * size + s[3], 0]
        if not ambiguous:
            assert np.isclose(got, -np.log2(p(sample[:3], sample[3])), rtol=1e-5)
        else:
            assert np.isfinite(got)
