import random

import numpy as np
import pytest

from hydrospark.llm import ngram_join
from hydrospark.llm.components import components
from hydrospark.llm.shared import Words


def brute(docs, n, t):
    sets, parent = {}, {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and t[1] * both >= t[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("n,t", [(3, (90, 100)), (5, (8, 10))])
def test_groups(table, words, n, t):
    base = words(0, 120).split()
    docs = [(0, words(0, 120)), (1, words(0, 120)), (2, words(0, 120).upper()), (3, ""), (4, None), (5, "one two"),
            (6, "one two"), (7, "one  TWO"), (8, "a b c"), (9, " \n ")]
    for k in range(12):  # copies with one word changed, and chains of drifting windows
        docs.append((20 + k, " ".join(base[:5 * k] + ["odd"] + base[5 * k + 1:])))
        docs.append((40 + k, words(200 + 3 * k, 320 + 3 * k)))
    docs.append((60, words(1000, 9000)))
    docs.append((61, words(1010, 9005)))
    assert got(ngram_join.groups(table(*docs), n, t)) == brute(docs, n, t)


@pytest.mark.parametrize("t", [(1, 2), (8, 10), (9, 10)])
def test_families_of_copies_around_the_threshold(table, t):
    pick, docs = np.random.default_rng(8), []
    for family in range(3):
        base = [f"v{x}" for x in pick.integers(0, 400, 150)]
        for k in range(40):
            text = list(base)
            for at in pick.choice(150, int(pick.integers(0, 16)), replace=False):
                text[at] = f"v{pick.integers(0, 400)}"
            docs.append((100 * family + k, " ".join(text)))
    want = brute(docs, 3, t)
    assert len({c for _, c in want.values()}) > 1
    assert got(ngram_join.groups(table(*docs), 3, t)) == want


@pytest.mark.parametrize("t", [(8, 10), (9, 10)])
def test_crowded_buckets_in_blocks(table, monkeypatch, t):
    monkeypatch.setattr(ngram_join, "FEW", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_LEAST", 7)
    pick, base, docs = np.random.default_rng(9), [f"b{i}" for i in range(100)], []
    for k in range(90):  # one family: some words changed to own ones or to ones of a few others
        text = list(base)
        for at in pick.choice(100, int(pick.integers(1, 7)), replace=False):
            text[at] = f"own{k}-{at}" if pick.random() < 0.6 else f"c{pick.integers(0, 2)}"
        docs.append((k, " ".join(text)))
    want = brute(docs, 3, t)
    assert 1 < len({c for _, c in want.values()}) < 90
    assert got(ngram_join.groups(table(*docs), 3, t)) == want


def test_pairs_of_a_crowded_bucket_are_those_the_bounds_allow(spark):
    pick, sets = np.random.default_rng(10), {}
    for k in range(300):
        own = pick.integers(2**20, 2**62, int(pick.integers(0, 12)))
        sets[k] = np.unique(np.concatenate([np.arange(100 - len(own)), own]).astype(np.uint64))
    few = {k: int((s < 2**20).sum()) for k, s in sets.items()}
    rows = [(7, k, k // 2, len(s), few[k], ngram_join._parity(s), 300) for k, s in sets.items()]
    crowd = spark.createDataFrame(rows, "bucket long, rep long, of long, n long, common long, sketch binary, members long")
    made = ngram_join._crowded_pairs(crowd, (90, 100))
    found = [(r.a, r.b) for r in made.collect()]
    linked = {(a, b) for a in sets for b in range(a + 1, 300) if a // 2 != b // 2
              and 19 * len(np.intersect1d(sets[a], sets[b])) >= 9 * (len(sets[a]) + len(sets[b]))}
    assert len(found) == len(set(found)) and linked <= set(found) and len(linked) > 100
    assert all(a < b and a // 2 != b // 2 and 19 * min(few[a], few[b]) >= 9 * (len(sets[a]) + len(sets[b])) for a, b in found)


def test_odd_rows(table, words):
    docs = table((None, words(0, 30)), (3, words(0, 30)), (3, words(0, 30)), (1, words(0, 30)), (None, None))
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.groups(docs, 5).collect())
    assert rows == [(0, 0, None), (0, 26, None), (1, 26, 1), (3, 26, 1), (3, 26, 1)]
    kept = ngram_join.keep_first(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1]
    assert ngram_join.groups(docs.limit(0), 5).count() == 0


@pytest.mark.parametrize("t", [(90, 100), (8, 10)])
@pytest.mark.parametrize("frequent", [0, 3, 100])
def test_similar_sets_share_a_signature(t, frequent):
    pick = np.random.default_rng(5)
    for _ in range(300):
        n = int(pick.integers(4, 400))
        a = np.unique(pick.integers(0, 2**63, n).astype(np.uint64))
        spare = int(len(a) * (1 - t[0] / t[1]))
        drop = int(pick.integers(0, spare + 1))
        b = np.unique(np.concatenate([a[drop:], pick.integers(0, 2**63, spare - drop).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if t[1] * both < t[0] * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        signed = [set(ngram_join.signatures(s, (s % np.uint64(7) + np.uint64(1)).astype(np.uint8), frequent, t).tolist()) for s in (a, b)]
        assert signed[0] & signed[1]


@pytest.mark.parametrize("t", [(1, 2), (3, 10), (7, 10), (8, 10), (90, 100)])
def test_sets_of_partner_size_share_a_scale(t):
    for n in range(1, 700):
        for m in range(n, n * t[1] // t[0] + 1):
            assert ngram_join._scales(n, t) & ngram_join._scales(m, t), (n, m)


def test_half_similar_sets_of_frequent_tokens_share_a_signature():
    pick = np.random.default_rng(6)
    for n, m in [(140, 260), (130, 258), (200, 390), (100, 140)]:
        b = np.unique(pick.integers(0, 2**63, m).astype(np.uint64))
        a = np.sort(pick.permutation(b)[:n])
        x, y = (set(ngram_join.signatures(s, (s % np.uint64(7) + np.uint64(1)).astype(np.uint8), 0, (1, 2)).tolist()) for s in (a, b))
        assert x & y, (n, m)


def test_parity_bound_never_rejects_a_link():
    known = Words()
    a = ngram_join.token_set(known.of(b" ".join(b"w%d" % i for i in range(3000))), 3)
    b = ngram_join.token_set(known.of(b" ".join(b"w%d" % i for i in range(100, 3050))), 3)
    bits = [np.unpackbits(np.frombuffer(ngram_join._parity(s), np.uint8)) for s in (a, b)]
    assert (bits[0] != bits[1]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 120), (110, 120), (5, 5)] + [(200, k) for k in range(201, 230)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert found[120] == found[110] == 100
    assert {found[k] for k in range(200, 230)} == {200}


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Near copies that hang on one centre are written once; a chain takes rounds and ends with its smallest node."""
    from hydrospark.llm import components as module

    written, keep = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, label: written.append(label) or keep(df, label))
    stars = [(k, 3) for k in range(10, 60)] + [(2, 70), (2, 71), (2, 71), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {3: 3, **{k: 3 for k in range(10, 60)}, 2: 2, 70: 2, 71: 2} and len(written) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0 and len(written) == 2
    pick = random.Random(3)
    links = [(pick.randrange(-150, 150), pick.randrange(-150, 150)) for _ in range(130)]
    low = {n: n for pair in links if pair[0] != pair[1] for n in pair}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(low) and {r.node: r.component for r in found} == low


def test_word_hashes():
    plain, text = Words(), " a b\ta  é\n\x0b" + "long" * 400_000 + " a " + "b c " * 400_000
    h = plain.of(text.encode())
    assert len(h) == len(text.encode().split()) and len(plain.of(b"")) == len(plain.of(b" \n")) == 0
    assert h[0] == h[2] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
    assert Words(bytes(range(256)).lower()).of(b"AbC x")[0] == plain.of(b"abc")[0]
