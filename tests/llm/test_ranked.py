import math
import random
import re
from collections import Counter

import numpy as np

from hydrospark.llm import ranked
from hydrospark.llm.blocks import packed


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_all, l_all = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        asked, scores = Counter(terms(text)), []
        for i, c, n in held:
            m = 25 + 75 * n * n_all // max(l_all, 1)
            s = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))


def corpus():
    pick = random.Random(4)
    vocabulary = [f"t{int(pick.paretovariate(0.7)) % 400}" for _ in range(2000)]
    docs = [(i, " ".join(pick.choices(vocabulary, k=pick.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[3][1]), (7, docs[7][1]), (2000, None), (2001, "?!"),
             (2002, "Straße ÄÖ x-y_z 12"), (2003, " ".join(vocabulary * 10))]
    items = [(i, " ".join(pick.choices(vocabulary, k=12))) for i in range(12)]
    items += [(20, docs[7][1]), (21, docs[3][1]), (22, None), (23, ""), (24, "absent words"), (25, "STRASSE straße X y Y"), (0, items[0][1]),
              (1, "another text t1 t2"), (None, "t5 t6 t7")]
    return docs, items


def test_search(spark, table):
    docs, items = corpus()
    asked = spark.createDataFrame(items, "item_id long, text string").withColumnsRenamed({"item_id": "q", "text": "doc_id"})
    for spec in (ranked.Spec(), ranked.Spec(docs=16, splits=2, items=5), ranked.Spec(k=3, postings=50)):
        rows = ranked.search(table(*docs), asked, spec, item_id="q", item_text="doc_id").collect()
        assert order(map(tuple, rows)) == order(expected(docs, items, spec.k))
    empty = ranked.search(table(*docs), asked.limit(0), item_id="q", item_text="doc_id")
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.search(table(*docs).limit(0), asked, item_id="q", item_text="doc_id").count() == 0


def test_maxima():
    pick = np.random.default_rng(2)
    terms_, places, tf = [], [], []
    for t in range(5):
        held = np.flatnonzero(pick.random(200) < (t + 1) / 6)
        terms_ += [t] * len(held)
        places += held.tolist()
        tf += pick.integers(1, 9, len(held)).tolist()
    row = {"ids": packed(np.arange(200)), "sizes": packed(np.full(200, 10)),
           **{n: packed(np.array(v, np.int32)) for n, v in (("terms", terms_), ("places", places), ("times", tf))}}
    shard = ranked.Shard(row, 200, 2000)
    for t in range(5):
        first, end = terms_.index(t), terms_.index(t) + terms_.count(t)
        for _ in range(50):
            a, b = sorted(pick.integers(first, end + 1, 2))
            best = int(shard.best(np.array([a]), np.array([b]))[0])
            assert best >> 32 == max(shard.impacts[a:b], default=0)
            if a < b:
                assert 0xFFFFFFFF - (best & 0xFFFFFFFF) == a + int(np.argmax(shard.impacts[a:b]))
