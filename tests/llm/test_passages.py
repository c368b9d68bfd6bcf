import hashlib

from hydrospark.llm import decontaminate, substrings


def test_spans(spark, table, words):
    items = spark.createDataFrame(
        [(1, "A b C! d e f g h i j k l"), (2, "short item here"), (3, ""), (4, None), (5, words(500, 540)), (10, words(500, 540))],
        "item_id long, text string")
    docs = table((1, "x a b c d e f g h i j y"), (2, "a b c d e f g h i"), (3, "SHORT-item. here"), (4, None), (5, ""),
                 (6, words(490, 520) + " z " + words(525, 545)), (7, "clean text of no one"), (7, "clean text of no one"),
                 (None, "short item here"), (8, words(0, 20_000) + " " + words(500, 512)))
    rows = decontaminate.report(docs, items).collect()
    found = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.items, r.contaminated) for r in rows)
    assert found == [(0, 3, 3, ["2"], True), (1, 12, 10, ["1"], True), (2, 9, 0, [], False), (3, 3, 3, ["2"], True),
                     (4, 0, 0, [], False), (5, 0, 0, [], False), (6, 51, 35, ["10", "5"], True),
                     (7, 5, 0, [], False), (7, 5, 0, [], False), (8, 20_012, 52, ["10", "5"], True)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 7]
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.report(docs, items.limit(0)).collect()} == {0}


def removed(docs, window):
    first, texts = {}, [(i, (t or "").split()) for i, t in docs]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i or 0, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats(table, words):
    docs = [(5, words(0, 60)), (3, "p q " + words(10, 40) + " r"), (9, words(20, 33)), (10, words(20, 32)), (11, None), (12, ""),
            (13, "same " * 40), (14, "same " * 30), (15, words(0, 60)), (15, words(0, 60)), (None, words(0, 60)),
            (16, words(100, 15_000)), (17, "x " + words(9000, 9100) + " y " + words(50, 60) + " " + words(14_000, 15_000)),
            (2, words(0, 12)), (18, words(0, 13) + "\n\t" + words(30, 43))]
    rows = substrings.remove_repeats(table(*docs)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in rows) == removed(docs, 13)
    assert substrings.remove_repeats(table(*docs).limit(0)).count() == 0
