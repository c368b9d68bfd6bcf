import hashlib
import re

from hydrospark.llm import exact_dedup


def expected(docs):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    out, kept = [], set()
    for i, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [j for j, u in texts if u == t]
        least = min((j for j in ids if j is not None), default=None)
        out.append((i, least, len(ids), t not in kept, hashlib.sha256(t.encode()).hexdigest()))
        kept.add(t)
    return out


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in row)


LONG = "word " * 20_000
DOCS = [(5, "a b"), (3, "a \t\n b"), (9, "a b "), (8, " a b"), (7, None), (2, ""), (11, "\n"), (12, " "), (None, "a\x0bb"), (None, "only"),
        (None, "only"), (20, LONG), (19, LONG + "x"), (18, LONG + "y"), (17, LONG + " x"), (6, "rep"), (6, "rep"), (6, "other"),
        (30, "ü" * 40), (31, "ü" * 40), (32, "ü" * 40), (40, "p" * 31), (41, "p" * 32), (42, "p" * 33), (43, "p" * 32),
        (44, "a b"), (45, "x\x00y"), (46, "x\x00y")] + [(100 + i, "copy of one text") for i in range(300)]


def test_groups(table):
    rows = exact_dedup.groups(table(*DOCS)).collect()
    assert sorted((tuple(r) for r in rows), key=key) == sorted(expected(DOCS), key=key)
    small = exact_dedup.groups(table(*DOCS), exact_dedup.Radix(first=1, growth=2)).collect()
    assert sorted(map(tuple, small), key=key) == sorted(map(tuple, rows), key=key)
    assert exact_dedup.groups(table(*DOCS).limit(0)).count() == 0


def test_keep_first(spark, table):
    docs = table(*DOCS).withColumnsRenamed({"fp": "node", "N_Words": "row"})
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    want = [r[0] for r in expected(DOCS) if r[3]]
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i or 0)) == want
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0
    text_ids = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert [r.doc_id for r in exact_dedup.keep_first(text_ids).collect()] == ["a"]
