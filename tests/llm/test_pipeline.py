import hashlib
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from hydrospark.llm import bpe
from hydrospark.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [k for k in names if k.startswith("op")] == list(QUERIES) and "pipeline" in names
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "secrets", "encode"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, pick = tmp_path_factory.mktemp("sf"), random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(60)) for _ in range(200)]
    rows = [(i, t + " awful moron" if i % 4 == 0 else t) for i, t in enumerate(texts)]
    rows += [(300, texts[1] + " end"), (301, texts[1]), (302, "before " + texts[2][:60] + " token=secret99 after"),
             (303, None), (304, ""), (None, None)]
    rows.append((305, " ".join(f"bench{i}" for i in range(30))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(5, 16)))], "item_id long, text string") \
        .write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "encode" or docs.columns == columns
        if name == "secrets":
            masked = docs.where("doc_id = 302").first().text
    assert not [i for i in ids["toxicity"] if i is not None and i < 200 and i % 4 == 0] and len(ids["toxicity"]) == 157
    assert set(ids["toxicity"]) - set(ids["near_duplicates"]) == {300, 301}
    assert set(ids["near_duplicates"]) - set(ids["decontaminate"]) == {305}
    assert "secret99" not in masked and masked.endswith("after")
    row = docs.where("doc_id = 302").first()
    assert row.decoded_sha256 == hashlib.sha256(masked.encode()).hexdigest()
    assert row.n_tokens == len(bytes(row.ids)) // 4
    assert bpe.tokens_at(bpe.default_table()[0])
    assert ids["encode"].count(None) == 1


def test_stages_bound_their_batches(spark, table):
    """No stage hands a Python worker more than some thousand texts at once."""
    for name, stage in corpus_pipeline.STAGES:
        if name in ("secrets", "encode"):
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            stage(spark, table((1, "one two")), "")
            sizes = spark.range(0, 9000, 1, 1).mapInArrow(
                lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert sum(r.n for r in sizes) == 9000 and max(r.n for r in sizes) <= 2048


def test_stages_on_odd_rows(spark, table, tmp_path):
    """Null and repeated ids, null, empty and long texts, columns named like helpers, and an empty table."""
    passage = " ".join(f"bench{i}" for i in range(12))
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = table((1, "one two three four five six"), (1, "one two three four five six"), (2, "ONE two three four five six"),
                 (3, None), (3, ""), (4, long), (5, long), (6, "a " + passage + " b"), (7, "token=secret99 after"),
                 (None, "one two three four five six"), (None, None))
    names = ["gone", "again", "least", "Bad_ID", "bad_hash", "blob_of", "spans_of", "__gone", "__id", "__found"]
    docs = docs.selectExpr("*", *[f"'x' as {c}" for c in names])
    spark.createDataFrame([(9, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"near_duplicates": [None, None, 1, 3, 4, 6, 7], "decontaminate": [None, None, 1, 3, 4, 7],
            "secrets": [None, None, 1, 3, 4, 7]}
    rows, none = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        rows, none = (corpus_pipeline.staged(stage(spark, d, str(tmp_path)), name) for d in (rows, none))
        assert rows.columns == docs.columns and none.count() == 0
        assert sorted((r.doc_id for r in rows.select("doc_id").collect()), key=lambda i: i or 0) == left[name]
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert "secret99" not in texts[7] and texts[4] == long
