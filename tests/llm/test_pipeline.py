"""Each stage of the pipeline on a small table, against what its documents say."""

import pytest


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, out = corpus_pipeline.documents(spark, sf), {"documents": corpus_pipeline.documents(spark, sf).collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        out[name] = docs.collect()
    return out


def test_columns_and_order(stages):
    names = list(stages)
    assert names == ["documents", "quality", "near_copies", "decontaminated", "private", "encoded"]
    columns = stages["documents"][0].asDict().keys()
    assert all(stages[n][0].asDict().keys() == columns for n in names[1:-1])
    sizes = [len(stages[n]) for n in names]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_stages_do_their_work(spark, stages):
    from crosspanel.llm.decontaminate import normal
    from crosspanel.llm.pii import base_spans

    ids = {n: {r.doc_id for r in rs} for n, rs in stages.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    gone = ids["documents"] - ids["quality"]
    assert sum(labels.get(i) == 1 for i in gone) <= 0.05 * sum(v == 1 for v in labels.values())
    texts = [r.text for r in stages["near_copies"]]
    assert len(set(texts)) == len(texts)
    first = {}
    for r in sorted(stages["quality"], key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert ids["near_copies"] <= set(first.values())
    items = [normal(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert not any(i in normal(r.text) for r in stages["decontaminated"] for i in items)
    assert all(any(i in normal(r.text) for i in items) for r in stages["near_copies"] if r.doc_id not in ids["decontaminated"])
    assert ids["private"] == ids["decontaminated"] == ids["encoded"] and not any(base_spans(r.text) for r in stages["private"])
    import hashlib

    decoded = {r.doc_id: r.decoded_sha256 for r in stages["encoded"]}
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == decoded[r.doc_id] for r in stages["private"])


def test_odd_rows_pass_through(spark):
    """Nulls in every column, repeated rows, clashing and further columns, empty tables: each stage's exact rows."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    good = corpus_pipeline.documents(spark, sf).filter("doc_id = 1").first().text
    docs = spark.createDataFrame([(None, good, None, None, None), (1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, None, None, None)], corpus_pipeline.documents(spark, sf).schema)
    docs = docs.withColumns({c: F.lit("x") for c in ("__key", "__k", "copy_text", "Copy_ID", "pii_key", "k", "id", "minor")})
    kept = {"quality": [None, 1, 1], "near_copies": [1, 2], "decontaminated": [None, 1, 1, 2], "private": [None, 1, 1, 2], "encoded": [None, 1, 1, 2]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        ids = sorted((r.doc_id for r in out.collect()), key=lambda i: i or 0)
        assert [i for i in ids if i != 2 or name != "quality"] == kept[name], name
        assert name == "encoded" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_near_copies_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    texts = [(None, a), (1, a), (1, a), (2, None), (3, b), (5, b + " tail"), (5, c), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(1, a), (2, None), (3, b), (5, c), (None, d)], key=str)
