"""More languages than a cap would let through."""

import random


def test_250_languages(spark, monkeypatch):
    from crosspanel.llm import langid

    rng = random.Random(6)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyzäöüßéèçñ"
    for i in range(250):
        parts = ["".join(rng.choice(letters) for _ in range(2)) for _ in range(12)]
        rows += [(40 * i + j, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)), f"l{i:03d}") for j in range(24)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(langid, "ROWS", 4_000)  # sixteen of each
    codes = langid.fit_languages(docs)
    assert len(codes.languages) == 250
    truth = {i: lang for i, _, lang in rows}
    got = langid.predict_languages(docs, codes).collect()
    assert len({r.lang_pred for r in got}) == 250 and sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.9 * len(got)


def test_tables_of_other_threads_stay(spark):
    from concurrent.futures import ThreadPoolExecutor

    from crosspanel.llm._rows import released, table

    before = table(spark.range(3).toDF("n"), "before")
    with released(spark), ThreadPoolExecutor(1) as other:
        inside = table(spark.range(4).toDF("n"), "inside")
        apart = other.submit(lambda: table(spark.range(5).toDF("n"), "apart")).result()
        assert inside.count() == 4
    assert before.count() == 3 and apart.count() == 5
    try:
        inside.count()
    except Exception:
        return
    raise AssertionError("the table is still there")


def test_near_copies_with_a_map(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"b": 2}), (2, text, None), (3, "other words here", {})], "doc_id long, text string, m map<string,int>")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
