"""Toxicity: the models against counting by hand, both ways of reaching the model, held-out accuracy, odd rows."""

import collections
import math
import random

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, toxic int, gram string, k long, y int, x string"


def labelled(rows, spark):
    docs = spark.createDataFrame([(i, t, "en", 9, "g", 1, 1, "x") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if y is not None], "doc_id long, toxic int, quality int")
    return docs, labels


def by_hand(rows, order, discount):
    """log P(toxic) - log P(ordinary) of a word, from the definition of interpolated Kneser-Ney with shared continuation counts."""
    from crosspanel.llm.toxic import letters

    top = {1: collections.Counter(), 0: collections.Counter()}
    for text, y in rows:
        for w in letters(text):
            s = f" {w} "
            for i in range(1, len(s)):
                top[y][s[max(0, i - order + 1) : i + 1]] += 1
    kinds = set(top[0]) | set(top[1])
    below = collections.defaultdict(set)  # gram: the distinct grams that are one symbol longer
    todo = list(kinds)
    while todo:
        g = todo.pop()
        if len(g) > 1 and g not in below[g[1:]]:
            below[g[1:]].add(g)
            todo.append(g[1:])
    symbols = [g for g in below if len(g) == 1]

    def shared(g):
        if not g:
            return 1 / len(symbols)
        own = {x: len(v) for x, v in below.items() if len(x) == len(g) and x[:-1] == g[:-1]}
        return (max(own[g] - discount, 0) + discount * len(own) * shared(g[1:])) / sum(own.values())

    def ratio(g):
        if g not in kinds:
            both = [{x: n for x, n in top[y].items() if x[:-1] == g[:-1]} for y in (1, 0)]
            rest = [discount * len(b) / sum(b.values()) if b else 1 for b in both]
            return math.log(rest[0] / rest[1])
        p = []
        for y in (1, 0):
            own = {x: n for x, n in top[y].items() if x[:-1] == g[:-1]}
            total = sum(own.values())
            p.append(max(own.get(g, 0) - discount, 0) / total + discount * len(own) / total * shared(g[1:]) if total else shared(g[1:]))
        return math.log(p[0] / p[1])

    return lambda w: sum(ratio(f" {w} "[max(0, i - order + 1) : i + 1]) for i in range(1, len(w) + 2))


def test_models_by_hand(spark):
    from crosspanel.llm import toxic
    from crosspanel.llm._rows import Scratch

    texts = [("You fool, foolish ape!", 1), ("fool éa éa", 1), ("a cool pool, you see; cools", 0), ("Éa 東京 cool", 0), ("", 0), (None, 1)]
    docs, _ = labelled([(i, t, y) for i, (t, y) in enumerate(texts)], spark)
    marks = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "k long, y int")
    work = Scratch(spark, "test")
    counted = work.write(toxic.count_grams(docs, "doc_id", "text", marks), "grams")
    got = toxic._coded(toxic.log_ratios(counted, work)).toPandas().sort_values("code")
    assert got.code.is_unique
    want = by_hand(texts, toxic.ORDER, toxic.DISCOUNT)
    words = ["fool", "foolish", "cool", "cools", "éa", "東京", "you", "zebra", "foo", "a", "abcdefghijk"]
    found = toxic.differences(words, got.code.to_numpy(), got.ratio.to_numpy())
    assert found == pytest.approx([want(w) for w in words]) and found[0] > 1 and found[2] < -0.5


def corpus(n=600):
    rng = random.Random(4)
    parts = ["ba", "ko", "li", "men", "tor", "su", "ne", "ri", "da", "po"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        bad = rng.random() < 0.25
        for _ in range(rng.randint(2, 5) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["xuzzle", "grompf"]) + rng.choice(["", *parts])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_accuracy_and_both_ways(spark):
    from crosspanel.llm import toxic
    from crosspanel.llm.gbdt import held_out

    rows = corpus()
    docs, labels = labelled(rows, spark)
    model = toxic.fit_toxicity(docs, labels)
    out = toxic.score_toxicity(docs, model).withColumn("held_out", held_out("doc_id", 4, 2)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == len(rows) and len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    joined = toxic.fit_toxicity(docs, labels, small=0)
    assert model.arrays is not None and joined.arrays is None
    other = {r.doc_id: r.score for r in toxic.score_toxicity(docs, joined).collect()}
    assert other == pytest.approx({r.doc_id: r.score for r in out}, abs=1e-4)


def test_labels_of_held_out_rows_do_not_matter(spark):
    from crosspanel.llm import toxic
    from crosspanel.llm.gbdt import held_out

    docs, labels = labelled(corpus(200), spark)
    flipped = labels.withColumn("toxic", (held_out("doc_id", 4, 2).cast("int") - labels.toxic) * (held_out("doc_id", 4, 2).cast("int") * 2 - 1))
    one, two = (sorted(map(tuple, toxic.score_toxicity(docs, toxic.fit_toxicity(docs, x)).collect())) for x in (labels, flipped))
    assert labels.exceptAll(flipped).count() > 10 and one == two


def test_odd_rows(spark):
    from crosspanel.llm import toxic

    rows = [(None, "fool", None), (1, "fool fool", 1), (1, "fool fool", 1), (2, None, 0), (3, "", None), (4, "12 34 ...", 0), (5, "x" * 300_000 + " fool " * 50_000, None)]
    docs, labels = labelled(rows, spark)
    for few in (docs, docs.limit(0)):
        for marks in (labels, labels.limit(0), labels.withColumn("toxic", labels.toxic * 0)):
            out = toxic.score_toxicity(few, toxic.fit_toxicity(few, marks)).collect()
            assert len(out) == few.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
            by_id = collections.defaultdict(set)
            for r in out:
                by_id[r.doc_id].add(r.score)
            assert all(len(v) == 1 for v in by_id.values()) and by_id[2] == by_id[3] == by_id[4]
