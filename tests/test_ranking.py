"""The ranker against brute force; one-pass walk-forward against the loop; row numbers over ranges."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.plans import backtest as B
from crosspanel.plans import ranking as R

DAY = dt.date(2020, 1, 1)


def brute(score, relevance):
    n = len(score)
    order = sorted(range(n), key=lambda i: (-score[i], i))
    rank = {i: k + 1 for k, i in enumerate(order)}
    ideal = sum((2**r - 1) / math.log2(k + 2) for k, r in enumerate(sorted(relevance, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if relevance[i] > relevance[j] and ideal > 0:
                rho = 1 / (1 + math.exp(score[i] - score[j]))
                w = abs(2 ** relevance[i] - 2 ** relevance[j]) * abs(1 / math.log2(1 + rank[i]) - 1 / math.log2(1 + rank[j])) / ideal
                g[i] += rho * w
                g[j] -= rho * w
                h[i] += rho * (1 - rho) * w
                h[j] += rho * (1 - rho) * w
    return g, h


@pytest.mark.parametrize("block", [2, 512])
def test_gradients(monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7):
        score, relevance = rng.integers(-2, 3, n).astype(float), rng.integers(0, 4, n).astype(float)
        got = R.pair_gradients(score, relevance)
        want = brute(score.tolist(), relevance.tolist())
        assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])
    assert not R.pair_gradients(np.zeros(3), np.zeros(3))[0].any()


def panel(spark, dates=40, entities=60, seed=3):
    """The order within a date follows a + b squared; the size of the returns follows the date, with fat tails."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        a, b, noise = rng.standard_normal((3, entities))
        level = rng.standard_normal() * 3
        order = a + b**2 + 0.5 * noise
        y = level + np.sign(order) * np.abs(order) ** 3 * np.exp(rng.standard_normal())
        rel = np.argsort(np.argsort(order)) * 5 // entities
        rows += [(DAY + dt.timedelta(days=d), f"t{i:03d}", float(a[i]), float(b[i]), float(y[i]), int(rel[i])) for i in range(entities)]
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, y double, rel int")


def test_ranker_beats_regression_trees(spark):
    df = panel(spark)
    cut = DAY + dt.timedelta(days=30)
    train, now = df.filter(F.col("date") < F.lit(cut)), df.filter(F.col("date") >= F.lit(cut))
    ranked = R.rank_scores(["a", "b"], "rel", trees=12, depth=3)(train, now)
    regressed = B.gbt_scores(["a", "b"], "y", trees=12, depth=3)(train, now)
    one, two = (R.ndcg(s, "score", "rel").agg(F.avg("ndcg")).first()[0] for s in (ranked, regressed))
    assert one > two + 0.01 and one > 0.9


def test_first_tree_by_hand(spark):
    """One split of one feature: leaf values are the sums of the brute-force gradients on either side."""
    rows = [(DAY, f"t{i}", float(i), r) for i, r in enumerate([0, 0, 1, 0, 2, 1, 2, 2])]
    df = spark.createDataFrame(rows, "date date, ticker string, x double, rel int")
    trees = R.fit_ranker(df, ["x"], "rel", trees=1, depth=1, bins=8, rate=1.0, least=1)
    g, h = brute([0.0] * 8, [r[3] for r in rows])
    best = max(range(1, 8), key=lambda k: sum(g[:k]) ** 2 / (sum(h[:k]) + 1) + sum(g[k:]) ** 2 / (sum(h[k:]) + 1))
    assert trees.leaf[0] == pytest.approx([sum(g[:best]) / (sum(h[:best]) + 1), sum(g[best:]) / (sum(h[best:]) + 1)])
    assert best - 1 <= trees.limit[0][0] < best


def test_ranker_without_rows(spark):
    df = panel(spark, 2, 5)
    for few in (df.limit(0), df.withColumn("rel", F.lit(1)), df.withColumn("rel", F.lit(None).cast("int"))):
        assert {r.score for r in R.rank_scores(["a"], "rel", trees=2)(few, df).collect()} == {0.0}


def test_one_pass_equals_the_loop(spark):
    df = panel(spark, 30, 20).withColumn("y", F.when(F.col("ticker") < "t015", F.col("y"))).withColumn("flat", F.lit(2.0))
    dates = [DAY + dt.timedelta(days=d) for d in range(6, 30)]
    table = spark.createDataFrame([(d,) for d in dates], "date date")
    one = B.one_pass_ridge(df, table, ["a", "b"], "y", 3, 0.05)
    loop = B.walk_forward(df, dates, B.linear_scores(["a", "b"], "y", 0.05), 3)
    want = {(r.date, r.ticker): r.score for r in loop.collect()}
    got = {(r.date, r.ticker): r.score for r in one.collect()}
    assert len(got) == len(dates) * 20 and got == pytest.approx(want, rel=1e-9, abs=1e-9)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3  # features to fit and to score, and the dates, however many
    first = B.ridge_coefficients(df, ["flat", "a"], "y", 3).orderBy("date").collect()
    assert [(r.n, r.intercept) for r in first[:3]] == [(0, None)] * 3 and all(r.coefficients[0] == 0 for r in first)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_row_numbers_with_further_columns(spark, reuse):
    """Ranges must be the same for both reads, whatever columns the rest of the plan needs."""
    from crosspanel.operators.metrics import global_rank, global_row_number

    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(5_000)).alias("x"), "id", F.sha2(F.col("id").cast("string"), 256).alias("s"), F.rand(3).alias("u"))
        out = global_row_number(df, [F.desc("x"), F.col("id")], "n")
        assert {"s", "u", "n_of"} <= set(out.columns)
        got = out.select("n", "x", "id", "n_of").toPandas().sort_values("n")
        assert got.n.tolist() == list(range(1, 200_001)) and (got.n_of == 200_000).all()
        want = got.sort_values(["x", "id"], ascending=[False, True])
        assert got.id.tolist() == want.id.tolist()
        ranks = global_rank(df, "x", "r").toPandas()
        full = df.select("x").toPandas().x
        assert dict(zip(ranks.x, ranks.r, strict=True)) == dict(zip(full, full.rank(), strict=True))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_csv_files_with_other_headers(spark, tmp_path):
    """Columns are known by name: a file in another order is an error and is not read by position."""
    from crosspanel.sources.panels import read_csv

    for name, text in (("a.csv", "key,name\n1,x\n"), ("b.csv", "name,key\ny,2\n")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in read_csv(spark, f"file://{tmp_path}/a.csv", "name string, key long, z int").collect()] == [("x", 1, None)]
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, f"file://{tmp_path}", "key long, name string").collect()
