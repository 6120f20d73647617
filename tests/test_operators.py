"""Operators on tiny panels with NULLs, ties, single rows and no spread; no look-ahead; exchanges of plans."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.columns import average_rank, first_rank, rolling, section, series, zscore
from crosspanel.operators import cross_section as X
from crosspanel.operators import fundamentals as U
from crosspanel.operators import joins as J
from crosspanel.operators import labels as L
from crosspanel.operators import metrics as A
from crosspanel.operators import portfolio as P
from crosspanel.operators import risk as K
from crosspanel.operators import signals as G
from crosspanel.operators import technical as T
from crosspanel.operators import text as N
from crosspanel.plans import backtest as B
from crosspanel.sources import panels as S
from crosspanel.sources import validation as V
from crosspanel.streaming import stateful as Z

DAY = dt.date(2021, 1, 1)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(42)
    p = 100 * np.exp(np.cumsum(0.02 * rng.standard_normal((120, 4)) + 0.0005, axis=0))
    return pd.DataFrame(p, index=[DAY + dt.timedelta(days=i) for i in range(120)], columns=list("ABCD"))


@pytest.fixture(scope="module")
def panel(spark, walk):
    rows = [(d, t, float(walk.loc[d, t])) for d in walk.index for t in walk.columns if not (t == "D" and d.day == 5)]
    return spark.createDataFrame(rows, "date date, ticker string, price double").repartition(3)


def column(df, x, ticker="A"):
    return [r[x] for r in df.filter(F.col("ticker") == ticker).orderBy("date").collect()]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a is None and (b is None or math.isnan(b))) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_rolling_features_match_pandas(panel, walk):
    df = T.with_technical(panel, (5, 10), (5,))
    p = walk["A"]
    r = p.pct_change()
    same(column(df, "mom_10"), r.rolling(10).sum())
    same(column(df, "vol_5"), r.rolling(5).std() * math.sqrt(252))
    same(column(df, "ma_ratio_20_50"), p.rolling(20).mean() / p.rolling(50).mean())
    up, down = p.diff().clip(lower=0).fillna(0), (-p.diff()).clip(lower=0).fillna(0)
    same(column(df, "rsi_14"), 100 - 100 / (1 + up.rolling(14).mean() / down.rolling(14).mean()))
    same(column(T.with_max_drawdown(panel, 10), "max_drawdown"), (p / p.rolling(10, min_periods=1).max() - 1).rolling(10).min())
    same(column(df.withColumn("mad", T.deviation("r", 7)), "mad"), r.rolling(7).apply(lambda x: np.median(np.abs(x - np.median(x)))))
    same(column(df.withColumn("m", T.momentum("r", 10, 2)), "m"), r.rolling(10).apply(lambda x: np.prod(1 + x[:-2]) - 1))


def test_no_look_ahead(panel):
    full, part = (T.with_technical(p, (5,), (5,)) for p in (panel, panel.filter("date < '2021-03-01'")))
    a = {(r.date, r.ticker): r for r in full.collect()}
    assert all(a[r.date, r.ticker] == r for r in part.collect())


def test_same_frames_share_one_exchange(panel):
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    base = exchanges(panel)
    df = T.with_technical(panel, (5, 10), (5, 21))
    assert exchanges(df) - base == 1
    assert exchanges(df.withColumn("z", zscore("mom_5", section()))) - base == 2


def test_ranks_and_buckets(spark):
    rows = [(1, t, v) for t, v in zip("abcdefg", [3.0, 1.0, 3.0, None, 2.0, 3.0, 0.5], strict=True)] + [(2, "a", 1.0), (3, "a", None), (3, "b", 5.0)]
    df = spark.createDataFrame(rows, "date int, ticker string, x double")
    for d in (1, 2, 3):
        s = pd.Series({t: v for e, t, v in rows if e == d}, dtype=float)
        got = {r.ticker: r.k for r in df.withColumn("k", average_rank("x", ["date"])).filter(F.col("date") == d).collect()}
        want = s.rank()
        assert all((got[t] is None and math.isnan(want[t])) or got[t] == want[t] for t in s.index)
    k = {r.ticker: r.k for r in df.withColumn("k", first_rank("x", ["date"], "ticker")).filter("date = 1").collect()}
    assert k == {"g": 1, "b": 2, "e": 3, "a": 4, "c": 5, "f": 6, "d": None}


@pytest.mark.parametrize("q", [4, 5, 10])  # at 3 the other side rounds some edges down
def test_buckets_match_qcut(spark, q):
    for n in (1, 2, 3, 7, 11, 20, 33):
        df = spark.range(n).select(F.lit(1).alias("date"), F.col("id").alias("ticker"), F.col("id").cast("double").alias("x"))
        got = [r.b for r in df.withColumn("b", X.quantile("x", q, ["date"])).orderBy("x").collect()]
        want = [1] if n == 1 else (pd.qcut(pd.Series(range(1, n + 1)), q, labels=False) + 1).tolist()
        assert got == want


def test_z_without_spread(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", None)], "date int, ticker string, x double")
    out = df.select("date", "ticker", zscore("x", section()).alias("z"), X.z_or_zero("x", ["date"]).alias("z0"), X.winsorised("x", 0.1, ["date"]).alias("w")).collect()
    assert all(r.z is None for r in out) and sorted((r.z0 for r in out), key=str) == [0.0, 0.0, 0.0, None]
    assert X.with_robust_z(df, "x", ["date"], "z").filter("z is not null").count() == 0


def test_asof_frames_are_carried_along(spark):
    """A frame from the current row to the partition's end takes the square of the rows of a key."""
    fast = spark.createDataFrame([("a", i) for i in range(0, 40, 3)], "k string, t int")
    slow = spark.createDataFrame([("a", i, float(i)) for i in range(0, 35, 5)], "k string, s int, v double")
    for strict in (False, True):
        found = J.asof_forward(fast, slow, ["k"], "t", "s", strict=strict)
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
        want = {t: min((s for s in range(0, 35, 5) if s > t or s == t and not strict), default=None) for t in range(0, 40, 3)}
        assert {r.t: r.s for r in found.collect()} == want


def test_abnormal_return_looks_market_days_up_once(spark):
    from datetime import date, timedelta

    from crosspanel.operators import extras as E

    day = lambda i: date(2020, 1, 1) + timedelta(i)
    stock = spark.createDataFrame([("a", day(i), 100.0 + i * i) for i in range(9)], "ticker string, date date, price double")
    market = spark.createDataFrame([(day(i), 50.0 + i) for i in range(9)], "date date, price double")
    events = spark.createDataFrame([("a", day(i % 4), i) for i in range(400)] + [("a", None, 400), ("b", day(1), 401)], "ticker string, at date, id long")
    found = E.abnormal_return(events, stock, market, 2)
    assert found.columns == ["ticker", "at", "id", "own", "market", "abnormal"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan  # the single series meets distinct days, not all events
    got = {r.id: r.abnormal for r in found.collect()}
    want = lambda i: (100 + (i + 2) ** 2) / (100 + i * i) - (52 + i) / (50 + i)
    assert len(got) == 402 and got[401] is None and all(abs(got[i] - want(i % 4)) < 1e-12 for i in range(400))


def test_asof_ties_and_null_values(spark):
    fast = spark.createDataFrame([("a", d) for d in (1, 5, 7)] + [("b", 3)], "k string, t int")
    slow = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("a", 7, 3.0)], "k string, s int, v double")
    f = lambda out: {(r.k, r.t): (r.s, r.v) for r in out.collect()}
    assert f(J.asof_backward(fast, slow, ["k"], "t", "s")) == {("a", 1): (None, None), ("a", 5): (5, None), ("a", 7): (7, 3.0), ("b", 3): (None, None)}
    assert f(J.asof_backward(fast, slow, ["k"], "t", "s", strict=True))["a", 5] == (2, 1.0)
    assert f(J.asof_forward(fast, slow, ["k"], "t", "s"))["a", 5] == (5, None)
    assert f(J.asof_forward(fast, slow, ["k"], "t", "s", strict=True)) == {("a", 1): (2, 1.0), ("a", 5): (7, 3.0), ("a", 7): (None, None), ("b", 3): (None, None)}


def test_metrics_by_hand(spark):
    r = [0.1, -0.05, 0.02, None, -0.01]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(r)] + [("y", 0, 0.1)], "g string, date int, r double")
    m = {q.g: q for q in A.performance(df, "r", ["g"], year=12).collect()}
    s = pd.Series([v for v in r if v is not None])
    nav = (1 + s).cumprod()
    assert m["x"].total_return == pytest.approx(nav.iloc[-1] - 1) and m["x"].max_drawdown == pytest.approx((nav / nav.cummax() - 1).min())
    assert m["x"].annual_volatility == pytest.approx(s.std() * math.sqrt(12)) and m["y"].sortino == math.inf and m["y"].annual_volatility == 0.0


def test_coefficient_drops_pairs_first(spark):
    x, y = [1, 2, 3, None, 5, 5], [2, None, 1, 4, 6, 7]
    df = spark.createDataFrame([(1, float(a) if a else None, float(b) if b else None) for a, b in zip(x, y, strict=True)], "date int, x double, y double")
    want = pd.DataFrame({"x": x, "y": y}, dtype=float).dropna().rank().corr().iloc[0, 1]
    assert A.information_coefficient(df, "x", "y", ["date"]).first().ic == pytest.approx(want)
    assert A.pooled_coefficient(df, "x", "y", 3).first().ic == pytest.approx(want)


def test_turnover_and_weights(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (4, "b", 1.0)], "date int, ticker string, weight double")
    assert [(r.date, r.turnover) for r in A.turnover(w).orderBy("date").collect()] == [(1, 1.0), (2, 0.5), (4, 1.0)]
    s = spark.createDataFrame([(1, t, v, t in "ab" and "s" or "u") for t, v in zip("abcde", [5.0, 4.0, 3.0, 2.0, None], strict=True)], "date int, ticker string, x double, sector string")
    assert {r.ticker for r in P.top_equal(s, "x", 2).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        P.top_equal(s, "x", 0)
    for out in (P.score_weighted(s, "x", 3), P.rank_weighted(s, "x", 3), P.equal_weight(s), P.sector_neutral(s, "x", 3)):
        assert out.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    capped = P.position_cap(P.rank_weighted(s, "x", 4, tau=1.0), 0.4)
    assert capped.agg(F.max("weight")).first()[0] <= 0.4 + 1e-9 and capped.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert P.long_short(s, "x", 1).agg(F.sum("weight")).first()[0] == pytest.approx(0.0)


def test_sector_slots(spark):
    rows = [(1, f"{s}{i}", float(10 * i + (s == "p")), s) for s, n in (("p", 6), ("q", 3), ("r", 1)) for i in range(n)]
    got = P.sector_neutral(spark.createDataFrame(rows, "date int, ticker string, x double, sector string"), "x", 6, least=1, most=3).groupBy("sector").count().collect()
    assert sum(r["count"] for r in got) == 6 and max(r["count"] for r in got) <= 3 and len(got) == 3


def test_effects_sum_to_the_active_return(spark):
    p = spark.createDataFrame([(1, "s", 0.6, 0.1), (1, "t", 0.4, -0.05)], "date int, sector string, weight double, r double")
    b = spark.createDataFrame([(1, "s", 0.3, 0.08), (1, "u", 0.7, 0.01)], "date int, sector string, weight double, r double")
    e = K.brinson(p, b, ["date"]).agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction"))).first()[0]
    assert e == pytest.approx(0.6 * 0.1 - 0.4 * 0.05 - (0.3 * 0.08 + 0.7 * 0.01))


def test_contributions_sum_to_volatility(spark, panel):
    r = panel.withColumn("r", T.simple_return()).filter("ticker in ('A', 'B', 'C')")
    w = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.2)], "ticker string, weight double")
    total = K.risk_contributions(w, K.covariances(r, "r"), 252).agg(F.sum("contribution"), F.sum("share")).first()
    own = P.portfolio_return(w.crossJoin(r.select("date").distinct()).select("date", "ticker", "weight"), r, "r").filter("date > '2021-01-01'")
    assert total[0] == pytest.approx(own.agg(F.stddev_samp("portfolio_return")).first()[0] * math.sqrt(252)) and total[1] == pytest.approx(1.0)


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    f, g = rng.standard_normal((2, 200))
    r = 0.3 + 2 * f - 1 * g + 0.1 * rng.standard_normal(200)
    df = spark.createDataFrame([("a", float(x), float(y), float(z)) for x, y, z in zip(r, f, g, strict=True)], "k string, r double, f double, g double")
    got = {x.factor: x.beta for x in K.factor_exposures(df, "r", ["f", "g"], ["k"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), f, g]), r, rcond=None)[0]
    assert [got["intercept"], got["f"], got["g"]] == pytest.approx(list(want))
    assert K.factor_exposures(df.limit(10), "r", ["f"], ["k"]).count() == 0


def test_valuation(spark):
    df = spark.createDataFrame([(100.0, 0.1), (100.0, None), (-5.0, 0.1)], "fcf double, g double")
    got = [r.v for r in df.select(U.dcf_value("fcf", "g").alias("v")).collect()]
    value = lambda f, g: sum(f * ((1 + g) / 1.1) ** i for i in range(1, 6)) + f * (1 + g) ** 5 * 1.025 / 0.075 / 1.1**5
    assert got[0] == pytest.approx(value(100, 0.1)) and got[1] == pytest.approx(value(100, 0.05)) and got[2] is None


def test_insider_windows(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    rows = [("t", "x", "P", d(0), 10.0), ("t", "y", "P", d(20), 20.0), ("t", "y", "P", d(45), 5.0), ("t", "z", "S", d(1), 1.0), ("t", "x", "P", d(60), 1.0)]
    c = G.insider_clusters(spark.createDataFrame(rows, "ticker string, insider_name string, transaction_type string, transaction_date date, total_value double"))
    assert {(r.start, r.insiders, r.value) for r in c.collect()} == {(d(0), 2, 30.0), (d(45), 2, 6.0)}
    assert G.separate_clusters(c).count() == 2


def test_text_measures(spark):
    df = spark.createDataFrame([(1, "The profit beat. Loss? No loss!"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r for r in N.with_topic(N.with_lexicon_sentiment(df, "text", ["beat", "profit"], ["loss"]), "text", {"a": ["profit", "beat"], "b": ["loss"]}).collect()}
    assert (got[1].n_positive, got[1].n_negative, got[1].sentiment, got[1].topic) == (2, 2, 0.0, "a") and got[2].sentiment == got[3].sentiment == 0.0 and got[3].topic == "other"
    call = spark.createDataFrame([(1, "intro\nJane Doe: hello\nmore\nOperator: first question please\n2021 note: no\nBob: why")], "id int, t string")
    out = N.parse_transcript(call, ["id"], "t").orderBy("section").collect()
    assert [(r.speaker, r.content, r.is_qa) for r in out] == [("Jane Doe", "hello\nmore", False), ("Operator", "first question please\n2021 note: no", True), ("Bob", "why", True)]


def test_validation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 4.0)], "low double, high double")
    rules = {"ordered": "high >= low"}
    assert V.counts(df, rules).first().violations == 2 and [r.low for r in V.violations(df, rules).orderBy("low").collect()] == [3.0, 5.0]
    with pytest.raises(Exception, match="x: ordered"):
        V.require(df, "x", rules).collect()
    assert V.require(df.limit(1), "x", rules).count() == 1


def test_csv_without_all_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("date,ticker,roe\n2021-01-01,A,0.5\n2021-02-01,B,\n")
    df = S.read_csv(spark, f"file://{tmp_path}/f.csv", "date date, ticker string, roe double, roa double")
    assert [tuple(r) for r in df.orderBy("date").collect()] == [(DAY, "A", 0.5, None), (dt.date(2021, 2, 1), "B", None, None)]


def test_shuffled_labels_score_nothing(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 30))
    rows = [(DAY + dt.timedelta(days=i), f"t{j:02d}", float(x[i, j]), float(x[i, j] + 0.5 * rng.standard_normal())) for i in range(60) for j in range(30)]
    df = spark.createDataFrame(rows, "date date, ticker string, x double, y double")
    ic = lambda f: A.ic_summary(A.information_coefficient(f, "x", "y", ["date"])).first().mean_ic
    assert ic(df) > 0.7 and abs(ic(B.shuffled_labels(df, "y"))) < 0.1
    scores = B.walk_forward(df, [DAY + dt.timedelta(days=i) for i in (30, 50)], B.linear_scores(["x"], "y"), 3)
    assert A.information_coefficient(scores.withColumnRenamed("score", "s"), "s", "y", ["date"]).agg(F.min("ic")).first()[0] > 0.5


def test_gbt_scores_order(spark):
    df = spark.createDataFrame([(DAY, f"t{i}", float(i % 17), float((i % 17) ** 2)) for i in range(200)], "date date, ticker string, x double, y double")
    out = B.gbt_scores(["x"], "y", trees=5)(df, df)
    assert out.stat.corr("score", "y") > 0.9


def test_position_factor_by_hand(spark):
    rows = [(-0.2, 0.35, 30), (-0.21, 0.51, 30), (-0.11, 0.36, 20), (-0.11, 0.9, 19), (None, None, 30)]
    df = spark.createDataFrame(rows, "d double, v double, n int")
    assert [r.f for r in df.select(Z.position_factor("d", "v", "n").alias("f")).collect()] == [0.75, 0.25, 0.5625, 0.75, 1.0]
    assert [r.f for r in df.select(Z.volatility_scale("v", "n").alias("f")).collect()][:2] == [pytest.approx(0.15 / 0.35), pytest.approx(0.15 / 0.51)]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), u, float(h)) for h in range(6) for m in (0, 30) for u in ("a", "b")], "ts timestamp, u string, v double")
    e.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in")
    q = Z.event_windows(stream, "ts", "10 minutes", "2 hours", None, ["u"], "v").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = Z.event_windows(e, "ts", "10 minutes", "2 hours", None, ["u"], "v")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))
    q = Z.running_total(stream, "u", "v").writeStream.outputMode("update").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: (r.n, r.total) for r in spark.table("totals").collect()} == {"a": (12, 30.0), "b": (12, 30.0)}


def test_replayed_batch_adds_nothing(spark, tmp_path):
    target = f"file://{tmp_path}/articles"
    write = Z.append_new(target, "url")
    first = spark.createDataFrame([("u1", 1), ("u2", 2), ("u2", 2)], "url string, n int")
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([("u2", 2), ("u3", 3)], "url string, n int"), 1)
    assert sorted(r.url for r in spark.read.parquet(target).collect()) == ["u1", "u2", "u3"]


def test_excess_labels_need_all_entities(spark):
    rows = [(DAY + dt.timedelta(days=i), t, 100.0 + i) for i in range(5) for t in "ab"]
    df = spark.createDataFrame(rows, "date date, ticker string, price double")
    out = L.excess_labels(df, df.groupBy("date").agg(F.avg("price").alias("price")), 2)
    assert out.count() == 6 and out.agg(F.max(F.abs("label"))).first()[0] == pytest.approx(0.0)


def test_nearest_label():
    assert J.nearest_label(["a", "b", "c", "d"], {"a", "d"}, "b") == "a" and J.nearest_label(["a", "b", "c"], {"c"}, "a", "b") == "c" and J.nearest_label(["a"], set(), "a") is None


def test_guarded_rolling(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0])], "ticker string, date int, x double")
    assert column(df.withColumn("m", rolling(F.avg, "x", 3, series(), 2)), "m") == [None, None, 2.0, 3.5]


def test_tone_of_long_filings(spark):
    from crosspanel.operators.text import with_tone

    df = spark.createDataFrame([("x " * 300_000 + "good",)], "html string")
    assert with_tone(df, "html", {"positive": ["good"]}).first().tone_words == 300_001


def test_every_mention_counts(spark):
    """Matches that lie in one another's context, at the ends, and words that only hold the term."""
    import re

    from crosspanel.operators.text import mentions

    texts = ["with a with", "With", "withe éwith with_ (with) " + "x" * 60 + " with", None, ""]
    got = sorted((r.id, r.context) for r in mentions(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), ["id"], "t", {"with": "with"}).collect())
    want = sorted((i, t[max(0, m.start() - 50) : m.end() + 50]) for i, t in enumerate(texts) for m in re.finditer(r"(?i)(?<!\w)with(?!\w)", t or ""))
    assert got == want and len(got) == 5


def test_regime_switch_takes_the_named_scores(spark):
    from crosspanel.plans.backtest import regime_switch

    a, b = (spark.createDataFrame([(d, "t", float(x)) for d in (1, 2)], "date int, ticker string, score double") for x in (10, 20))
    regimes = spark.createDataFrame([(1, "up"), (2, "down")], "date int, regime string")
    assert sorted((r.date, r.score) for r in regime_switch({"up": a, "down": b}, regimes).collect()) == [(1, 10.0), (2, 20.0)]


def test_split_models_fall_back_to_the_nearest(spark):
    from pyspark.sql import functions as F

    from crosspanel.plans.backtest import split_scores

    train = spark.createDataFrame([("a", 1.0)] * 3 + [("c", 5.0)] * 3 + [("b", 9.0)], "regime string, y double")
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "regime string")
    mean = lambda tr, n: n.crossJoin(tr.agg(F.avg("y").alias("score")))
    got = {r.regime: r.score for r in split_scores(train, now, mean, ["a", "b", "c"]).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 5.0}


def test_global_row_numbers(spark):
    from pyspark.sql import functions as F

    from crosspanel.operators.metrics import global_row_number

    df = spark.range(997).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id")
    got = [(r.x, r.id) for r in global_row_number(df, [F.desc("x"), F.col("id")], "n").orderBy("n").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))


def test_dates_in_names(spark):
    from crosspanel.sources.panels import date_in_name, next_trading_day

    names = ["a_20260203_0856.json", "b_20260206_1700", "20260207", "x_20261399", "none", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").withColumn("at", date_in_name("n"))
    got = [(str(r.at) if r.at else None, str(r.day) if r.day else None) for r in df.withColumn("day", next_trading_day("at")).orderBy("i").collect()]
    assert got == [("2026-02-03 08:56:00", "2026-02-03"), ("2026-02-06 17:00:00", "2026-02-09"), ("2026-02-07 00:00:00", "2026-02-09"), (None, None), (None, None), (None, None)]


def test_topic_signal_reads_texts_once(spark):
    df = spark.createDataFrame([("a", "x", "y,z", -0.5), ("a", "x", "", 0.1), ("b", "y", None, None)], "g string, topic string, topic_secondary string, adjusted double")
    found = N.topic_signal(df, ["g"], litigation="x", management="y", earnings="z")
    assert "Union" not in found._jdf.queryExecution().toString()
    got = {r.g: r for r in found.collect()}
    w = [2**0.5, 1.0, 1.0]
    assert math.isclose(got["a"].signal, (w[0] * -0.2 - 0.25 - 0.25) / sum(w)) and got["a"].confidence == 0.2 and got["a"].top_topic == "x"
    assert got["a"].management_alert and not got["a"].litigation_alert and got["b"].signal is None and got["b"].confidence == 0.1
