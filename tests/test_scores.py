"""Scores worked out by hand from their definitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import fundamentals as U
from crosspanel.operators import signals as G
from crosspanel.operators import text as N


def test_composite(spark):
    """a: .5 x .6 + .3 x .2 = .36, both up, one missing: .31, confidence 1 - .1.  b: votes .1 and -.1 do not count.  c: all missing."""
    df = spark.createDataFrame([("a", 0.6, 0.2, None), ("b", 0.1, -0.1, 0.0), ("c", None, None, None), ("d", 0.5, -0.5, 0.5)], "k string, x double, y double, z double")
    got = {r.k: (round(r.composite, 6), r.confidence, r.missing) for r in G.composite(df, {"x": 0.5, "y": 0.3, "z": 0.2}).collect()}
    assert got == {"a": (0.31, 0.9, 1), "b": (0.02, 0.5, 0), "c": (-0.15, 0.2, 3), "d": (0.2, 0.833, 0)}


def test_surprise(spark):
    rows = [
        ("big beat", 0.25, True, None, None, 5), ("streak", 0.25, True, True, None, 5), ("dual", 0.25, True, False, 0.01, 31), ("quality", 0.25, True, True, -0.01, 5), ("dual miss", -0.3, False, None, -0.1, 61),
        ("exactly 20 %", 0.2, True, True, None, 5), ("upgraded", -0.06, False, None, -0.05, 60), ("inline", 0.04, True, True, 0.5, 5), ("small", 0.05, True, None, 0.04, 31),
    ]
    day = dt.date(2024, 6, 1)
    df = spark.createDataFrame([(n, s, b, p, r, day - dt.timedelta(days=d)) for n, s, b, p, r, d in rows], "n string, surprise double, beat boolean, prior_beat boolean, revenue_surprise double, announcement_date date")
    got = {r.n: (r.direction, r.strength, round(r.expected_return, 6), r.freshness, r.hold_days) for r in G.surprise_signal(df, "2024-06-01").collect()}
    assert got == {
        "big beat": ("long", "moderate", 0.0302, "fresh", 40), "streak": ("long", "strong", 0.0302, "fresh", 40), "dual": ("long", "strong", 0.04228, "stale", 20), "quality": ("long", "moderate", 0.02114, "fresh", 40),
        "dual miss": ("short", "strong", -0.04228, "expired", None), "exactly 20 %": ("long", "weak", 0.0184, "fresh", 40), "upgraded": ("short", "moderate", -0.0184, "stale", 20),
        "inline": ("neutral", "weak", 0.0, "fresh", None), "small": ("long", "weak", 0.0184, "stale", None),
    }


def test_insiders(spark):
    """Base: (100 - 60) / (100 + 60 + 1) x .4.  Buys of four: 2 x .15 x .8 = .24; sales of three: -.5 x .15 x .4 = -.03; x .6."""
    trades = spark.createDataFrame([("t", "P", 100.0, 1.0), ("t", "S", 200.0, 0.3), ("u", "P", 2e6, 0.5)], "ticker string, transaction_type string, total_value double, role_weight double")
    clusters = spark.createDataFrame([("t", "P", 4, 0.8), ("t", "S", 3, 0.4)], "ticker string, transaction_type string, insiders long, role_weight double")
    got = {r.ticker: (r.insider_score, r.confidence) for r in G.insider_score(trades, clusters).collect()}
    assert got["t"] == pytest.approx((0.4 * 40 / 161 + 0.6 * 0.21, 0.1 + 0.3)) and got["u"] == pytest.approx((0.4 * 1e6 / (1e6 + 1), 0.05 + 0.2))
    titles = ["CEO and Director", "Chief Financial Officer", "President", "CTO", "Director", "Senior Vice", "EVP Sales", "Officer", "Owner", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    assert [r.w for r in df.select("i", G.role_weight(F.col("t")).alias("w")).orderBy("i").collect()] == [1.0, 0.9, 0.8, 0.7, 0.7, 0.3, 0.5, 0.4, 0.3, 0.3]


def test_sector_boost(spark):
    df = spark.createDataFrame([(f"s{i:02d}", float(-i)) for i in range(11)], "sector string, strength double")
    got = [round(r.boost, 6) for r in G.sector_boost(df).orderBy("rank").collect()]
    assert got == [0.3, 0.2, 0.1, 0, 0, 0, 0, 0, -0.083333, -0.166667, -0.25]


def test_patents(spark):
    """Twenty patents within a year: 5 for number, 25 for speed (20 a year), 12.5 for ten claims, half of them emerging: 12.5."""
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("t", day - dt.timedelta(days=10 * i), "ab"[i % 2], 10) for i in range(20)] + [("u", day - dt.timedelta(days=730), "b", 0)], "ticker string, filing_date date, area string, claims_count int")
    got = {r.ticker: r for r in G.patent_score(df, "2024-01-01", ["a"]).collect()}
    assert got["t"].score == pytest.approx(55) and got["t"]["rank"] == "leader" and got["t"].strength == 0.5 and got["t"].trend == "accelerating" and got["t"].moat == pytest.approx(2 * 10**0.5 / 20)
    assert got["u"].score == pytest.approx(0.25 + 25 * 0.5 / 20) and got["u"]["rank"] == "laggard" and got["u"].velocity == 0.5 and got["u"].trend == "stable"


def test_moat_and_outlook(spark):
    """.2 + .1 + .15 + .08 + .1 + .1 + .1 = .83; the second loses .1 for falling revenue and .1 for debt: 0 at least."""
    rows = [(0.61, 0.2, 6e11, 0.2, 0.21, 0.31, 40.0, 0.1), (0.4, 0.15, 1e11, 0.1, -0.01, 0.3, 201.0, -0.2), (None, None, None, None, None, None, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g double, r double, c double, p double, w double, o double, d double, m double")
    df = df.withColumn("moat", G.moat_score("g", "r", "c", "p", "w", "o", "d"))
    themes = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(x).alias("exposure")) for t, x in (("artificial_intelligence", 0.5), ("x", 0.4), ("y", 0.1), ("z", 1.0))])
    got = df.withColumn("s", G.forward_score("m", "moat", themes)).withColumn("o", G.outlook("s")).orderBy("i").collect()
    assert [round(r.moat, 6) for r in got] == [0.83, 0.0, 0.0] and [r.width for r in df.select("i", G.moat_width("moat").alias("width")).orderBy("i").collect()] == ["wide", "none", "none"]
    theme = 0.5 * 0.3 * 1.5 + 0.4 * 0.3 + 0.1 * 0.3
    assert [r.s for r in got] == pytest.approx([0.06 + 0.53 * 0.18 + theme, -0.12 - 0.054 + theme, -0.054 + theme]) and [r.o for r in got] == ["strong_tailwinds", "tailwinds", "strong_tailwinds"]


def test_penalties(spark):
    """-2.5: 1.5 x .5 + .2 x 2.25 = 1.2.  -50 % in a year: 1.  -60 % from the top: 1.  At the limits nothing."""
    rows = [(0, -2.5, None, None), (1, 0.0, -0.5, -0.6), (2, -1.0, -0.3, -0.4), (3, None, None, None)]
    df = spark.createDataFrame([(i, 1.0, *r) for i, *r in rows], "i int, s double, r double, y double, d double")
    assert [round(r.p, 6) for r in df.select("i", G.penalised("s", "r", "y", "d").alias("p")).orderBy("i").collect()] == [-0.2, -1.0, 1.0, 1.0]


def test_quality_value(spark):
    """Technology: margin .7 is above 1.2 x .55.  20 + 10 + 15 + 10 + 10 of 75 known points; 15 + 12 + 0 of 60.  A negative price to earnings
    gives 0 of 25."""
    columns = "i int, sector string, roe double, roa double, gross_margin double, operating_margin double, debt_equity double, pe_ratio double, pb_ratio double, ps_ratio double"
    rows = [(0, "Technology", 0.15, 0.05, 0.7, 0.1, 90.0, 20.0, 4.0, 12.0), (1, "Energy", None, None, None, None, None, -3.0, None, None), (2, "?", 0.3, None, 0.4, None, 0.5, 14.0, None, None)]
    got = U.quality_value(spark.createDataFrame(rows, columns)).orderBy("i").collect()
    assert [r.quality_score for r in got] == pytest.approx([100 * 65 / 80, 0.0, 100 * 45 / 50]) and [r.value_score for r in got] == pytest.approx([100 * 27 / 60, 0.0, 100.0])
    assert [(r.quality_grade, r.value_grade, r.direction, r.strength) for r in got] == [("A", "D", None, "none"), ("F", "F", "short", "strong"), ("A", "A", "long", "strong")]


def test_pioneers(spark):
    """One term, four months ahead, faded by half over 24 months: 2 months.  .3 / 8 + .4 / 4 + .3 x 2 / 12; with a sector weight of 2: .5 / 4
    + .5 x 4 / 12 makes a quarter."""
    day = dt.date(2022, 1, 1)
    first = spark.createDataFrame([("e", "ai", day)], "entity string, term string, first_date date")
    lines = spark.createDataFrame([("ai", day + dt.timedelta(days=122))], "term string, median_date date")
    as_of = day + dt.timedelta(days=round(24 * 30.44))
    lead = 122 / 30.44 * 0.5 ** (round(24 * 30.44) / 30.44 / 24)
    base = 0.3 / 8 + 0.1 + 0.3 * lead / 12
    one = N.pioneer_score(first, lines, "entity", "term", str(as_of), ["ai"]).first()
    assert one.lead_months == pytest.approx(lead) and one.score == pytest.approx(base)
    weights = spark.createDataFrame([("e", "ai", 2.0)], "entity string, term string, weight double")
    two = N.pioneer_score(first, lines, "entity", "term", str(as_of), ["ai"], relevance=weights).first()
    assert two.score == pytest.approx(0.75 * base + 0.25 * (0.5 / 4 + 0.5 * 2 * lead / 12))


def test_monthly_clusters_against_a_loop(spark):
    """Random trades: start from each trade in turn, skip months that have a cluster, look at both sides."""
    import random

    rng = random.Random(8)
    day = dt.date(2024, 1, 1)
    rows = [(rng.choice("ab"), f"w{rng.randrange(6)}", rng.choice("AD"), day + dt.timedelta(days=rng.randrange(300)), float(rng.randrange(100))) for _ in range(160)]
    want = set()
    for ticker in "ab":
        own, used = sorted((r for r in rows if r[0] == ticker), key=lambda r: r[3]), set()
        for r in own:
            month = r[3].replace(day=1)
            if month in used:
                continue
            window = [x for x in own if r[3] <= x[3] <= r[3] + dt.timedelta(days=12)]
            for side in "AD":
                found = [x for x in window if x[2] == side]
                if len({x[1] for x in found}) >= 3:
                    want.add((ticker, month, side, min(x[3] for x in found), max(x[3] for x in found), len({x[1] for x in found}), sum(x[4] for x in found)))
                    used.add(month)
    df = spark.createDataFrame(rows, "ticker string, insider_name string, transaction_type string, transaction_date date, total_value double")
    got = {tuple(r) for r in G.monthly_clusters(df, 12, 3).collect()}
    assert got == want and len({(t, m) for t, m, *_ in want}) > 8 and len(want) > len({(t, m) for t, m, *_ in want})


def test_earnings_signal(spark):
    """a: mean .3 of two on the topic, the model agrees: (.6 x .5 + 2 / 3 x .3 + .2) x 1.4 = .98.  b: the model contradicts; c: nothing on
    the topic; d: neutral."""
    rows = [("a", True, 0.2, 0.1), ("a", True, 0.4, None), ("a", False, -1.0, -1.0), ("b", True, -0.5, 0.3), ("c", False, 1.0, 1.0), ("c", None, 1.0, 1.0), ("d", True, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "k string, is_earnings boolean, sentiment double, model_score double")
    got = {r.k: (r.articles, r.on_topic, r.direction, r.agree, r.tradeable, round(r.confidence, 6), round(r.score, 6), r.expected_return) for r in N.earnings_signal(df, ["k"]).collect()}
    assert got == {
        "a": (3, 2, "bullish", True, True, 0.98, round(0.3 * 2**0.5 * 1.4, 6), 0.0068), "b": (1, 1, "bearish", False, True, 0.6, -0.5, 0.0003),
        "c": (2, 0, None, None, False, 0.0, 0.0, None), "d": (1, 1, "neutral", True, False, 0.4, 0.1, 0.0038),
    }
