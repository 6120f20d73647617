"""Queries for the smaller steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.operators import extras as E
from crosspanel.operators import signals as G
from crosspanel.plans.panel_queries import _M, W, _momentum
from crosspanel.plans.registry import BENCH, PRICES, benchmark, prices, query, rounded


@query("a29_trade_summary", "SELECT CAST(ts AS DATE) AS day, count(*) AS trades, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'click') AS sells, count(*) FILTER (user_id % 2 = 0) AS filled, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS bought, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 2) AS sold, round(avg(CASE WHEN value > 50 THEN value - 50 ELSE 0 END), 4) AS mean_slippage, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def _(t):
    e = t("events").select("ts", "user_id", "value", F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "click", "sell").otherwise("none").alias("action"), F.when(F.col("user_id") % 2 == 0, "filled").otherwise("open").alias("status"), F.when(F.col("value") > 50, F.col("value") - 50).alias("slip"))
    d = E.trade_summary(e, F.col("ts").cast("date"), "action", "status", "value", "slip", "user_id")
    return d.withColumn("bought", F.round("bought", 2)).withColumn("sold", F.round("sold", 2)).withColumn("mean_slippage", F.round("mean_slippage", 4))


@query("p02_prefix_rename", "SELECT n_nationkey, n_name AS tech_n_name, n_regionkey AS tech_n_regionkey FROM nation")
def _(t):
    return E.prefixed(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "tech_", ["n_nationkey"])


@query("p01_core_features", "SELECT p_partkey, p_size FROM part")
def _(t):
    return E.core_only(t("part"), ["p_partkey"], ["p_size", "absent"])


@query("p08_meaningful_trades", "SELECT event_id FROM events WHERE user_id % 10 <> 0 AND event_type IN ('click', 'purchase') AND value * 100 >= 1000")
def _(t):
    e = t("events").select("event_id", (F.col("user_id") % 10 == 0).alias("is_10b5_1"), F.when(F.col("event_type") == "click", "P").when(F.col("event_type") == "purchase", "S").otherwise("M").alias("transaction_type"), (F.col("value") * 100).alias("total_value"))
    return G.meaningful_trades(e).select("event_id")


_EV = "ev AS (SELECT p_brand AS ticker, DATE '1995-06-01' + CAST(p_size AS INTEGER) AS day, p_partkey AS id FROM part)"


@query("l10_abnormal_return", f"WITH panel AS ({PRICES}), s AS (SELECT ticker, date AS d, lead(price, 4) {W} / price - 1 AS own FROM panel), m AS (SELECT date AS d, lead(price, 4) OVER (ORDER BY date) / price - 1 AS market FROM ({BENCH})), {_EV}, a AS (SELECT ev.*, own FROM ev ASOF LEFT JOIN s ON ev.ticker = s.ticker AND ev.day <= s.d) SELECT id, round(own - market, 4) AS abnormal FROM a ASOF LEFT JOIN m ON a.day <= m.d")
def _(t):
    p = prices(t)
    ev = t("part").select(F.col("p_brand").alias("ticker"), F.date_add(F.lit("1995-06-01").cast("date"), F.col("p_size")).alias("at"), F.col("p_partkey").alias("id"))
    return rounded(E.abnormal_return(ev, p, benchmark(p), 4).select("id", "abnormal"))


@query("n06_topic_ic_blend", "WITH s AS (SELECT c_nationkey AS k, c_mktsegment AS topic, avg(c_acctbal) / 10000 AS s, count(*) AS n, length(c_mktsegment) / 100.0 - 0.085 AS ic FROM customer GROUP BY 1, 2), g AS (SELECT k, sum(abs(ic) * sqrt(n) * sign(ic) * s) / sum(abs(ic) * sqrt(n)) AS x, least(sum(n) / 20, 1) AS c FROM s GROUP BY 1) SELECT k, round(x, 6) AS ic_score, round((1 - least(0.6, 0.2 + 0.4 * c)) * 0.1 + least(0.6, 0.2 + 0.4 * c) * x, 6) AS blended FROM g")
def _(t):
    s = t("customer").groupBy(F.col("c_nationkey").alias("k"), "c_mktsegment").agg((F.avg("c_acctbal") / 10000).alias("sentiment"), F.count("*").alias("n")).withColumn("ic", F.length("c_mktsegment") / 100.0 - 0.085)
    g = E.topic_ic_score(s, ["k"])
    return rounded(g.select("k", "ic_score", E.blended_score(F.lit(0.1), "ic_score", "ic_confidence").alias("blended")), digits=6)


@query("n12_peer_gap", "WITH s AS (SELECT s_suppkey, s_nationkey AS g, s_acctbal / 10000 AS v FROM supplier), o AS (SELECT *, count(v) OVER (PARTITION BY g) AS n, (sum(v) OVER (PARTITION BY g) - v) / nullif(count(v) OVER (PARTITION BY g) - 1, 0) AS o FROM s) SELECT s_suppkey, round(CASE WHEN n - 1 >= 2 THEN greatest(least((v - o) * 3, 1), -1) END, 6) AS gap FROM o")
def _(t):
    s = t("supplier").withColumn("v", F.col("s_acctbal") / 10000)
    return rounded(s.select("s_suppkey", E.peer_gap(s, "v", "s_nationkey").alias("gap")), digits=6)


@query("s19_quarter_snapshots", "WITH q AS (SELECT o_orderpriority AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS d, CAST(count(*) AS DOUBLE) AS rev, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS inc, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS eq FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(rev, 4) OVER (PARTITION BY ticker ORDER BY d) AS b FROM q) SELECT ticker, d + 60 AS date, round(inc / rev, 4) AS net_margin, round(inc * 4 / eq, 4) AS roe, rev * 4 AS revenue_ttm, round((rev - b) / abs(b), 4) AS revenue_growth_1y FROM l")
def _(t):
    q = t("orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("report_date")).agg(F.count("*").cast("double").alias("rev"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).cast("double").alias("inc"), F.count_distinct("o_custkey").cast("double").alias("eq"))
    return rounded(E.quarter_snapshots(q, "rev", "inc", "eq"), "revenue_ttm")


@query("u17_filing_yield", f"""WITH panel AS ({PRICES}), pt AS (SELECT p_brand AS ticker, DATE '1996-03-31' + CAST(p_size AS INTEGER) AS day, p_retailprice AS fcf, p_size AS shares FROM part), pe AS (SELECT ticker, min(day) AS period_end, sum(fcf) AS fcf, sum(shares) AS shares FROM pt GROUP BY 1),
 fi AS (SELECT DISTINCT ticker, day + 3 AS filed FROM pt), ne AS (SELECT pe.*, filed, row_number() OVER (PARTITION BY ticker ORDER BY abs(filed - period_end), filed) AS k FROM pe JOIN fi USING (ticker) WHERE filed - period_end BETWEEN -10 AND 10), n1 AS (SELECT * FROM ne WHERE k = 1)
 SELECT n1.ticker, filed, panel.date AS priced, round(fcf * 4 / nullif(price * shares, 0), 4) AS fcf_yield FROM n1 ASOF LEFT JOIN panel ON n1.ticker = panel.ticker AND n1.filed < panel.date""")
def _(t):
    p = prices(t).select("ticker", "date", "price")
    part = t("part").select(F.col("p_brand").alias("ticker"), F.date_add(F.lit("1996-03-31").cast("date"), F.col("p_size")).alias("day"), F.col("p_retailprice").alias("fcf"), F.col("p_size").alias("shares"))
    periods = part.groupBy("ticker").agg(F.min("day").alias("period_end"), F.sum("fcf").alias("fcf"), F.sum("shares").alias("shares"))
    return rounded(E.filing_yield(periods, part.select("ticker", F.date_add("day", 3).alias("filed")).distinct(), p).select("ticker", "filed", "priced", "fcf_yield"))


@query("n43_risk_adjusted", "SELECT c_custkey, round(greatest(least(c_acctbal / 10000 - 0.2 * (c_nationkey / 25.0) + 0.15 * coalesce(CASE WHEN c_nationkey > 5 THEN 0.4 END, 0), 1), -1), 6) AS score FROM customer")
def _(t):
    c = t("customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("s"), (F.col("c_nationkey") / 25.0).alias("r"), F.when(F.col("c_nationkey") > 5, 0.4).alias("a"))
    return rounded(c.select("c_custkey", E.risk_adjusted("s", "r", "a").alias("score")), digits=6)


@query("a30_pruned_features", f"""{_M}, f AS (SELECT *, lead(price, 4) {W} / price - 1 AS y, x * x AS z FROM m), c AS (SELECT unnest(['x', 'r', 'z']) AS feature, unnest([abs(corr(x, y)), abs(corr(r, y)), abs(corr(z, y))]) AS c FROM f),
 l AS (SELECT *, greatest(0.01, quantile_cont(c, 0.4) OVER ()) AS low, row_number() OVER (ORDER BY c DESC, feature) AS k FROM c), n AS (SELECT *, count(*) FILTER (c >= low) OVER () AS n FROM l) SELECT feature FROM n WHERE CASE WHEN n >= 2 THEN c >= low ELSE k <= 2 END""")
def _(t):
    from crosspanel.operators.labels import forward_return
    from crosspanel.operators.metrics import prune_by_coefficient

    m = _momentum(t).withColumn("y", forward_return(4)).withColumn("z", F.col("x") * F.col("x"))
    names = prune_by_coefficient(m, ["x", "r", "z"], "y", keep=2)
    return m.sparkSession.createDataFrame([(n,) for n in names], "feature string")
