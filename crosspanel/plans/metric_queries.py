"""Queries for labels, joins and metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from crosspanel.functions.columns import series
from crosspanel.operators import joins as J
from crosspanel.operators import labels as L
from crosspanel.operators import metrics as A
from crosspanel.operators import technical as T
from crosspanel.plans.panel_queries import W, XS, _M, _R, _momentum, _returns
from crosspanel.plans.registry import BENCH, PRICES, benchmark, over, prices, query, roll, rounded

_F = f"{_M}, f AS (SELECT *, lead(price, 4) {W} / price - 1 AS y FROM m)"


def _forward(t):
    return _momentum(t).withColumn("y", L.forward_return(4))


@query("l01_forward_return", f"{_F} SELECT date, ticker, round(y, 4) AS y FROM f")
def _(t):
    return rounded(_forward(t).select("date", "ticker", "y"))


@query("l02_vol_normalised_target", f"""{_R}, s AS (SELECT *, {roll('stddev_samp', 'lr', 20, 10)} AS s, lead(price, 4) {W} / price - 1 AS f FROM r), y AS (SELECT *, f / (s * sqrt(4) + 1e-8) AS y FROM s),
 c AS (SELECT *, avg(y) OVER (PARTITION BY ticker) AS m, stddev_samp(y) OVER (PARTITION BY ticker) AS d, count(y) OVER (PARTITION BY ticker) AS k FROM y)
 SELECT date, ticker, round(CASE WHEN k > 10 AND d > 0 AND y IS NOT NULL THEN greatest(least(y, m + 3 * d), m - 3 * d) ELSE y END, 4) AS target FROM c""")
def _(t):
    return rounded(L.targets(prices(t), "vol_norm", 4).select("date", "ticker", "target"))


@query("l03_rank_target", f"{_F}, k AS (SELECT *, CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY y NULLS LAST) END AS k, count(*) OVER (PARTITION BY date, y) AS e, count(y) {XS} AS n FROM f) SELECT date, ticker, round(CASE WHEN n >= 2 THEN (k + (e - 1) / 2.0 - 1) / (n - 1) END, 4) AS target FROM k")
def _(t):
    return rounded(L.targets(prices(t), "rank", 4).select("date", "ticker", "target"))


_MK = f"mk AS (SELECT date, lead(price, 4) OVER (ORDER BY date) / price - 1 AS market FROM ({BENCH}))"


@query("l04_orthogonal_target", f"{_F}, {_MK}, x AS (SELECT f.*, y - market AS e FROM f LEFT JOIN mk USING (date)) SELECT date, ticker, round(CASE WHEN count(e) {XS} >= 3 THEN e - avg(e) OVER (PARTITION BY date, sector) ELSE y END, 4) AS target FROM x")
def _(t):
    panel = prices(t)
    market = benchmark(panel).select("date", L.forward_return(4, w=series([], "date")).alias("market"))
    return rounded(L.targets(panel.join(market, "date", "left"), "ortho", 4).select("date", "ticker", "target"))


@query("l06_flat_target", f"{_F} SELECT date, ticker, round(y, 4) AS y FROM f WHERE y IS NOT NULL")
def _(t):
    return rounded(_forward(t).select("date", "ticker", "y").dropna())


@query("l07_excess_label", f"{_F}, {_MK}, x AS (SELECT f.*, y - market AS label FROM f LEFT JOIN mk USING (date)) SELECT date, ticker, round(label, 4) AS label FROM x QUALIFY count(label) {XS} = count(*) {XS}")
def _(t):
    panel = prices(t)
    return rounded(L.excess_labels(panel, benchmark(panel), 4).select("date", "ticker", "label"))


@query("l08_training_frame", f"{_F} SELECT date, ticker, round(x, 4) AS x, round(coalesce(r, 0), 4) AS r, round(y, 4) AS y FROM f WHERE x IS NOT NULL AND y IS NOT NULL")
def _(t):
    return rounded(L.training_frame(_forward(t), ["x"], ["r"], "y").select("date", "ticker", "x", "r", "y"))


@query("l11_sample_weights", f"WITH panel AS ({PRICES}), e AS (SELECT *, exp(0.5 / (SELECT count(DISTINCT date) FROM panel) * (dense_rank() OVER (ORDER BY date) - 1)) AS e FROM panel) SELECT date, ticker, round(e / avg(e) OVER (), 4) AS weight FROM e")
def _(t):
    return rounded(L.sample_weights(prices(t)).select("date", "ticker", "weight"))


_O = "SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders"


def _orders(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("v"))


@query("j01_j11_inner_joins", f"{_R}, b AS ({BENCH}) SELECT r.date, ticker, round(r.price / b.price, 4) AS ratio FROM r JOIN b ON r.date = b.date")
def _(t):
    p = prices(t)
    return rounded(p.join(benchmark(p).withColumnRenamed("price", "b"), "date").select("date", "ticker", (F.col("price") / F.col("b")).alias("ratio")))


@query("j02_conditional_aggregation", "SELECT CAST(ts AS DATE) AS d, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}, round(coalesce(avg(value) FILTER (event_type = '{e}'), 0), 4) AS v_{e}" for e in ("click", "purchase")) + " FROM events GROUP BY 1")
def _(t):
    e = t("events").withColumn("d", F.col("ts").cast("date"))
    return rounded(e.groupBy("d").agg(*[x for k in ("click", "purchase") for x in (F.count(F.when(F.col("event_type") == k, 1)).alias(f"n_{k}"), F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)).alias(f"v_{k}"))]))


@query("j03_join_on_quarter", "WITH a AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, round(sum(o_totalprice), 2) AS orders FROM orders GROUP BY 1), b AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1) SELECT a.q, orders, shipped FROM a JOIN b ON a.q = b.q")
def _(t):
    a = t("orders").groupBy(F.date_trunc("quarter", "o_orderdate").cast("date").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("orders"))
    b = t("lineitem").groupBy(F.date_trunc("quarter", "l_shipdate").cast("date").alias("q")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    return a.join(b, "q")


_LAST = "s AS (SELECT k, d AS sd, max_by(v, id) AS sv FROM o GROUP BY 1, 2)"
_E = "e AS (SELECT c_custkey AS k, DATE '1996-01-15' AS day, c_name AS name FROM customer)"


def _snapshots(t):
    return _orders(t).groupBy("k", "d").agg(F.max_by("v", "id").alias("sv")).withColumnRenamed("d", "sd")


@query("j04_asof_backward", f"WITH o AS ({_O}), {_LAST}, {_E} SELECT e.k, name, day, s.sd, s.sv FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.day >= s.sd")
def _(t):
    e = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("1996-01-15").cast("date").alias("day"))
    return J.asof_backward(e, _snapshots(t), ["k"], "day", "sd").select("k", "name", "day", "sd", "sv")


@query("j05_asof_forward_strict", f"WITH o AS ({_O}), {_LAST}, {_E} SELECT e.k, name, day, s.sd, s.sv FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.day < s.sd")
def _(t):
    e = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("1996-01-15").cast("date").alias("day"))
    return J.asof_forward(e, _snapshots(t), ["k"], "day", "sd", strict=True).select("k", "name", "day", "sd", "sv")


_PARTS = "ev AS (SELECT p_brand AS ticker, DATE '1995-06-01' + CAST(p_size AS INTEGER) AS day, p_partkey AS id FROM part)"


def _events(t):
    return t("part").select(F.col("p_brand").alias("ticker"), F.date_add(F.lit("1995-06-01").cast("date"), F.col("p_size")).alias("day"), F.col("p_partkey").alias("id"))


@query("j06_l09_forward_rows", f"WITH panel AS ({PRICES}), p AS (SELECT ticker, date AS pd, price, lead(price, 1) {W} AS p1, lead(price, 5) {W} AS p5 FROM panel), {_PARTS} SELECT id, ev.ticker, day, pd, round(price, 4) AS price, round(p1 / price - 1, 4) AS fwd_1, round(p5 / price - 1, 4) AS fwd_5 FROM ev ASOF LEFT JOIN p ON ev.ticker = p.ticker AND day <= pd")
def _(t):
    p = prices(t).select("ticker", F.col("date").alias("pd"), "price")
    return rounded(J.forward_rows(_events(t), p, ["ticker"], "day", "pd", "price", [1, 5]).select("id", "ticker", "day", "pd", "price", "fwd_1", "fwd_5"))


@query("j07_forward_days", f"WITH panel AS ({PRICES}), p AS (SELECT ticker, date AS later_date, price AS later_price FROM panel), {_PARTS} SELECT id, ev.ticker, day, later_date, round(later_price, 4) AS later_price FROM ev ASOF LEFT JOIN p ON ev.ticker = p.ticker AND day + 60 <= later_date")
def _(t):
    p = prices(t).select("ticker", F.col("date").alias("pd"), "price")
    return rounded(J.forward_days(_events(t), p, ["ticker"], "day", "pd", "price", 60).select("id", "ticker", "day", "later_date", "later_price"))


@query("j08_nearest_within", f"WITH o AS ({_O}) SELECT a.id, b.id AS near FROM o a JOIN o b ON a.k = b.k AND b.d - a.d BETWEEN 15 AND 100 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(b.d - a.d - 0), b.d, b.id) = 1")
def _(t):
    o = _orders(t)
    return J.nearest_within(o.select("id", "k", "d"), o.select(F.col("id").alias("near"), "k", F.col("d").alias("e")), ["k"], "d", "e", 15, 100, ties="near").select("id", "near")


@query("j09_benchmark_excess", f"WITH panel AS ({PRICES}), b AS (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS rb FROM ({BENCH})) SELECT date, ticker, round(price / lag(price) {W} - 1 - rb, 4) AS excess FROM panel LEFT JOIN b USING (date)")
def _(t):
    p = prices(t)
    b = benchmark(p).select("date", T.simple_return(w=series([], "date")).alias("rb"))
    return rounded(T.with_benchmark(p.withColumn("r", T.simple_return()), b).select("date", "ticker", (F.col("r") - F.col("rb")).alias("excess")))


@query("j10_dimension_defaults", "SELECT s_suppkey, coalesce(n_name, 'Unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def _(t):
    n = t("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return J.with_dimension(t("supplier"), n, "s_nationkey", {"nation": "Unknown"}).select("s_suppkey", "nation")


@query("j12_outer_zero", "WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS DOUBLE) AS w FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(count(*) AS DOUBLE) AS w FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) SELECT k, coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b FROM a FULL JOIN b USING (k)")
def _(t):
    a = t("customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("w"))
    b = t("supplier").filter("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").cast("double").alias("w"))
    return J.outer_zero(a, b, ["k"], "w")


@query("j13_s15_semi_anti", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(t):
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    c = J.in_not_in(c, t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k")), None, "k")
    return J.in_not_in(c, None, t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("j14_s21_grid", "SELECT d, r_name FROM (SELECT CAST(unnest(generate_series(DATE '2020-01-31', DATE '2020-12-31', INTERVAL 1 MONTH)) AS DATE) AS s), region, LATERAL (SELECT last_day(s) AS d)")
def _(t):
    from crosspanel.sources.panels import month_ends, placeholder

    return placeholder(month_ends(t("region").sparkSession, "2020-01-31", "2020-12-31", "d"), t("region").select("r_name"), []).select("d", "r_name")


@query("j15_nearest_vectors", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[64] AS a FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS v FROM embeddings),
 s AS (SELECT query, id, array_cosine_similarity(a, v) AS similarity FROM q JOIN b ON query <> id) SELECT query, id, round(similarity, 4) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS BIGINT) AS rank FROM s QUALIFY rank <= 10""")
def _(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(J.nearest_vectors(e.filter("id % 100 = 0"), e, 10))


_PERF = f"WITH panel AS ({PRICES}), r AS (SELECT *, price / lag(price) {W} - 1 AS r FROM panel)"


@query("a01_cumulative_return", f"{_PERF} SELECT date, ticker, round(product(1 + r) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 4) AS cumulative FROM r WHERE r IS NOT NULL")
def _(t):
    return rounded(_returns(t).filter("r is not null").select("date", "ticker", A.cumulative_return("r", ["ticker"]).alias("cumulative")))


@query("a02_a03_a04_a06_performance", f"""{_PERF}, n AS (SELECT ticker, date, product(1 + r) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM r WHERE r IS NOT NULL),
 d AS (SELECT ticker, min(d) AS max_drawdown FROM (SELECT ticker, nav / max(nav) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM n) GROUP BY 1),
 b AS (SELECT ticker, product(1 + r) - 1 AS total_return, pow(product(1 + r), 52.0 / count(r)) - 1 AS annual_return, stddev_samp(r) * sqrt(52) AS annual_volatility, stddev_samp(r) FILTER (r < 0) * sqrt(52) AS down,
  avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END) AS hit_rate, avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) AS win_loss, count(r) AS n FROM r GROUP BY 1)
 SELECT ticker, round(total_return, 4) AS total_return, round(annual_return, 4) AS annual_return, round(annual_volatility, 4) AS annual_volatility, round(annual_return / annual_volatility, 4) AS sharpe, round(annual_return / down, 4) AS sortino,
  round(hit_rate, 4) AS hit_rate, round(win_loss, 4) AS win_loss, n, round(max_drawdown, 4) AS max_drawdown, round(annual_return / abs(max_drawdown), 4) AS calmar FROM b JOIN d USING (ticker)""")
def _(t):
    return rounded(A.performance(_returns(t), "r", ["ticker"], year=52))


@query("a05_information_ratio", f"WITH panel AS ({PRICES}), b AS (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS rb FROM ({BENCH})), x AS (SELECT ticker, price / lag(price) {W} - 1 - rb AS x FROM panel LEFT JOIN b USING (date)) SELECT ticker, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(avg(x) * 52 / (stddev_samp(x) * sqrt(52)), 4) AS information_ratio FROM x WHERE x IS NOT NULL GROUP BY 1")
def _(t):
    p = prices(t)
    b = benchmark(p).select("date", T.simple_return(w=series([], "date")).alias("rb"))
    return rounded(A.information_ratio(T.with_benchmark(p.withColumn("r", T.simple_return()), b), "r", "rb", ["ticker"], 52))


_IC = f"""{_F}, g AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL),
 k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS b FROM g),
 ics AS (SELECT date, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 3)"""


def _ics(t):
    return A.information_coefficient(_forward(t), "x", "y", ["date"])


@query("a08_ic_summary", f"{_IC} SELECT round(avg(ic), 4) AS mean_ic, round(stddev_samp(ic), 4) AS std_ic, round(avg(ic) / stddev_samp(ic), 4) AS ic_ir, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, count(ic) AS n FROM ics")
def _(t):
    return rounded(A.ic_summary(_ics(t)))


@query("a09_rolling_ic", f"{_IC} SELECT date, round(avg(ic) {over(12, 'ORDER BY date')}, 4) AS ic12 FROM ics")
def _(t):
    return rounded(_ics(t).select("date", A.rolling_ic("ic", 12, []).alias("ic12")))


@query("a10_pooled_ic", f"{_F}, g AS (SELECT x, y FROM f WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM g) SELECT round(corr(a, b), 4) AS ic, count(*) AS n FROM k")
def _(t):
    return rounded(A.pooled_coefficient(_forward(t), "x", "y"))


_BUCKETS = f"{_F}, g AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, ticker) AS k, count(*) {XS} AS n FROM g), q AS (SELECT *, CAST(CASE WHEN n > 1 THEN greatest(1, ceil((k - 1) * 5 / (n - 1)::DOUBLE)) ELSE 1 END AS BIGINT) AS bucket FROM k)"


@query("a11_quantile_returns", f"{_BUCKETS}, d AS (SELECT date, bucket, avg(y) AS y FROM q GROUP BY 1, 2) SELECT bucket, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, count(*) AS n FROM d GROUP BY 1")
def _(t):
    return rounded(A.quantile_returns(_forward(t), "x", "y"))


@query("a11_long_short_spread", f"{_BUCKETS} SELECT date, round(avg(y) FILTER (bucket = 5) - avg(y) FILTER (bucket = 1), 4) AS spread FROM q GROUP BY 1 HAVING avg(y) FILTER (bucket = 5) - avg(y) FILTER (bucket = 1) IS NOT NULL")
def _(t):
    return rounded(A.long_short_spread(_forward(t), "x", "y"))


@query("a12_importance_by_category", "WITH s AS (SELECT CASE WHEN starts_with(p_type, 'PROMO') THEN 'promo' WHEN starts_with(p_type, 'S') THEN 'small' ELSE 'other' END AS category, sum(p_size) AS total FROM part WHERE p_size <> 0 GROUP BY 1) SELECT category, CAST(total AS BIGINT) AS total, round(total / sum(total) OVER (), 4) AS share FROM s")
def _(t):
    return rounded(A.importance_by_category(t("part"), "p_type", "p_size", {"PROMO": "promo", "S": "small"}))


_TOP = f"{_M}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS k FROM m WHERE x IS NOT NULL), w AS (SELECT date, ticker, 1.0 / count(*) {XS} AS weight FROM k WHERE k <= 5)"


def _top(t):
    from crosspanel.operators.portfolio import top_equal

    return top_equal(_momentum(t).filter("x is not null"), "x", 5)


@query("a13_turnover", f"""{_TOP}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM w)), g AS (SELECT d.date, d.k, e.ticker, coalesce(w.weight, 0) AS weight FROM d CROSS JOIN (SELECT DISTINCT ticker FROM w) e LEFT JOIN w ON w.date = d.date AND w.ticker = e.ticker),
 c AS (SELECT date, k, weight, lag(weight) OVER (PARTITION BY ticker ORDER BY k) AS p FROM g) SELECT date, round(sum(CASE WHEN k = 1 THEN greatest(weight, 0) ELSE abs(weight - p) / 2 END), 4) AS turnover FROM c GROUP BY 1""")
def _(t):
    return rounded(A.turnover(_top(t)))


@query("a14_net_returns", f"""{_TOP}, f AS (SELECT date, ticker, lead(price, 1) {W} / price - 1 AS f FROM m), p AS (SELECT w.date, sum(weight * f) AS r FROM w JOIN f ON w.date = f.date AND w.ticker = f.ticker GROUP BY 1) SELECT date, round(r - 0.3 * (10 / 1e4 * 2), 4) AS net FROM p WHERE r IS NOT NULL""")
def _(t):
    from crosspanel.operators.portfolio import portfolio_return

    fwd = _momentum(t).select("date", "ticker", L.forward_return(1).alias("f"))
    out = portfolio_return(_top(t), fwd, "f").filter("portfolio_return is not null").withColumn("turnover", F.lit(0.3))
    return rounded(out.select("date", A.net_return("portfolio_return", "turnover").alias("net")))


@query("a15_ic_weights", f"{_IC}, l AS (SELECT date, ic, lag(ic) OVER (ORDER BY date) AS b FROM ics), p AS (SELECT date, greatest(coalesce(avg(ic) {over(6, 'ORDER BY date')}, 0), 0) AS a, greatest(coalesce(avg(b) {over(6, 'ORDER BY date')}, 0), 0) AS b FROM l), w AS (SELECT date, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS w FROM p) SELECT date, round(greatest(w, 0.1) / (greatest(w, 0.1) + greatest(1 - w, 0.1)), 4) AS weight_a, round(greatest(1 - w, 0.1) / (greatest(w, 0.1) + greatest(1 - w, 0.1)), 4) AS weight_b FROM w")
def _(t):
    ics = _ics(t)
    return rounded(A.ic_weights(ics.withColumn("b", F.lag("ic").over(series([], "date"))), "ic", "b", 6, 0.1))


_EV = "WITH e AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, value - 50 AS v FROM events), s AS (SELECT ticker, date, avg(v) AS sent_mean, coalesce(stddev_samp(v), 0) AS sent_std, count(v) AS sent_count, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END) AS share_negative FROM e WHERE v IS NOT NULL GROUP BY 1, 2)"


def _sentiment(t):
    e = t("events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date"), (F.col("value") - 50).alias("v"))
    return A.daily_sentiment(e, "v", ["ticker", "date"])


@query("a16_daily_sentiment", f"{_EV} SELECT ticker, date, round(sent_mean, 4) AS sent_mean, round(sent_std, 4) AS sent_std, sent_count, round(share_positive, 4) AS share_positive, round(share_negative, 4) AS share_negative FROM s")
def _(t):
    return rounded(_sentiment(t))


@query("a17_sentiment_features", f"""{_EV} SELECT ticker, date, round({roll('avg', 'sent_mean', 5, 1)}, 6) AS ma5, round({roll('avg', 'sent_mean', 20, 5)}, 6) AS ma20, round(sent_mean - lag(sent_mean, 5) {W}, 6) AS change5, round(sum(sent_mean) {over(5)}, 6) AS sum5,
 round((sent_mean - {roll('avg', 'sent_mean', 20, 10)}) / greatest({roll('stddev_samp', 'sent_mean', 20, 10)}, 0.01), 6) AS z20, round(CASE WHEN count(*) {over(20)} >= 5 THEN (sent_count - avg(sent_count) {over(20)}) / greatest(stddev_samp(sent_count) {over(20)}, 0.1) END, 6) AS volume_z FROM s""")
def _(t):
    return rounded(A.with_sentiment_features(_sentiment(t)).select("ticker", "date", "ma5", "ma20", "change5", "sum5", "z20", "volume_z"), digits=6)


@query("a18_slope", f"{_R}, i AS (SELECT *, row_number() {W} AS i FROM r) SELECT date, ticker, round(CASE WHEN count(price) {over(20)} >= 20 THEN regr_slope(price, i) {over(20)} END, 2) AS slope FROM i")
def _(t):
    return rounded(A.with_slope(prices(t), "price").select("date", "ticker", "slope"), digits=2)


@query("a19_weight_grid", f"{_F}, g AS (SELECT x, r, y, w / 10.0 AS weight FROM f, range(11) t(w) WHERE x IS NOT NULL AND r IS NOT NULL AND y IS NOT NULL) SELECT CAST(weight AS DOUBLE) AS weight, round(corr(weight * x + (1 - weight) * r, y), 4) AS ic FROM g GROUP BY 1")
def _(t):
    return rounded(A.weight_grid(_forward(t), "x", "r", "y"), "weight")


_S = "s AS (SELECT *, CASE WHEN abs(e) > 0.01 THEN (v - e) / abs(e) * 100 END AS s FROM (SELECT k, d, id, v, lag(v) OVER (PARTITION BY k ORDER BY d, id) AS e FROM o)), g AS (SELECT *, CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE 0 END AS g FROM s), i AS (SELECT *, sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY id ROWS UNBOUNDED PRECEDING) AS i FROM g)"


@query("a20_surprise_streak", f"WITH o AS ({_O}), {_S} SELECT id, round(s, 4) AS surprise, CASE WHEN s IS NULL THEN NULL WHEN s <= -10 THEN 'big_miss' WHEN s < 0 THEN 'miss' WHEN s = 0 THEN 'inline' WHEN s < 10 THEN 'beat' ELSE 'big_beat' END AS bucket, CAST(sum(g) OVER (PARTITION BY k, i ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i")
def _(t):
    o = _orders(t).withColumn("e", F.lag("v").over(series("k", "d").orderBy("d", "id")))
    return rounded(A.eps_surprise(o, "v", "e", "k", "id").select("id", "surprise", "bucket", "streak"))


@query("a21_volume_surge", f"WITH panel AS ({PRICES}) SELECT date, ticker, round(CASE WHEN count(price) OVER p >= 10 THEN price / nullif(avg(price) OVER p, 0) END, 4) AS surge FROM panel WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(t):
    return rounded(prices(t).select("date", "ticker", A.volume_surge("price").alias("surge")))


@query("a22_text_quarter_features", f"""{_R}, f AS (SELECT *, CASE WHEN sign(r) <> sign(lag(r) {W}) THEN 1 ELSE 0 END AS f FROM r) SELECT date, ticker, round(r - lag(r) {W}, 4) AS qoq, round(r - lag(r, 4) {W}, 4) AS yoy, round(r - avg(r) {over(4)}, 4) AS gap4,
 round(coalesce((r - avg(r) OVER u) / nullif(stddev_samp(r) OVER u, 0), 0), 4) AS own_z, round({roll('stddev_samp', 'r', 4, 2)}, 4) AS vol4, CAST(sum(f) {over(4)} AS BIGINT) AS flips4 FROM f WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return rounded(A.quarterly_text_features(_returns(t), "r").select("date", "ticker", "qoq", "yoy", "gap4", "own_z", "vol4", "flips4"))


@query("a23_t_test", "SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS n1, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n2, round((avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY')) / sqrt(((count(*) FILTER (c_mktsegment = 'BUILDING') - 1) * var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') + (count(*) FILTER (c_mktsegment = 'MACHINERY') - 1) * var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY')) / (count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) - 2) * (1.0 / count(*) FILTER (c_mktsegment = 'BUILDING') + 1.0 / count(*) FILTER (c_mktsegment = 'MACHINERY'))), 4) AS t FROM customer")
def _(t):
    return rounded(A.t_test(t("customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY"))


_STEPS = [sum(1 / math.factorial(k) for k in range(n + 1)) * math.exp(-1) for n in range(8)]


@query("a24_bootstrap", f"""WITH u AS (SELECT draw, s_acctbal AS x, ('0x' || substr(sha256('42|' || draw || '|' || s_suppkey), 1, 10))::BIGINT::DOUBLE / {1 << 40} AS u FROM supplier, range(1, 201) r(draw)),
 w AS (SELECT draw, x, CASE {' '.join(f'WHEN u < {v!r}::DOUBLE THEN {k}' for k, v in enumerate(_STEPS))} ELSE 8 END AS w FROM u) SELECT draw::INTEGER AS draw, round(sum(w * x) / nullif(sum(w), 0), 4) AS mean FROM w GROUP BY 1""")
def _(t):
    return rounded(A.bootstrap(t("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 200, key=["s_suppkey"]))


@query("a25_distribution", "SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, round(avg(CASE WHEN c_acctbal > 1 THEN 1.0 ELSE 0.0 END), 4) AS above_1, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END), 4) AS above_0 FROM customer GROUP BY 1")
def _(t):
    return rounded(A.distribution(t("customer"), "c_acctbal", ["c_mktsegment"]), "min", "max", digits=4)


@query("a27_core_features", "SELECT p_brand, CAST(sum(CASE WHEN p_size >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS support, round(avg(p_size), 4) AS mean FROM part GROUP BY 1 HAVING sum(CASE WHEN p_size >= 40 THEN 1 ELSE 0 END) >= 2 AND avg(p_size) >= 25")
def _(t):
    return rounded(A.core_features(t("part"), "p_brand", "p_size", 40, 2, 25))


@query("a28_realised_performance", f"{_F}, g AS (SELECT ticker || '@' || date AS id, y, CASE WHEN x > 0.2 THEN 'buy' WHEN x < -0.2 THEN 'sell' ELSE 'hold' END AS signal FROM f WHERE y IS NOT NULL AND x IS NOT NULL) SELECT signal, count(*) AS n, round(avg(y), 4) AS mean, round(list_sort(list(y))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 4) AS upper_median, round(avg(CASE WHEN signal = 'sell' THEN (y < 0)::INT ELSE (y > 0)::INT END), 4) AS hit_rate, max_by(id, (y, id)) AS best, min_by(id, (y, id)) AS worst FROM g GROUP BY 1")
def _(t):
    f = _forward(t).filter("x is not null").withColumn("signal", F.when(F.col("x") > 0.2, "buy").when(F.col("x") < -0.2, "sell").otherwise("hold"))
    return rounded(A.realised(f.withColumn("id", F.concat_ws("@", "ticker", "date")), "y", "signal", "id"))


@query("a31_quality_report", "SELECT count(*) AS rows, 'n_name' AS column, count(*) - count(n_name) AS nulls, CAST(0 AS BIGINT) AS duplicates FROM nation UNION ALL SELECT count(*), 'n_regionkey', count(*) - count(n_regionkey), 0 FROM nation")
def _(t):
    return A.quality_report(t("nation").select("n_name", "n_regionkey"), ["n_name"])


@query("a32_shrunk_ic", "SELECT p_partkey, round(p_size / (p_size + 100.0) * abs(p_retailprice / 10000) + (1 - p_size / (p_size + 100.0)) * 0.05, 4) AS ic FROM part")
def _(t):
    return rounded(t("part").withColumn("v", F.col("p_retailprice") / 10000).select("p_partkey", A.shrunk_ic("p_size", "v").alias("ic")))
