"""Queries for portfolio construction, risk and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.operators import fundamentals as U
from crosspanel.operators import metrics as A
from crosspanel.operators import portfolio as P
from crosspanel.operators import risk as K
from crosspanel.operators import technical as T
from crosspanel.plans.panel_queries import W, XS, _M, _R, _momentum, _returns
from crosspanel.plans.registry import PRICES, over, prices, query, roll, rounded

_Q = f"{_M}, q AS (SELECT *, ({roll('stddev_samp', 'r', 12)}) AS vol FROM m), s AS (SELECT * FROM q WHERE x IS NOT NULL AND vol IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS k FROM s)"


def _scores(t):
    return _momentum(t).withColumn("vol", T.volatility("r", 12, year=1)).filter("x is not null and vol is not null")


@query("w01_top_equal", f"{_Q} SELECT date, ticker, round(1.0 / count(*) {XS}, 4) AS weight FROM k WHERE k <= 5")
def _(t):
    return rounded(P.top_equal(_scores(t), "x", 5))


@query("w02_score_weights", f"{_Q}, z AS (SELECT *, x - least(min(x) {XS}, 0) + 1e-6 AS z FROM k WHERE k <= 5) SELECT date, ticker, round(z / sum(z) {XS}, 4) AS weight FROM z")
def _(t):
    return rounded(P.score_weighted(_scores(t), "x", 5))


_RW = f"{_Q}, rw AS (SELECT date, ticker, sector, vol, r, exp(-(k - 1) / 5.0) / sum(exp(-(k - 1) / 5.0)) {XS} AS weight FROM k WHERE k <= 8)"


def _ranked(t):
    return P.rank_weighted(_scores(t), "x", 8, keep=("sector", "vol", "r"))


@query("w03_rank_weights", f"{_RW} SELECT date, ticker, round(weight, 4) AS weight FROM rw")
def _(t):
    return rounded(_ranked(t).select("date", "ticker", "weight"))


@query("w04_sector_neutral", f"""{_Q}, z AS (SELECT date, ticker, sector, coalesce((x - avg(x) OVER g) / nullif(stddev_samp(x) OVER g, 0), 0) AS z FROM s WINDOW g AS (PARTITION BY date, sector)),
 n AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY z DESC, ticker) AS k, count(*) OVER (PARTITION BY date, sector) AS n, count(*) {XS} AS a FROM z), g AS (SELECT date, count(DISTINCT sector) AS g FROM z GROUP BY 1),
 l AS (SELECT n.*, least(least(1, n) + CAST(floor(greatest(10 - g, 0) * n / a) AS BIGINT), 3, n) AS slots FROM n JOIN g USING (date)), t AS (SELECT *, 10 - sum(CASE WHEN k <= slots THEN 1 ELSE 0 END) {XS} AS rest, k = slots + 1 AND slots < 3 AS nxt FROM l),
 o AS (SELECT *, row_number() OVER (PARTITION BY date, nxt ORDER BY z DESC, ticker) AS o FROM t) SELECT date, ticker, sector, round(1.0 / count(*) {XS}, 4) AS weight FROM o WHERE k <= slots OR (nxt AND o <= rest)""")
def _(t):
    return rounded(P.sector_neutral(_scores(t), "x", 10))


@query("w05_inverse_volatility", f"{_RW} SELECT date, ticker, round((weight / greatest(vol, 0.01)) / sum(weight / greatest(vol, 0.01)) {XS}, 4) AS weight FROM rw")
def _(t):
    return rounded(P.inverse_volatility(_ranked(t)).select("date", "ticker", "weight"))


@query("w06_beta_tilt", f"{_RW}, b AS (SELECT *, vol * 4 AS beta FROM rw), pb AS (SELECT *, sum(weight * beta) {XS} AS pb FROM b), v AS (SELECT *, weight * CASE WHEN pb > 1 THEN greatest(least(2 - beta, 1.5), 0.5) WHEN pb < 0.8 THEN greatest(least(beta, 1.5), 0.5) ELSE 1 END AS v FROM pb) SELECT date, ticker, round(v / sum(v) {XS}, 4) AS weight FROM v")
def _(t):
    return rounded(P.beta_tilt(_ranked(t).withColumn("beta", F.col("vol") * 4)).select("date", "ticker", "weight"))


@query("w07_sector_cap", f"{_RW}, se AS (SELECT *, sum(weight) OVER (PARTITION BY date, sector) AS s FROM rw), v AS (SELECT *, CASE WHEN s > 0.4 THEN weight * 0.4 / s ELSE weight END AS v FROM se) SELECT date, ticker, round(v / sum(v) {XS}, 4) AS weight FROM v")
def _(t):
    return rounded(P.sector_cap(_ranked(t), 0.4).select("date", "ticker", "weight"))


@query("w08_position_cap", f"""WITH RECURSIVE b AS MATERIALIZED ({_RW} SELECT date, ticker, weight FROM rw), it AS (SELECT 0 AS i, date, ticker, weight FROM b UNION ALL
 SELECT i + 1, date, ticker, CASE WHEN weight >= 0.15 THEN 0.15 ELSE weight + coalesce(excess * weight / nullif(room, 0), 0) END FROM (SELECT *, sum(greatest(weight - 0.15, 0)) OVER (PARTITION BY date) AS excess, sum(CASE WHEN weight < 0.15 THEN weight ELSE 0 END) OVER (PARTITION BY date) AS room FROM it) WHERE i < 10)
 SELECT date, ticker, round(weight, 4) AS weight FROM it WHERE i = 10""")
def _(t):
    return rounded(P.position_cap(_ranked(t), 0.15).select("date", "ticker", "weight"))


@query("w09_clip_weights", f"{_RW}, v AS (SELECT *, greatest(least(weight, 0.2), 0.05) AS v FROM rw) SELECT date, ticker, round(v / sum(v) {XS}, 4) AS weight FROM v")
def _(t):
    return rounded(P.clip_weights(_ranked(t), 0.05, 0.2).select("date", "ticker", "weight"))


@query("w10_long_short", f"{_Q}, w AS (SELECT date, ticker, 0.5 / count(*) {XS} AS weight FROM k WHERE k <= 3 UNION ALL SELECT date, ticker, -0.5 / count(*) {XS} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, ticker) AS l FROM k) WHERE l <= 3) SELECT date, ticker, round(sum(weight), 4) AS weight FROM w GROUP BY 1, 2")
def _(t):
    return rounded(P.long_short(_scores(t), "x", 3))


@query("w11_portfolio_return", f"{_RW} SELECT date, round(sum(weight * r), 4) AS portfolio_return FROM rw GROUP BY 1")
def _(t):
    w = _ranked(t)
    return rounded(P.portfolio_return(w.select("date", "ticker", "weight"), w.select("date", "ticker", "r"), "r"))


@query("w12_risk_stats", f"{_RW}, k2 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, vol) AS n FROM rw) SELECT date, count(*) AS n, round(max(weight), 4) AS max_weight, round(sum(weight) FILTER (n <= 3), 4) AS top3, round(sum(weight) FILTER (n <= 10), 4) AS top10, round(sum(weight * weight), 4) AS hhi, round(avg(vol), 4) AS mean_vol, round(sum(weight * vol), 4) AS beta, count(DISTINCT sector) AS sectors FROM k2 GROUP BY 1")
def _(t):
    return rounded(P.risk_stats(_ranked(t).withColumn("beta", F.col("vol"))))


for _method, _sql in {
    "equal": "SELECT ticker, round(1.0 / count(*) OVER (), 4) AS weight FROM st",
    "kelly": "SELECT ticker, round(CASE WHEN sum(w) OVER () > 1 THEN w / sum(w) OVER () ELSE w END, 4) AS weight FROM (SELECT ticker, CASE WHEN n >= 30 AND v > 0 THEN greatest(least(m / v * 0.5, 1), 0) ELSE 0 END AS w FROM st)",
    "vol_target": "SELECT ticker, round(CASE WHEN sum(w) OVER () > 1 THEN w / sum(w) OVER () ELSE w END, 4) AS weight FROM (SELECT ticker, CASE WHEN n >= 30 AND v > 0 THEN least(0.15 / sqrt(v * 52), 2) / count(*) OVER () ELSE 0 END AS w FROM st)",
    "inverse_variance": "SELECT ticker, round((1 / v) / sum(1 / v) OVER (), 4) AS weight FROM st",
    "inverse_vol": "SELECT ticker, round((1 / sqrt(v)) / sum(1 / sqrt(v)) OVER (), 4) AS weight FROM st",
}.items():

    @query(f"w13_sizing_{_method}", f"{_R}, st AS (SELECT ticker, avg(r) AS m, var_samp(r) AS v, count(r) AS n FROM r GROUP BY 1) {_sql}")
    def _(t, method=_method):
        r = _returns(t)
        return rounded(P.sized(r, r.select("ticker").distinct().withColumn("signal", F.lit(0.5)), method, year=52))


_LAST = f"WITH panel AS ({PRICES}), l AS (SELECT ticker, sector, max_by(price, date) AS price FROM panel GROUP BY 1, 2), p AS (SELECT *, price / sum(price) OVER () AS weight FROM l)"


def _latest(t):
    from pyspark.sql import Window

    p = prices(t).groupBy("ticker", "sector").agg(F.max_by("price", "date").alias("price"))
    return p.withColumn("weight", F.col("price") / F.sum("price").over(Window.partitionBy()))


@query("w14_sizing_constraints", f"{_LAST}, w AS (SELECT *, CASE WHEN least(weight, 0.06) < 0.03 THEN 0 ELSE least(weight, 0.06) END AS w FROM p), s AS (SELECT *, sum(w) OVER (PARTITION BY sector) AS s FROM w), f AS (SELECT *, CASE WHEN s > 0.2 THEN w * 0.2 / s ELSE w END AS f FROM s) SELECT ticker, round(f, 4) AS weight, CAST(floor(f * 1e7 / price) AS BIGINT) AS shares FROM f")
def _(t):
    return rounded(P.constrained(_latest(t), 1e7, 0.06, 0.03, 0.2).select("ticker", "weight", "shares"))


@query("w15_equal_weight_baseline", f"WITH panel AS ({PRICES}) SELECT date, ticker, round(1.0 / count(*) {XS}, 4) AS weight FROM panel")
def _(t):
    return rounded(P.equal_weight(prices(t)))


@query("w15_random_baseline", f"WITH panel AS ({PRICES}), k AS (SELECT path, date, ticker, row_number() OVER (PARTITION BY path, date ORDER BY sha256('42|' || path || '|' || date || '|' || ticker) DESC, ticker) AS k FROM panel, range(1, 11) r(path)) SELECT path::INTEGER AS path, date, ticker, round(1.0 / count(*) OVER (PARTITION BY path, date), 4)::DOUBLE AS weight FROM k WHERE k <= 5")
def _(t):
    return rounded(P.random_paths(prices(t), 5, 10))


_LIMITS = [("single_name", None, 0.05, True), ("sector", None, 0.22, False), ("beta", 0.5, 1.0, True)]
_EXP = f"{_LAST}, b AS (SELECT *, price / 40000 AS beta FROM p), e AS (SELECT 'single_name' AS kind, ticker AS name, abs(weight) AS value FROM b UNION ALL SELECT 'sector', sector, sum(abs(weight)) FROM b GROUP BY 2 UNION ALL SELECT 'beta', 'beta', sum(weight * beta) FROM b), lim AS (SELECT * FROM (VALUES ('single_name', NULL::DOUBLE, 0.05, true), ('sector', NULL, 0.22, false), ('beta', 0.5, 1.0, true)) v(kind, low, high, hard))"


@query("k01_exposure_violations", f"{_EXP} SELECT e.kind, name, round(value, 4) AS value, low, high::DOUBLE AS high, hard FROM e JOIN lim ON e.kind = lim.kind WHERE value > high OR value < coalesce(low, -1e308)")
def _(t):
    p = _latest(t).withColumn("beta", F.col("price") / 40000)
    limits = p.sparkSession.createDataFrame(_LIMITS, "kind string, low double, high double, hard boolean")
    return rounded(K.violations(K.exposures(p, beta="beta"), limits), "low", "high")


@query("k02_pre_trade_check", f"{_LAST}, a AS (SELECT ticker, sector, weight + CASE WHEN ticker = 'Brand#1' THEN 0.03 ELSE 0 END AS weight FROM p), e AS (SELECT 'single_name' AS kind, abs(weight) AS value FROM a UNION ALL SELECT 'sector', sum(abs(weight)) FROM a GROUP BY sector) SELECT count(*) FILTER (kind = 'single_name' AND value > 0.05) = 0 AS allowed, count(*) FILTER ((kind = 'single_name' AND value > 0.05) OR (kind = 'sector' AND value > 0.22)) AS violations FROM e")
def _(t):
    p = _latest(t).select("ticker", "sector", "weight")
    limits = p.sparkSession.createDataFrame(_LIMITS, "kind string, low double, high double, hard boolean")
    trades = p.filter("ticker = 'Brand#1'").withColumn("weight", F.lit(0.03))
    return K.allowed(p, trades, limits)


@query("k03_portfolio_risk", f"{_R}, q AS (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY ticker) AS q FROM r WHERE r IS NOT NULL) SELECT ticker, round(stddev_samp(r) * sqrt(52), 4) AS volatility, round(-quantile_cont(r, 0.05), 4) AS var_95, round(-quantile_cont(r, 0.01), 4) AS var_99, round(-avg(r) FILTER (r <= q), 4) AS cvar_95 FROM q GROUP BY 1")
def _(t):
    return rounded(K.portfolio_risk(_returns(t), "r", ["ticker"], 52))


# Least squares on centred moments; the intercept's variance is s2 * (1 / n + m' S^-1 m).
@query("k04_factor_exposures", f"""{_R}, f AS (SELECT date, avg(r) AS a, stddev_samp(r) AS b FROM r GROUP BY 1), j AS (SELECT ticker, r AS y, a, b FROM r JOIN f USING (date) WHERE r IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
 s AS (SELECT ticker, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, var_pop(y) * count(*) AS yy FROM j GROUP BY 1 HAVING count(*) >= 60),
 c AS (SELECT *, aa * bb - ab * ab AS det FROM s), e AS (SELECT *, (bb * ay - ab * by_) / det AS ba, (aa * by_ - ab * ay) / det AS b2 FROM c), v AS (SELECT *, greatest(yy - ba * ay - b2 * by_, 0) / (n - 3) AS s2 FROM e)
 SELECT ticker, 'intercept' AS factor, round(my - ba * ma - b2 * mb, 2) AS beta, round((my - ba * ma - b2 * mb) / sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), 2) AS t FROM v
 UNION ALL SELECT ticker, 'market', round(ba, 2), round(ba / sqrt(s2 * bb / det), 2) FROM v UNION ALL SELECT ticker, 'spread', round(b2, 2), round(b2 / sqrt(s2 * aa / det), 2) FROM v""")
def _(t):
    r = _returns(t)
    f = r.groupBy("date").agg(F.avg("r").alias("market"), F.stddev_samp("r").alias("spread"))
    return rounded(K.factor_exposures(r.join(f, "date"), "r", ["market", "spread"], ["ticker"]), digits=2)


_COV = f"{_R}, c AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.r, y.r) AS cov FROM r x JOIN r y USING (date) WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2), w AS (SELECT DISTINCT ticker, 0.04 AS weight FROM panel), l AS (SELECT a, sum(cov * weight) * 52 AS s FROM c JOIN w ON b = ticker GROUP BY 1), t AS (SELECT sqrt(sum(weight * s)) AS t FROM l JOIN w ON a = ticker)"


@query("k05_k06_risk_contributions", f"{_COV} SELECT w.ticker, weight::DOUBLE AS weight, round(s / t, 4) AS marginal, round(weight * s / t, 4) AS contribution, round(weight * s / t / t, 4) AS share, round(weight * s / t * 1.645, 4) AS component_var FROM w JOIN l ON a = w.ticker, t")
def _(t):
    r = _returns(t)
    return rounded(K.risk_contributions(r.select("ticker").distinct().withColumn("weight", F.lit(0.04)), K.covariances(r, "r"), 52), "weight")


@query("k05_series_contributions", f"""{_R}, q AS (SELECT date, ticker, r FROM r WHERE r IS NOT NULL), c AS (SELECT date, sum(0.04::DOUBLE * r) AS p FROM q GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM panel)),
 l AS (SELECT ticker, covar_samp(r, p) * 52 AS s FROM q JOIN c USING (date) GROUP BY 1), t AS (SELECT sqrt(sum(0.04::DOUBLE * s)) AS t FROM l)
 SELECT ticker, 0.04::DOUBLE AS weight, round(s / t, 4) AS marginal, round(0.04 * s / t, 4) AS contribution, round(0.04 * s / t / t, 4) AS share, round(0.04 * s / t * 1.645, 4) AS component_var FROM l, t""")
def _(t):
    r = _returns(t)
    return rounded(K.series_contributions(r.select("ticker").distinct().withColumn("weight", F.lit(0.04)), r, "r", 52), "weight")


_BR = f"{_R}, p AS (SELECT date, ticker, sector, r, weight FROM (SELECT *, 1.0 / count(*) {XS} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r DESC, ticker) AS k FROM r WHERE r IS NOT NULL) WHERE k <= 8)), b AS (SELECT *, 1.0 / count(*) {XS} AS weight FROM r WHERE r IS NOT NULL), gp AS (SELECT date, sector, sum(weight) AS wp, sum(weight * r) / sum(weight) AS rp FROM p GROUP BY 1, 2), gb AS (SELECT date, sector, sum(weight) AS wb, sum(weight * r) / sum(weight) AS rb FROM b GROUP BY 1, 2), j AS (SELECT date, sector, coalesce(wp, 0) AS wp, coalesce(rp, 0) AS rp, coalesce(wb, 0) AS wb, coalesce(rb, 0) AS rb FROM gp FULL JOIN gb USING (date, sector)), t AS (SELECT *, sum(wb * rb) {XS} AS t FROM j)"


def _sides(t):
    r = _returns(t).filter("r is not null")
    return P.top(r, "r", 8).withColumn("weight", 1.0 / F.count(F.lit(1)).over(P.section("date"))), r.withColumn("weight", 1.0 / F.count(F.lit(1)).over(P.section("date")))


@query("k07_brinson", f"{_BR} SELECT date, sector, round((wp - wb) * (rb - t), 4) AS allocation, round(wb * (rp - rb), 4) AS selection, round((wp - wb) * (rp - rb), 4) AS interaction FROM t")
def _(t):
    p, b = _sides(t)
    return rounded(K.brinson(p, b, ["date"]))


@query("k07_linked_effects", f"{_R}, m AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, avg(r) AS r FROM r GROUP BY 1) SELECT date, round(r * coalesce(product(1 + r) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 4) AS linked FROM m")
def _(t):
    q = _returns(t).groupBy(F.date_trunc("quarter", "date").cast("date").alias("date")).agg(F.avg("r").alias("r")).withColumn("effect", F.col("r"))
    return rounded(K.linked_effect(q, "effect", "r"))


@query("k08_attribution_periods", f"WITH panel AS ({PRICES}) SELECT CAST(date_trunc('month', date) AS DATE) AS period, min(date) AS start, max(date) AS end, count(DISTINCT date) AS n FROM panel GROUP BY 1 HAVING count(DISTINCT date) >= 2")
def _(t):
    return K.attribution_periods(prices(t), "month")


@query("k09_risk_budget", f"{_COV}, g AS (SELECT substr(w.ticker, 7, 1) AS sector, sum(abs(weight * s / t)) AS c FROM w JOIN l ON a = w.ticker, t GROUP BY 1) SELECT sector, round(c / sum(c) OVER (), 4) AS share, 0.25::DOUBLE AS budget, c / sum(c) OVER () > 0.25 AS over FROM g")
def _(t):
    r = _returns(t)
    c = K.risk_contributions(r.select("ticker").distinct().withColumn("weight", F.lit(0.04)), K.covariances(r, "r"), 52).withColumn("sector", F.substring("ticker", 7, 1))
    return rounded(K.budget(c, c.select("sector").distinct().withColumn("budget", F.lit(0.25))), "budget")


@query("k10_ex_ante_ex_post", f"{_R}, v AS (SELECT ticker, var_samp(r) AS v FROM r GROUP BY 1), a AS (SELECT sqrt(sum(0.04 * 0.04 * v) * 52) AS a FROM v), p AS (SELECT stddev_samp(p) * sqrt(52) AS p FROM (SELECT date, sum(0.04 * r) AS p FROM r GROUP BY 1)) SELECT round(a, 4) AS ex_ante, round(p, 4) AS ex_post, round(p / a, 4) AS ratio FROM a, p")
def _(t):
    r = _returns(t)
    return rounded(K.ex_ante_ex_post(r.select("ticker").distinct().withColumn("weight", F.lit(0.04)), r, "r", 52))


_FUND = "WITH f AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, c_mktsegment AS ticker, round(sum(o_totalprice), 2) AS market_cap, round(avg(o_totalprice) / 10000, 4) AS pe_ratio, round(avg(c_acctbal) / 1000, 4) AS pb_ratio, CAST(count(*) AS DOUBLE) AS ps_ratio, round(avg(o_totalprice) / 1e6, 6) AS roe, round(stddev_samp(o_totalprice) / 1e6, 6) AS gross_margin, round(sum(c_acctbal), 2) AS revenue, round(max(c_acctbal) / 2000, 6) AS debt_equity, left(c_mktsegment, 1) AS sector FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _fundamentals(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("c_mktsegment").alias("ticker")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("market_cap"), F.round(F.avg("o_totalprice") / 10000, 4).alias("pe_ratio"), F.round(F.avg("c_acctbal") / 1000, 4).alias("pb_ratio"), F.count("*").cast("double").alias("ps_ratio"),
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("roe"), F.round(F.stddev_samp("o_totalprice") / 1e6, 6).alias("gross_margin"), F.round(F.sum("c_acctbal"), 2).alias("revenue"), F.round(F.max("c_acctbal") / 2000, 6).alias("debt_equity"),
    ).withColumn("sector", F.substring("ticker", 1, 1))


@query("u01_u05_raw_factors", f"{_FUND} SELECT date, ticker, round(1 / nullif(pe_ratio, 0), 4) AS value_earnings, round(1 / nullif(pb_ratio, 0), 4) AS value_book, round(1 / nullif(ps_ratio, 0), 4) AS value_sales, roe AS quality_roe, -debt_equity AS quality_low_debt, round(ln(CASE WHEN market_cap > 0 THEN market_cap END), 4) AS size_log FROM f")
def _(t):
    cols = {**U.value_factors(), **U.quality_factors({"roe", "debt_equity"}), **U.size_factor({"market_cap"})}
    return rounded(_fundamentals(t).select("date", "ticker", *[c.alias(n) for n, c in cols.items()]), "quality_roe", "quality_low_debt")


@query("u03_u06_yoy_growth", f"{_FUND}, g AS (SELECT *, lag(revenue, 4) OVER (PARTITION BY ticker ORDER BY date) AS b FROM f) SELECT date, ticker, round(CASE WHEN (revenue - b) / nullif(b, 0) IS NOT NULL THEN greatest(least((revenue - b) / nullif(b, 0), 5), -2) END, 4) AS growth FROM g")
def _(t):
    return rounded(_fundamentals(t).select("date", "ticker", U.yoy_growth("revenue").alias("growth")))


@query("u07_factor_builder", f"{_FUND}, q AS (SELECT date AS d, quantile_cont(roe, 0.1) AS lo, quantile_cont(roe, 0.9) AS hi FROM f GROUP BY 1), v AS (SELECT date, ticker, greatest(least(roe, hi), lo) AS x FROM f JOIN q ON date = d) SELECT date, ticker, round((x - avg(x) {XS}) / nullif(stddev_samp(x) {XS}, 0), 4) AS quality_roe FROM v")
def _(t):
    return rounded(U.build_factors(_fundamentals(t).select("date", "ticker", "roe"), {"roe"}, 0.1).select("date", "ticker", "quality_roe"))


@query("u08_u09_coverage", f"{_FUND}, h AS (SELECT *, CASE WHEN roe > 0.015 THEN roe END AS a, CASE WHEN pb_ratio > 4.4 THEN pb_ratio END AS b FROM f), c AS (SELECT ticker, CAST(date_trunc('year', date) AS DATE) AS period, (count(a) + count(b)) / (count(*) * 2.0) AS coverage FROM h GROUP BY 1, 2) SELECT ticker, round(avg(coverage), 4) AS coverage FROM c GROUP BY 1 HAVING avg(coverage) >= 0.3")
def _(t):
    h = _fundamentals(t).withColumn("a", F.when(F.col("roe") > 0.015, F.col("roe"))).withColumn("b", F.when(F.col("pb_ratio") > 4.4, F.col("pb_ratio")))
    return rounded(U.well_covered(U.coverage(h, ["a", "b"]), 0.3))


_BAND = lambda x, *bands: f"CASE WHEN {x} IS NOT NULL THEN CASE " + " ".join(f"WHEN {x} >= {b} THEN {p}" for b, p in bands) + " ELSE 0 END END"
_UNDER = lambda x, *bands: f"CASE WHEN {x} > 0 THEN CASE " + " ".join(f"WHEN {x} < {b} THEN {p}" for b, p in bands) + " ELSE 0 END END"
_PARTS = {
    "q": [(_BAND("roe", (0.15, 20), (0.10, 12), (0.05, 5)), 20), (_BAND("roa", (0.08, 15), (0.05, 10), (0.02, 5)), 15), (_BAND("gross_margin", ("gm * 1.2::DOUBLE", 15), ("gm", 10), ("gm * 0.8::DOUBLE", 5)), 15),
          (_BAND("operating_margin", (0.15, 15), (0.10, 10), (0.05, 5)), 15), ("CASE WHEN de IS NOT NULL THEN CASE WHEN de <= 0.5 THEN 15 WHEN de <= 1 THEN 10 WHEN de <= 2 THEN 5 ELSE 0 END END", 15),
          (_BAND("current_ratio", (1.5, 10), (1.0, 6)), 10), (_BAND("earnings_growth", (0.2, 10), (0.1, 7), (0, 4)), 10)],
    "v": [(f"CASE WHEN pe_ratio < 0 THEN 0 ELSE {_UNDER('pe_ratio', (15, 25), ('pm', 15), ('pm * 1.5::DOUBLE', 8))} END", 25), (_UNDER("pb_ratio", (3, 20), (5, 12), (10, 5)), 20), (_UNDER("ev_ebitda", (10, 20), (15, 12), (20, 5)), 20),
          (_UNDER("ps_ratio", (2, 15), (5, 8), (10, 3)), 15), (_BAND("fcf_yield", (0.05, 20), (0.03, 12), (0.01, 5)), 20)],
}
_SHARE = {k: "coalesce(100.0 * (" + " + ".join(f"coalesce({x}, 0)" for x, _ in parts) + ") / nullif(" + " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN {m} ELSE 0 END" for x, m in parts) + ", 0), 0)" for k, parts in _PARTS.items()}
_GRADE = lambda x: f"CASE WHEN {x} >= 80 THEN 'A' WHEN {x} >= 65 THEN 'B' WHEN {x} >= 50 THEN 'C' WHEN {x} >= 35 THEN 'D' ELSE 'F' END"


@query("u10_quality_value", f"""{_FUND}, m AS (SELECT *, CASE ticker WHEN 'BUILDING' THEN 0.55 WHEN 'MACHINERY' THEN 0.30 ELSE 0.40 END::DOUBLE AS gm, CASE ticker WHEN 'BUILDING' THEN 28 WHEN 'MACHINERY' THEN 18 ELSE 18 END::DOUBLE AS pm, roe / 2 AS roa,
  gross_margin * 3 AS operating_margin, CASE WHEN debt_equity > 10 THEN debt_equity / 100 ELSE debt_equity END AS de, pb_ratio / 3 AS current_ratio, roe - 0.1 AS earnings_growth, pe_ratio - 1 AS ev_ebitda, CASE WHEN ps_ratio > 5 THEN roe / 4 END AS fcf_yield FROM f),
 s AS (SELECT date, ticker, {_SHARE['q']} AS q, {_SHARE['v']} AS v FROM m), c AS (SELECT *, (q + v) / 2 AS c FROM s)
 SELECT date, ticker, round(q, 4) AS quality_score, round(v, 4) AS value_score, round(c, 4) AS composite_score, {_GRADE('q')} AS quality_grade, {_GRADE('v')} AS value_grade, CASE WHEN c >= 65 THEN 'long' WHEN c <= 35 THEN 'short' END AS direction,
  CASE WHEN c >= 80 THEN 'strong' WHEN c >= 65 THEN 'moderate' WHEN c <= 20 THEN 'strong' WHEN c <= 35 THEN 'weak' ELSE 'none' END AS strength FROM c""")
def _(t):
    f = _fundamentals(t).withColumn("sector", F.when(F.col("ticker") == "BUILDING", "Technology").when(F.col("ticker") == "MACHINERY", "Industrials").otherwise("Other"))
    more = {"roa": F.col("roe") / 2, "operating_margin": F.col("gross_margin") * 3, "current_ratio": F.col("pb_ratio") / 3, "earnings_growth": F.col("roe") - 0.1, "ev_ebitda": F.col("pe_ratio") - 1, "fcf_yield": F.when(F.col("ps_ratio") > 5, F.col("roe") / 4)}
    out = U.quality_value(f.withColumns(more))
    return rounded(out.select("date", "ticker", "quality_score", "value_score", "composite_score", "quality_grade", "value_grade", "direction", "strength"))


@query("u11_ttm_growth", f"{_FUND}, s AS (SELECT *, {roll('sum', 'revenue', 4)} AS ttm FROM f), g AS (SELECT *, lag(ttm, 4) {W} AS b FROM s) SELECT ticker, date, round(ttm, 2) AS revenue_ttm, round((ttm - b) / nullif(abs(b), 0), 4) AS revenue_growth FROM g")
def _(t):
    return U.with_ttm(_fundamentals(t), "revenue", "ticker", "date").select("ticker", "date", F.round("revenue_ttm", 2).alias("revenue_ttm"), F.round("revenue_growth", 4).alias("revenue_growth"))


@query("u12_publication_lag", f"{_FUND} SELECT DISTINCT date, CASE WHEN month(date) IN (6, 12) THEN date + 75 ELSE date + 45 END AS public FROM f")
def _(t):
    return _fundamentals(t).select("date", U.available_on("date").alias("public")).distinct()


@query("u13_dcf", f"{_FUND}, g AS (SELECT *, CASE WHEN revenue > 0 THEN revenue END AS c, greatest(least(roe * 5, 0.25), -0.1) AS g FROM f) SELECT date, ticker, round((c * list_sum(list_transform(range(1, 6), lambda i: pow((1 + g) / 1.1, i))) + c * pow(1 + g, 5) * 1.025 / 0.075 / pow(1.1, 5)) / 1e6, 4) AS value FROM g")
def _(t):
    return rounded(_fundamentals(t).select("date", "ticker", (U.dcf_value("revenue", F.col("roe") * 5) / 1e6).alias("value")))


@query("u14_median_growth", f"{_FUND}, l AS (SELECT ticker, list(market_cap ORDER BY date) AS a FROM f GROUP BY 1), s AS (SELECT ticker, list_transform(range(2, len(a) + 1), lambda i: greatest(least(a[i] / a[i - 1] - 1, 1), -0.5)) AS s FROM l) SELECT ticker, round(list_median(s), 4) AS growth FROM s")
def _(t):
    from pyspark.sql import functions as G

    a = _fundamentals(t).groupBy("ticker").agg(G.transform(G.array_sort(G.collect_list(G.struct("date", "market_cap"))), lambda x: x["market_cap"]).alias("a"))
    return rounded(a.select("ticker", U.median_growth("a").alias("growth")))


@query("u15_revisions", f"{_FUND}, v AS (SELECT date, ticker, (roe - lag(roe) {W}) / nullif(abs(lag(roe) {W}), 0) AS a, (roe - lag(roe, 3) {W}) / nullif(abs(lag(roe, 3) {W}), 0) AS b FROM f) SELECT date, ticker, round(a, 4) AS rev_7, round(b, 4) AS rev_30, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 4) AS composite, round(a - b, 4) AS acceleration FROM v")
def _(t):
    from crosspanel.functions.columns import series

    f = _fundamentals(t).withColumn("p1", F.lag("roe").over(series())).withColumn("p3", F.lag("roe", 3).over(series()))
    return rounded(f.select("date", "ticker", *[c.alias(n) for n, c in U.revisions("roe", {"7": "p1", "30": "p3"}).items()]))


@query("u16_combined_signals", f"{_FUND}, z AS (SELECT date, ticker, (roe - avg(roe) OVER ()) / stddev_samp(roe) OVER () AS za, (pb_ratio - avg(pb_ratio) OVER ()) / stddev_samp(pb_ratio) OVER () AS zb FROM f) SELECT date, ticker, round((za + zb) / 2, 4) AS mean, round(0.4 * za + 0.6 * zb, 4) AS mix, round(za * zb, 4) AS product, CASE WHEN za > 0 AND zb > 0 THEN 1 WHEN za < 0 AND zb < 0 THEN -1 ELSE 0 END AS double FROM z")
def _(t):
    return rounded(U.combined_signals(_fundamentals(t), "roe", "pb_ratio").select("date", "ticker", "mean", "mix", "product", "double"))


@query("s18_monthly_expansion", f"{_FUND}, q AS (SELECT date, ticker, roe FROM f WHERE month(date) % 3 = 1), m AS (SELECT last_day(CAST(unnest(generate_series(DATE '1991-06-30', DATE '1999-06-30', INTERVAL 1 MONTH)) AS DATE)) AS month), g AS (SELECT * FROM m, (SELECT DISTINCT ticker FROM q)), j AS (SELECT g.ticker, g.month, q.roe FROM g ASOF LEFT JOIN q ON g.ticker = q.ticker AND g.month >= q.date) SELECT ticker, month, coalesce(roe, (SELECT min_by(roe, date) FROM q WHERE q.ticker = j.ticker)) AS roe FROM j")
def _(t):
    from crosspanel.sources.panels import month_ends

    q = _fundamentals(t).filter("month(date) % 3 = 1").select("date", "ticker", "roe")
    return U.monthly(q, month_ends(q.sparkSession, "1991-06-30", "1999-06-30", "month"), columns=("roe",))


@query("u04_m07_statement_pivot", "SELECT o_custkey AS symbol, CAST(date_trunc('year', o_orderdate) AS DATE) AS report_date, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O FROM orders GROUP BY 1, 2")
def _(t):
    long = t("orders").groupBy(F.col("o_custkey").alias("symbol"), F.date_trunc("year", "o_orderdate").cast("date").alias("report_date"), F.col("o_orderstatus").alias("item_name")).agg(F.round(F.sum("o_totalprice"), 2).alias("item_value"))
    return U.pivot_items(long, ["F", "O"])
