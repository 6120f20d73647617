"""Queries for regimes, ensembles, frozen models, suites, sinks, and composed features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import series
from crosspanel.functions.storage import shared_dir
from crosspanel.operators import text as N
from crosspanel.operators import technical as T
from crosspanel.operators.cross_section import with_all_z
from crosspanel.operators.labels import forward_return
from crosspanel.plans import backtest as B
from crosspanel.plans.panel_queries import _B, _M, W, _momentum
from crosspanel.plans.registry import BENCH, PRICES, benchmark, over, prices, query, roll, rounded
from crosspanel.plans.signal_queries import _RB
from crosspanel.sources import panels as S
from crosspanel.sources import validation as V


def _enhanced(t):
    panel = prices(t)
    b = benchmark(panel).select("date", T.simple_return(w=series([], "date")).alias("rb"))
    return T.with_enhanced(panel, b, mad=13, trend=(13, 52), sectors=list("12345"))


@query("t20_all_enhanced", f"""{_B}, v AS (SELECT *, ({roll('stddev_samp', 'r', 21)}) * sqrt(252) AS v FROM e)
 SELECT date, ticker, round(price / lag(price, 5) {W} - 1, 4) AS rev_5, round(price / lag(price, 10) {W} - 1, 4) AS rev_10, round(CASE WHEN count(r) {over(13)} = 13 THEN mad(r) {over(13)} END, 4) AS mad_ret_13,
 round(CASE WHEN count(v) {over(13)} = 13 THEN mad(v) {over(13)} END, 4) AS mad_vol_13, round({roll('avg', 'price', 13, 6)} / ({roll('avg', 'price', 52, 26)}) - 1, 4) AS trend_13_52,
 {', '.join(f"CASE WHEN sector = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END AS sector_{x}" for x in '12345')}, round({roll('sum', 'resid', 63)}, 4) AS resid_mom_63, round(({roll('stddev_samp', 'resid', 63)}) * sqrt(252), 4) AS idio_vol_63 FROM v""")
def _(t):
    df, names = _enhanced(t)
    return rounded(df.select("date", "ticker", *names))


@query("t20_x04_enhanced_normalised")
def _(t):
    df, names = _enhanced(t)
    return rounded(with_all_z(df.select("date", "ticker", *names), names, ["date"]))


@query("n42_sector_rotation", f"""WITH panel AS ({PRICES}), s AS (SELECT date, sector AS ticker, avg(price) AS price FROM panel GROUP BY 1, 2), b AS (SELECT date, price / lag(price, 4) OVER (ORDER BY date) - 1 AS b0, price / lag(price, 13) OVER (ORDER BY date) - 1 AS b1 FROM ({BENCH})),
 r AS (SELECT *, price / lag(price, 4) {W} - 1 AS r0, price / lag(price, 13) {W} - 1 AS r1, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM s), m AS (SELECT ticker, r.date, r0 - coalesce(b0, 0) AS a, r1 - coalesce(b1, 0) AS z FROM r LEFT JOIN b ON r.date = b.date WHERE n = 1)
 SELECT ticker, date, round(a, 4) AS rs_4, round(z, 4) AS rs_13, round(0.4 * a + 0.6 * z, 4) AS momentum, CASE WHEN 0.4 * a + 0.6 * z > 0.03 THEN 'overweight' WHEN 0.4 * a + 0.6 * z < -0.03 THEN 'underweight' ELSE 'neutral' END AS signal, row_number() OVER (ORDER BY 0.4 * a + 0.6 * z DESC NULLS LAST, ticker) AS rank FROM m""")
def _(t):
    panel = prices(t)
    sectors = panel.groupBy("date", F.col("sector").alias("ticker")).agg(F.avg("price").alias("price"))
    return rounded(T.sector_rotation(sectors, benchmark(panel), spans=(4, 13)))


_REG = f"""bench AS ({BENCH}), br AS (SELECT *, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM bench),
 bv AS (SELECT date, ({roll('stddev_samp', 'r', 21, part='ORDER BY date')}) * sqrt(252) AS vol, coalesce(price > {roll('avg', 'price', 40, part='ORDER BY date')}, false) AS up FROM br),
 reg AS (SELECT date, CASE WHEN coalesce(vol < 0.5, false) AND up THEN 'MOMENTUM' ELSE 'QUALITY' END AS regime FROM bv)"""
_TOP = "w AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS k FROM sc SEMI JOIN d USING (date)) WHERE k <= 5)"
_HOLD = "d AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)), h AS (SELECT date, ticker, lead(price) OVER (PARTITION BY ticker ORDER BY date) / price - 1 AS h FROM panel SEMI JOIN d USING (date))"
_RET = "SELECT w.date, round(sum(w * h), 4) AS portfolio_return FROM w JOIN h ON w.date = h.date AND w.ticker = h.ticker WHERE h IS NOT NULL GROUP BY 1"


@query("v08_regime_switch", f"{_M}, {_REG}, sc AS (SELECT m.date, ticker, CASE WHEN regime = 'MOMENTUM' THEN x ELSE -r END AS score FROM m JOIN reg USING (date) WHERE x IS NOT NULL), {_HOLD}, {_TOP} {_RET}")
def _(t):
    m = _momentum(t).filter("x is not null")
    scores = {"MOMENTUM": m.select("date", "ticker", F.col("x").alias("score")), "QUALITY": m.select("date", "ticker", (-F.col("r")).alias("score"))}
    panel = prices(t)
    switched = B.regime_switch(scores, T.regime(benchmark(panel), trend=40, threshold=0.5))
    return rounded(B.score_backtest(switched, panel, B.rebalance_dates(panel, "month"), "score", 5))


@query("v08_ic_ensemble", f"""{_M}, f AS (SELECT *, lead(price, 4) {W} / price - 1 AS y FROM m), g AS (SELECT date, ticker, x, -r AS q, y FROM f WHERE x IS NOT NULL), rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY q) + (count(*) OVER (PARTITION BY date, q) - 1) / 2.0 AS rq, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM g WHERE y IS NOT NULL),
 ic AS (SELECT date, corr(rx, ry) AS a, corr(rq, ry) AS b FROM rk GROUP BY 1 HAVING count(*) >= 3), l AS (SELECT date, lag(a) OVER (ORDER BY date) AS a, lag(b) OVER (ORDER BY date) AS b FROM ic), p AS (SELECT date, greatest(coalesce(avg(a) {over(6, 'ORDER BY date')}, 0), 0) AS a, greatest(coalesce(avg(b) {over(6, 'ORDER BY date')}, 0), 0) AS b FROM l),
 u AS (SELECT date, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS u FROM p) SELECT g.date, ticker, round(u * x + (1 - u) * q, 4) AS score FROM g JOIN u USING (date)""")
def _(t):
    m = _momentum(t).withColumn("y", forward_return(4)).filter("x is not null")
    a, b = (m.select("date", "ticker", c.alias("score")) for c in (F.col("x"), -F.col("r")))
    return rounded(B.ensemble(a, b, m.filter("y is not null").select("date", "ticker", "y"), 6))


@query("v02_weights_callback", f"{_RB}, ys AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('year', date) ORDER BY 1 OFFSET 1), yh AS (SELECT date, ticker, lead(price) OVER (PARTITION BY ticker ORDER BY date) / price - 1 AS h FROM panel SEMI JOIN ys USING (date)), yk AS (SELECT m.date, ticker, row_number() OVER (PARTITION BY m.date ORDER BY x DESC, ticker) AS k FROM m SEMI JOIN ys USING (date) WHERE x IS NOT NULL) SELECT yk.date, round(sum(h / 5.0), 4) AS portfolio_return FROM yk JOIN yh ON yk.date = yh.date AND yk.ticker = yh.ticker WHERE k <= 5 AND h IS NOT NULL GROUP BY 1")
def _(t):
    from crosspanel.operators.portfolio import top_equal

    m = _momentum(t).select("date", "ticker", "price", "x")
    dates = [r["date"] for r in B.rebalance_dates(m, "year").orderBy("date").collect()][1:]
    weights = lambda d, history: top_equal(history.filter((F.col("date") == F.lit(d)) & F.col("x").isNotNull()), "x", 5, ["date"], "ticker")
    return rounded(B.weights_backtest(weights, m.select("date", "ticker", "price", "x"), dates))


_FIT = """ s AS (SELECT grp, avg(x) AS mx, avg(r) AS mr, avg(y) AS my, var_pop(x) AS vx, var_pop(r) AS vr, covar_pop(x, r) AS cxr, covar_pop(x, y) AS cx, covar_pop(r, y) AS cr, 0.001 / stddev_pop(y) AS l FROM tr GROUP BY 1),
 b AS (SELECT *, (cx * vr * (1 + l) - cr * cxr) / (vx * vr * (1 + l) * (1 + l) - cxr * cxr) AS bx, (cr * vx * (1 + l) - cx * cxr) / (vx * vr * (1 + l) * (1 + l) - cxr * cxr) AS br FROM s)"""
_FR = f"{_M}, f0 AS (SELECT date, ticker, x, r, lead(price, 4) {W} / price - 1 AS y FROM m), f AS (SELECT * FROM f0 WHERE x IS NOT NULL AND r IS NOT NULL)"


def _frame(t):
    m = _momentum(t).withColumn("y", forward_return(4))
    return m.select("date", "ticker", "x", "r", "y").dropna(subset=["x", "r"])


@query("v09_frozen_model", f"{_FR}, tr AS (SELECT 0 AS grp, * FROM f WHERE date <= DATE '1997-11-30' AND y IS NOT NULL), {_FIT} SELECT date, ticker, round(my + bx * (x - mx) + br * (r - mr), 4) AS score FROM b, f WHERE date > DATE '1997-12-31'")
def _(t):
    return rounded(B.frozen_scores(_frame(t), "1997-12-31", "1997-11-30", B.linear_scores(["x", "r"], "y")).select("date", "ticker", "score"))


REGIMES = [("1900-01-01", "1995-01-01", "first"), ("1995-01-01", "1998-01-01", "second"), ("1998-01-01", "2100-01-01", "third")]


@query("v06_split_models", f"{_FR}, q AS (SELECT *, CASE WHEN date < DATE '1995-01-01' THEN 'first' WHEN date < DATE '1998-01-01' THEN 'second' ELSE 'third' END AS grp FROM f), tr AS (SELECT * FROM q WHERE month(date) <= 6 AND y IS NOT NULL), {_FIT} SELECT date, ticker, q.grp AS regime, round(my + bx * (x - mx) + br * (r - mr), 4) AS score FROM q JOIN b USING (grp) WHERE month(date) > 6")
def _(t):
    f = _frame(t).withColumn("regime", B.regime_of("date", REGIMES))
    labels = [n for _, _, n in REGIMES]
    found = B.split_scores(f.filter("month(date) <= 6 and y is not null"), f.filter("month(date) > 6"), B.linear_scores(["x", "r"], "y"), labels)
    return rounded(found.select("date", "ticker", "regime", "score"))


@query("v06_regime_feature", f"WITH panel AS ({PRICES}) SELECT date, ticker, CASE WHEN date < DATE '1995-01-01' THEN 0 WHEN date < DATE '1998-01-01' THEN 1 ELSE 2 END AS regime_id FROM panel")
def _(t):
    label = B.regime_of("date", REGIMES)
    return prices(t).select("date", "ticker", F.coalesce(*[F.when(label == n, i) for i, (_, _, n) in enumerate(REGIMES)], F.lit(0)).alias("regime_id"))


@query("v09_suite", f"""{_RB}, e AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM panel SEMI JOIN d USING (date)), p0 AS (SELECT 'momentum' AS strategy, w.date, sum(w * h) AS r FROM w JOIN h ON w.date = h.date AND w.ticker = h.ticker WHERE h IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'equal', e.date, sum(w * h) FROM e JOIN h ON e.date = h.date AND e.ticker = h.ticker WHERE h IS NOT NULL GROUP BY 2), q AS (SELECT * FROM p0 JOIN (VALUES ('train', DATE '1992-01-01', DATE '1997-12-31'), ('test', DATE '1998-01-01', DATE '2002-12-31')) v(name, a, b) ON date BETWEEN a AND b),
 nv AS (SELECT strategy, name, date, product(1 + r) OVER (PARTITION BY strategy, name ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM q), dr AS (SELECT strategy, name, min(d) AS max_drawdown FROM (SELECT strategy, name, nav / max(nav) OVER (PARTITION BY strategy, name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM nv) GROUP BY 1, 2),
 g AS (SELECT strategy, name, count(r) AS n, pow(product(1 + r), 12.0 / count(r)) - 1 AS ar, stddev_samp(r) * sqrt(12) AS av FROM q GROUP BY 1, 2) SELECT strategy, name, n, CASE WHEN n >= 6 THEN round(ar, 4) END AS annual_return, CASE WHEN n >= 6 THEN round(ar / av, 4) END AS sharpe, CASE WHEN n >= 6 THEN round(max_drawdown, 4) END AS max_drawdown FROM g JOIN dr USING (strategy, name)""")
def _(t):
    from crosspanel.operators.portfolio import equal_weight, portfolio_return

    m = _momentum(t)
    panel, dates = m.select("date", "ticker", "price"), B.rebalance_dates(m, "month")
    equal = portfolio_return(equal_weight(panel.join(dates, "date", "left_semi")), B.holding_returns(panel, dates).filter("r is not null"), "r", ["date"], "ticker")
    periods = m.sparkSession.createDataFrame([("train", "1992-01-01", "1997-12-31"), ("test", "1998-01-01", "2002-12-31")], "name string, start string, end string")
    periods = periods.select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return rounded(B.suite({"momentum": B.score_backtest(m, panel, dates, "x", 5), "equal": equal}, periods))


@query("v04_tree_walk_forward")
def _(t):
    f = _frame(t)
    dates = [r["date"] for r in B.rebalance_dates(f, "year").orderBy("date").collect()][1:]
    return rounded(B.walk_forward(f, dates, B.gbt_scores(["x", "r"], "y", trees=5), 4).select("date", "ticker", "score"))


@query("v10_parameter_search")
def _(t):
    f = _frame(t).filter("y is not null")
    found = B.best_parameters(f, [{"ridge": x} for x in (1e-3, 1.0)], lambda ridge: B.linear_scores(["x", "r"], "y", ridge), "y", folds=2)
    return f.sparkSession.createDataFrame([(i, float(p["ridge"])) for i, (_, p) in enumerate(found)], "rank int, ridge double")


@query("s01_s10_csv_round_trip", "SELECT c_custkey AS key, c_name AS name, c_nationkey::INT AS nation, c_acctbal AS balance, NULL::DOUBLE AS absent FROM customer")
def _(t):
    """Customers as CSV, a folder for each nation, in the shared folder, and back."""
    import uuid

    c = t("customer")
    path = f"{shared_dir(c.sparkSession)}/customers-{uuid.uuid4().hex}"
    S.write_table(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")), path, "csv", ["nation"])
    return S.read_csv(c.sparkSession, path, "key long, name string, balance double, nation int, absent double").select("key", "name", "nation", "balance", "absent")


_NAMES = "CASE WHEN o_orderkey % 3 = 0 THEN 'ranking_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '30.json' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'none' END"


@query("o_date_in_name", f"""WITH n AS (SELECT o_orderkey, {_NAMES} AS name FROM orders), p AS (SELECT o_orderkey, CASE WHEN name LIKE 'ranking%' THEN strptime(regexp_extract(name, '[0-9]{{8}}_[0-9]{{4}}'), '%Y%m%d_%H%M') WHEN name <> 'none' THEN strptime(name, '%Y%m%d') END AS stamp FROM n),
 d AS (SELECT *, CAST(stamp AS DATE) + CASE WHEN hour(stamp) >= 16 THEN 1 ELSE 0 END AS d FROM p) SELECT o_orderkey, stamp, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS trading_day FROM d""")
def _(t):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ranking_"), day, F.lit("_"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("30.json"))).when(F.col("o_orderkey") % 3 == 1, day).otherwise("none")
    at = t("orders").select("o_orderkey", S.date_in_name(name).alias("at"))
    return at.select("o_orderkey", F.col("at").cast("timestamp_ntz").alias("stamp"), S.next_trading_day("at").alias("trading_day"))


@query("n44_sentences", "WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents) SELECT doc_id, len(list_filter(s, lambda x: length(trim(x)) > 10)) AS sentences FROM s")
def _(t):
    return t("documents").select("doc_id", F.size(N.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("sentences"))


@query("n44_labelled_lines", "SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE greatest(least(c_acctbal / 5000, 1), -1) END, 4) AS score, CASE WHEN c_custkey % 7 = 0 THEN 'neutral' ELSE c_mktsegment END AS label FROM customer")
def _(t):
    number = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise((F.col("c_acctbal").cast("decimal(12,2)") / 5000).cast("decimal(18,8)").cast("string"))
    label = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment"))
    c = t("customer").select("c_custkey", F.concat(F.lit("THEMES: a, b\n  SCORE: "), number, F.lit("\nLABEL: "), label, F.lit("\nSCORE: 9")).alias("text"))
    score = N.labelled_value("text", "SCORE", -1, 1, 0.0)
    first = F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(score)
    return rounded(c.select("c_custkey", first.alias("score"), N.labelled_text("text", "LABEL", "neutral").alias("label")))


@query("v11_schemas", "SELECT 'signals' AS name, 'confidence in range' AS rule, count(*) FILTER (NOT (l_discount * 12 BETWEEN 0 AND 1)) AS violations FROM lineitem UNION ALL SELECT 'signals', 'signal in range', count(*) FILTER (NOT (l_tax * 20 - 0.5 BETWEEN -1 AND 1)) FROM lineitem UNION ALL SELECT 'ohlcv', 'high at least low', count(*) FILTER (l_quantity < 10 * l_linenumber) FROM lineitem UNION ALL SELECT 'ohlcv', 'high at least open and close', count(*) FILTER (l_quantity < 25) FROM lineitem UNION ALL SELECT 'ohlcv', 'volume not negative', count(*) FILTER (l_quantity < 0) FROM lineitem")
def _(t):
    li = t("lineitem")
    signals = li.select((F.col("l_tax") * 20 - 0.5).alias("signal"), (F.col("l_discount") * 12).alias("confidence"))
    bars = li.select(F.col("l_quantity").alias("high"), (F.col("l_linenumber") * 10).alias("low"), F.lit(25.0).alias("open"), F.lit(25.0).alias("close"), F.lit(1.0).alias("volume"))
    return V.counts(signals, V.SCHEMAS["signals"]).select(F.lit("signals").alias("name"), "rule", "violations").unionByName(V.counts(bars, V.SCHEMAS["ohlcv"]).select(F.lit("ohlcv").alias("name"), "rule", "violations"))


_RELEVANT = f"""{_FR}, q AS (SELECT date, ticker, x, y, row_number() OVER (PARTITION BY date ORDER BY y, ticker) AS i, count(*) OVER (PARTITION BY date) AS n FROM f WHERE y IS NOT NULL),
 rel AS (SELECT date, ticker, x, CAST(floor((i - 1) * 5 / n) AS INTEGER) AS rel FROM q)"""


def _relevant(t) -> DataFrame:
    """The frame with the fifth of its date, by return, that each row falls in: 0 to 4."""
    w = Window.partitionBy("date")
    f = _frame(t).filter("y is not null")
    return f.withColumn("rel", F.floor((F.row_number().over(w.orderBy("y", "ticker")) - 1) * 5 / F.count("*").over(w)).cast("int"))


@query("v04_lambda_gradients", f"""{_RELEVANT}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS k, row_number() OVER (PARTITION BY date ORDER BY rel DESC, ticker) AS b FROM rel),
 ideal AS (SELECT date, sum((2 ** rel - 1) / log2(b + 1)) AS ideal FROM k GROUP BY 1),
 pairs AS (SELECT u.date, u.ticker AS up, v.ticker AS down, 1 / (1 + exp(u.x - v.x)) AS rho, abs(2 ** u.rel - 2 ** v.rel) * abs(1 / log2(1 + u.k) - 1 / log2(1 + v.k)) / ideal AS w
  FROM k u JOIN k v ON u.date = v.date AND u.rel > v.rel JOIN ideal ON ideal.date = u.date),
 sides AS (SELECT date, up AS ticker, rho * w AS g, rho * (1 - rho) * w AS h FROM pairs UNION ALL SELECT date, down, -rho * w, rho * (1 - rho) * w FROM pairs)
 SELECT k.date, k.ticker, round(coalesce(sum(g), 0), 6) AS gradient, round(coalesce(sum(h), 0), 6) AS hessian FROM k LEFT JOIN sides USING (date, ticker) GROUP BY 1, 2""")
def _(t):
    from crosspanel.plans.ranking import lambda_gradients

    return rounded(lambda_gradients(_relevant(t), "x", "rel"), digits=6)


@query("v04_ranker")
def _(t):
    """The rows after 1997 by a ranker that learns from the years before."""
    from crosspanel.plans.ranking import rank_scores

    found = B.frozen_scores(_relevant(t), "1997-12-31", "1997-11-30", rank_scores(["x", "r"], "rel", trees=5, depth=2))
    return rounded(found.select("date", "ticker", "score"))


@query("v04_ndcg", f"""{_RELEVANT}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS k, row_number() OVER (PARTITION BY date ORDER BY rel DESC, ticker) AS b FROM rel)
 SELECT date, round(sum(CASE WHEN k <= 10 THEN (2 ** rel - 1) / log2(k + 1) ELSE 0 END) / nullif(sum(CASE WHEN b <= 10 THEN (2 ** rel - 1) / log2(b + 1) ELSE 0 END), 0), 6) AS ndcg FROM k GROUP BY 1""")
def _(t):
    from crosspanel.plans.ranking import ndcg

    return rounded(ndcg(_relevant(t), "x", "rel", top=10), digits=6)


@query("v07_one_pass_ridge", f"""{_FR}, k AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM f)),
 dd AS (SELECT date, k FROM k JOIN (SELECT max(date) AS date FROM f GROUP BY date_trunc('month', date) ORDER BY 1 OFFSET 3) USING (date)),
 s AS (SELECT dd.date, avg(x) AS mx, avg(r) AS mr, avg(y) AS my, var_pop(x) AS vx, var_pop(r) AS vr, covar_pop(x, r) AS cxr, covar_pop(x, y) AS cx, covar_pop(r, y) AS cr, 0.001 / stddev_pop(y) AS l
  FROM dd JOIN k ON k.k <= dd.k - 4 JOIN f ON f.date = k.date WHERE y IS NOT NULL GROUP BY 1),
 b AS (SELECT *, (cx * vr * (1 + l) - cr * cxr) / (vx * vr * (1 + l) * (1 + l) - cxr * cxr) AS bx, (cr * vx * (1 + l) - cx * cxr) / (vx * vr * (1 + l) * (1 + l) - cxr * cxr) AS br FROM s)
 SELECT date, ticker, round(my + bx * (x - mx) + br * (r - mr), 4) AS score FROM b JOIN f USING (date)""")
def _(t):
    """A model for every month but the first three, all from one pass."""
    f = _frame(t)
    dates = B.rebalance_dates(f, "month").withColumn("i", F.row_number().over(Window.orderBy("date"))).filter("i > 3").select("date")  # a row per month
    return rounded(B.one_pass_ridge(f, dates, ["x", "r"], "y", 4).select("date", "ticker", "score"))


_TONES = "(SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(the|and)\\b')) AS positive, len(regexp_extract_all(lower(text), '\\b(is|of)\\b')) AS negative FROM documents)"


def _passages(t) -> DataFrame:
    """Passages with a vector, the company (label) they are of, and counts of words that stand for a lexicon."""
    from crosspanel.operators.vectors import word_count

    words = t("documents").select(F.col("doc_id").alias("id"), word_count("text", ["the", "and"]).cast("long").alias("positive"), word_count("text", ["is", "of"]).cast("long").alias("negative"))
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("group"), "embedding").join(words, "id")


@query("n12_peer_tone", f"""WITH p AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS grp, embedding::DOUBLE[64] AS v, positive, negative FROM embeddings JOIN {_TONES} ON doc_id = vec_id),
 hit AS (SELECT q.id AS theme, p.* FROM p q JOIN p ON q.id <> p.id WHERE q.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY array_cosine_similarity(q.v, p.v) DESC, p.id) <= 30),
 peer AS (SELECT theme, grp, coalesce((sum(positive) - sum(negative)) / nullif(sum(positive) + sum(negative), 0), 0) AS t FROM hit GROUP BY 1, 2),
 own AS (SELECT grp, coalesce((sum(positive) - sum(negative)) / nullif(sum(positive) + sum(negative), 0), 0) AS tone FROM p GROUP BY 1),
 pairs AS (SELECT th.theme, own.grp, tone, count(peer.t) AS peers, avg(peer.t) AS m FROM (SELECT DISTINCT theme FROM peer) th, own LEFT JOIN peer ON peer.theme = th.theme AND peer.grp <> own.grp GROUP BY ALL)
 SELECT theme, grp AS company, CAST(peers AS BIGINT) AS peers, round(CASE WHEN peers >= 2 THEN greatest(-1, least(1, (tone - m) * 3)) ELSE 0 END, 6) AS gap FROM pairs""")
def _(t):
    from crosspanel.operators import vectors as V

    p = _passages(t)
    index = V.build_index(p)
    hits = V.search(index, p.filter("id % 100 = 0"), 30, probes=len(index.centroids)).select(F.col("query").alias("theme"), "id")
    sums = p.groupBy("group").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    tones = sums.select("group", F.coalesce(F.try_divide(F.col("p") - F.col("n"), F.nullif(F.col("p") + F.col("n"), F.lit(0))), F.lit(0.0)).alias("tone"))
    found = V.peer_tone(hits, p.select("id", "group", "positive", "negative"), tones, by=["theme"])
    return rounded(found.select("theme", F.col("group").alias("company"), "peers", "gap"), digits=6)


@query("j15_indexed_vectors")
def _(t):
    """The ten nearest of every hundredth vector by the index, with as many probes as other vectors need for 95 % of their neighbours."""
    from crosspanel.operators import vectors as V
    from crosspanel.operators.joins import nearest_vectors

    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index, others = V.build_index(e), e.filter("id % 100 = 50")
    probes = V.tuned_probes(index, nearest_vectors(others, e, 10), others, 0.95)
    return V.search(index, e.filter("id % 100 = 0"), 10, probes).drop("group")


def _feistel_sql() -> str:
    """One pass of the network of ``resampling.permuted`` over v, with b bits in each half: (draw, i, v, b, n)."""
    from crosspanel.operators.resampling import M1, M2, M3, ROUNDS

    body = "SELECT draw, i, b, n, v >> b AS l, v & ((1::HUGEINT << b) - 1) AS r FROM walk WHERE steps = 0 OR v >= n"
    for k in range(ROUNDS):
        key = f"((draw::HUGEINT * {M2} + {k * M3} + {42 * M1}) % 4294967296)"
        body = f"SELECT draw, i, b, n, r AS l, xor(l, xor(t, t >> 13) >> (32 - b)) AS r FROM (SELECT *, (xor(t0, t0 >> 15) * {M2}) % 4294967296 AS t FROM (SELECT *, (r * {M1} + {key}) % 4294967296 AS t0 FROM ({body})))"
    return f"SELECT draw, i, ((l << b) | r)::HUGEINT AS v, b, n, steps + 1 FROM (SELECT *, 1 AS steps FROM ({body}))"


@query("a24_permutation", f"""WITH RECURSIVE s AS (SELECT s_acctbal AS x, s_nationkey < 10 AS a, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
 z AS (SELECT max(n) AS n, CAST(greatest(4, ceil(ceil(log2(max(n))) / 2)) AS INTEGER) AS b, count(*) FILTER (a) AS k, sum(x) AS total FROM s),
 walk AS (SELECT draw, i::HUGEINT AS i, i::HUGEINT AS v, b, z.n AS n, 0 AS steps FROM s, z, range(0, 100) d(draw) UNION ALL {_feistel_sql()}),
 done AS (SELECT draw, walk.i AS i, v FROM walk WHERE steps > 0 AND v < n)
 SELECT draw, round(p / k - (total - p) / (z.n - k), 4) AS permuted FROM (SELECT draw, sum(CASE WHEN v < k THEN x ELSE 0 END) AS p FROM done JOIN s ON s.i = done.i, z GROUP BY 1), z""")
def _(t):
    from crosspanel.operators.resampling import resampled_spreads

    rows = t("supplier").withColumn("first", F.col("s_nationkey") < 10)
    return rounded(resampled_spreads(rows, "s_acctbal", "first", ["s_suppkey"], 100).select("draw", "permuted"))


@query("a24_spread_test")
def _(t):
    """2,000 permutations and bootstrap draws of the spread between customers of two groups of nations."""
    from crosspanel.operators.resampling import spread_test

    return spread_test(t("customer").withColumn("first", F.col("c_nationkey") < 5), "c_acctbal", "first", ["c_custkey"], 2_000)
