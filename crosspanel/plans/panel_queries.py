"""Queries for the time-series and cross-section operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.functions.columns import average_rank, first_rank, series
from crosspanel.operators import cross_section as X
from crosspanel.operators import technical as T
from crosspanel.plans.registry import BENCH, PRICES, benchmark, over, prices, query, roll, rounded

W = "OVER (PARTITION BY ticker ORDER BY date)"
_R = f"WITH panel AS ({PRICES}), r AS (SELECT *, price / lag(price) {W} - 1 AS r, ln(price / lag(price) {W}) AS lr FROM panel)"


def _returns(t):
    return prices(t).withColumn("r", T.simple_return())


def _out(df, *names):
    return rounded(df.select("date", "ticker", *names))


def _sql(body: str, **columns: str) -> str:
    return f"{_R} SELECT date, ticker, " + ", ".join(f"round({e}, 4) AS {c}" for c, e in columns.items()) + f" FROM {body}"


@query("t01_t02_returns", _sql("r", r="r", lr="lr"))
def _(t):
    return _out(_returns(t).withColumn("lr", T.log_return()), "r", "lr")


@query("t03_momentum_skip", _sql("r", mom_12_1=f"CASE WHEN count(r) {over(52)} >= 52 THEN product(1 + r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND 4 PRECEDING) - 1 END"))
def _(t):
    return _out(_returns(t).withColumn("mom_12_1", T.momentum("r", 52, 4)), "mom_12_1")


@query("t04_t05_t06_momentum_volatility_sharpe", _sql("r", mom=roll("sum", "r", 21), vol=f"{roll('stddev_samp', 'r', 21)} * sqrt(252)", sharpe=f"({roll('avg', 'r', 63)} - 0.02 / 252) * 252 / nullif({roll('stddev_samp', 'r', 63)} * sqrt(252), 0)"))
def _(t):
    return _out(_returns(t).select("*", T.momentum_sum("r", 21).alias("mom"), T.volatility("r", 21).alias("vol"), T.rolling_sharpe("r", 63, 0.02).alias("sharpe")), "mom", "vol", "sharpe")


@query("t07_max_drawdown", f"WITH panel AS ({PRICES}), d AS (SELECT *, price / max(price) {over(52)} - 1 AS d FROM panel) SELECT date, ticker, round({roll('min', 'd', 52)}, 4) AS max_drawdown FROM d")
def _(t):
    return _out(T.with_max_drawdown(prices(t), 52), "max_drawdown")


@query("t08_rsi", f"WITH panel AS ({PRICES}), s AS (SELECT *, coalesce(price - lag(price) {W}, 0) AS s FROM panel), g AS (SELECT *, greatest(s, 0) AS g, greatest(-s, 0) AS l FROM s) SELECT date, ticker, round(100 - 100 / (1 + ({roll('avg', 'g', 14)}) / nullif({roll('avg', 'l', 14)}, 0)), 4) AS rsi_14 FROM g")
def _(t):
    return _out(T.with_rsi(prices(t)), "rsi_14")


@query("t09_t16_average_ratios", f"WITH panel AS ({PRICES}) SELECT date, ticker, round(({roll('avg', 'price', 20)}) / ({roll('avg', 'price', 50)}), 4) AS ma_ratio, round(({roll('avg', 'price', 63, 31)}) / ({roll('avg', 'price', 252, 126)}) - 1, 4) AS trend FROM panel")
def _(t):
    return _out(prices(t).select("*", T.average_ratio().alias("ma_ratio"), T.trend_health().alias("trend")), "ma_ratio", "trend")


@query("t10_all_technical", f"WITH panel AS ({PRICES}), r AS (SELECT *, price / lag(price) {W} - 1 AS r, coalesce(price - lag(price) {W}, 0) AS s FROM panel), g AS (SELECT *, greatest(s, 0) AS g, greatest(-s, 0) AS l FROM r) SELECT date, ticker, " + ", ".join(f"round({roll('sum', 'r', n)}, 4) AS mom_{n}" for n in (21, 63, 126, 252)) + ", " + ", ".join(f"round(({roll('stddev_samp', 'r', n)}) * sqrt(252), 4) AS vol_{n}" for n in (21, 63)) + f", round(({roll('avg', 'price', 20)}) / ({roll('avg', 'price', 50)}), 4) AS ma_ratio_20_50, round(100 - 100 / (1 + ({roll('avg', 'g', 14)}) / nullif({roll('avg', 'l', 14)}, 0)), 4) AS rsi_14 FROM g")
def _(t):
    return _out(T.with_technical(prices(t)), *[f"mom_{n}" for n in (21, 63, 126, 252)], "vol_21", "vol_63", "ma_ratio_20_50", "rsi_14")


@query("t11_short_reversal", f"WITH panel AS ({PRICES}) SELECT date, ticker, round(price / lag(price, 5) {W} - 1, 4) AS rev_5, round(price / lag(price, 10) {W} - 1, 4) AS rev_10 FROM panel")
def _(t):
    return _out(prices(t).select("*", T.simple_return(n=5).alias("rev_5"), T.simple_return(n=10).alias("rev_10")), "rev_5", "rev_10")


_B = f"""WITH panel AS ({PRICES}), bench AS ({BENCH}), b AS (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS rb FROM bench),
 r AS (SELECT panel.*, price / lag(price) {W} - 1 AS r, rb FROM panel LEFT JOIN b USING (date)),
 beta AS (SELECT *, CASE WHEN count(CASE WHEN r IS NOT NULL AND rb IS NOT NULL THEN 1 END) {over(60)} >= 30 THEN covar_samp(r, rb) {over(60)} END
  / nullif({roll('var_samp', 'rb', 60, 30)}, 0) AS beta FROM r), e AS (SELECT *, r - beta * rb AS resid FROM beta)"""


def _residuals(t):
    panel = prices(t)
    b = benchmark(panel).select("date", T.simple_return(w=series([], "date")).alias("rb"))
    return T.with_residuals(T.with_benchmark(panel.withColumn("r", T.simple_return()), b))


@query("t12_t13_t19_beta_residuals", f"{_B} SELECT date, ticker, round(beta, 4) AS beta, round(resid, 4) AS resid FROM e")
def _(t):
    return _out(_residuals(t), "beta", "resid")


@query("t14_t15_residual_momentum_volatility", f"{_B} SELECT date, ticker, round({roll('sum', 'resid', 63)}, 4) AS resid_mom, round(({roll('stddev_samp', 'resid', 63)}) * sqrt(252), 4) AS idio_vol FROM e")
def _(t):
    return _out(_residuals(t).select("*", T.momentum_sum("resid", 63).alias("resid_mom"), T.volatility("resid", 63).alias("idio_vol")), "resid_mom", "idio_vol")


@query("t17_median_absolute_deviation", _sql("r", mad=f"CASE WHEN count(r) {over(21)} = 21 THEN mad(r) {over(21)} END"))
def _(t):
    return _out(_returns(t).withColumn("mad", T.deviation("r", 21)), "mad")


@query("t18_sector_one_hot", f"WITH panel AS ({PRICES}) SELECT date, ticker, " + ", ".join(f"CASE WHEN sector = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sector_{s}" for s in "12345") + " FROM panel")
def _(t):
    return prices(t).select("date", "ticker", *[F.when(F.col("sector") == s, 1.0).otherwise(0.0).alias(f"sector_{s}") for s in "12345"])


@query("t21_realised_volatility", _sql("r", rv=roll("stddev_samp", "lr", 20, 10)))
def _(t):
    from crosspanel.functions.columns import rolling

    return _out(_returns(t).withColumn("lr", T.log_return()).withColumn("rv", rolling(F.stddev_samp, "lr", 20, series(), 10)), "rv")


@query("t22_market_regime", f"""WITH panel AS ({PRICES}), bench AS ({BENCH}), r AS (SELECT *, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM bench),
 v AS (SELECT *, ({roll('stddev_samp', 'r', 21, part='ORDER BY date')}) * sqrt(252) AS vol, coalesce(price > {roll('avg', 'price', 40, part='ORDER BY date')}, false) AS trend_up FROM r)
 SELECT date, round(vol, 4) AS vol, trend_up, CASE WHEN coalesce(vol < (SELECT median(vol) FROM v), false) AND trend_up THEN 'MOMENTUM' ELSE 'QUALITY' END AS regime FROM v""")
def _(t):
    return rounded(T.regime(benchmark(prices(t)), trend=40).select("date", "vol", "trend_up", "regime"))


@query("t23_relative_strength", f"""WITH panel AS ({PRICES}), bench AS ({BENCH}), b AS (SELECT date, price / lag(price, 21) OVER (ORDER BY date) - 1 AS b FROM bench),
 r AS (SELECT *, price / lag(price, 21) {W} - 1 AS a, price / lag(price, 63) {W} - 1 AS m, price / lag(price, 126) {W} - 1 AS z, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM panel)
 SELECT r.date, ticker, round(a - coalesce(b, 0), 4) AS relative, round(CASE WHEN z IS NOT NULL THEN 0.3 * (a - coalesce(b, 0)) + 0.5 * m + 0.2 * z ELSE (0.3 * (a - coalesce(b, 0)) + 0.5 * m) / 0.8 END, 4) AS strength FROM r LEFT JOIN b ON r.date = b.date WHERE n = 1""")
def _(t):
    panel = prices(t)
    return _out(T.relative_strength(panel, benchmark(panel)), "relative", "strength")


@query("t24_leading_dispersion", f"""{_R}, d AS (SELECT date, stddev_samp(r) AS d FROM r GROUP BY 1) SELECT date, round(d, 4) AS dispersion, round(avg(d) {over(21, 'ORDER BY date')}, 4) AS d21, round(avg(d) {over(63, 'ORDER BY date')}, 4) AS d63 FROM d""")
def _(t):
    w = series([], "date")
    d = _returns(t).groupBy("date").agg(F.stddev_samp("r").alias("dispersion"))
    return rounded(d.select("date", "dispersion", F.avg("dispersion").over(w.rowsBetween(-20, 0)).alias("d21"), F.avg("dispersion").over(w.rowsBetween(-62, 0)).alias("d63")))


@query("t25_volatility_scale", _sql("r", scale=f"CASE WHEN count(r) {over(20)} < 5 THEN 1 ELSE greatest(least(0.15 / nullif(stddev_samp(r) {over(20)} * sqrt(252), 0), 2), 0.25) END"))
def _(t):
    return _out(_returns(t).withColumn("scale", T.volatility_scale("r")), "scale")


XS = "OVER (PARTITION BY date)"
_M = f"{_R}, m AS (SELECT *, {roll('sum', 'r', 12)} AS x FROM r)"


def _momentum(t):
    return _returns(t).withColumn("x", T.momentum_sum("r", 12))


@query("x01_robust_z", f"{_M}, c AS (SELECT *, median(x) {XS} AS c, count(x) {XS} AS n FROM m), d AS (SELECT *, median(abs(x - c)) {XS} AS d FROM c) SELECT date, ticker, round((x - c) / nullif(CASE WHEN n >= 3 THEN d * 1.4826 END, 0), 4) AS z FROM d")
def _(t):
    return _out(X.with_robust_z(_momentum(t), "x", ["date"], "z"), "z")


@query("x02_x06_standard_z", f"{_M} SELECT date, ticker, round((x - avg(x) {XS}) / nullif(stddev_samp(x) {XS}, 0), 4) AS z FROM m")
def _(t):
    from crosspanel.functions.columns import section, zscore

    return _out(_momentum(t).withColumn("z", zscore("x", section())), "z")


@query("x03_sector_z", f"{_M} SELECT date, ticker, round(CASE WHEN count(*) OVER s >= 2 THEN (x - avg(x) OVER s) / nullif(stddev_samp(x) OVER s, 0) ELSE x END, 4) AS z FROM m WINDOW s AS (PARTITION BY date, sector)")
def _(t):
    return _out(X.with_group_z(_momentum(t), "x", ["date"], "sector", "z"), "z")


@query("x04_normalise_all", f"{_M} SELECT date, ticker, round((r - avg(r) {XS}) / nullif(stddev_samp(r) {XS}, 0), 4) AS r, round((x - avg(x) {XS}) / nullif(stddev_samp(x) {XS}, 0), 4) AS x, CASE WHEN sector = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sector_1 FROM m")
def _(t):
    return _out(X.with_all_z(_momentum(t).withColumn("sector_1", F.when(F.col("sector") == "1", 1.0).otherwise(0.0)), ["r", "x", "sector_1"], ["date"]), "r", "x", "sector_1")


@query("x05_winsorise", f"{_M}, q AS (SELECT date AS d, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM m GROUP BY 1) SELECT date, ticker, round(CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END, 4) AS x FROM m LEFT JOIN q ON date = d")
def _(t):
    return _out(_momentum(t).withColumn("x", X.winsorised("x", 0.1, ["date"])), "x")


@query("x07_z_or_zero", f"{_M} SELECT date, ticker, round(CASE WHEN x IS NOT NULL THEN coalesce((x - avg(x) {XS}) / nullif(stddev_samp(x) {XS}, 0), 0) END, 4) AS z FROM m")
def _(t):
    return _out(_momentum(t).withColumn("z", X.z_or_zero("x", ["date"])), "z")


_RANKS = f"{_M}, k AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) END AS k, count(*) OVER (PARTITION BY date, x) AS e, count(x) {XS} AS n FROM m)"


@query("x08_x09_average_ranks", f"{_RANKS} SELECT date, ticker, round(CASE WHEN n >= 2 THEN (k + (e - 1) / 2.0 - 1) / (n - 1) END, 4) AS unit, round((k + (e - 1) / 2.0) / nullif(n, 0), 4) AS pct FROM k")
def _(t):
    return _out(_momentum(t).select("*", X.unit_rank("x", ["date"]).alias("unit"), X.percent_rank("x", ["date"]).alias("pct")), "unit", "pct")


@query("x10_x11_percentiles", f"{_RANKS}, p AS (SELECT *, 100 * (k - 1 + 0.5 * e) / nullif(n, 0) AS p FROM k) SELECT date, ticker, round(p, 4) AS mid, round(100.0 * (k - 1) / nullif(n, 0), 4) AS below, CASE WHEN p >= 90 THEN 'very_high' WHEN p >= 80 THEN 'high' WHEN p <= 10 THEN 'very_low' WHEN p <= 20 THEN 'low' WHEN p IS NOT NULL THEN 'mid' END AS band FROM p")
def _(t):
    df = _momentum(t).select("*", X.mid_percentile("x", ["date"]).alias("mid"), X.below_percentile("x", ["date"]).alias("below"))
    return _out(df.withColumn("band", X.band("mid")), "mid", "below", "band")


@query("x12_x13_first_rank_buckets", f"{_M}, k AS (SELECT *, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST, ticker) END AS k, count(x) {XS} AS n FROM m) SELECT date, ticker, CAST(k AS BIGINT) AS k, CAST(CASE WHEN n > 1 THEN greatest(1, ceil((k - 1) * 5 / (n - 1)::DOUBLE)) WHEN n = 1 AND k IS NOT NULL THEN 1 END AS BIGINT) AS bucket FROM k WHERE k IS NOT NULL")
def _(t):
    df = _momentum(t).select("*", first_rank("x", ["date"], "ticker").alias("k"), X.quantile("x", 5, ["date"]).alias("bucket"))
    return df.filter("k is not null").select("date", "ticker", "k", "bucket")


@query("x14_value_buckets", f"{_M}, q AS (SELECT date AS d, list_sort(list_distinct(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS q FROM m GROUP BY 1) SELECT date, ticker, CAST(CASE WHEN x IS NOT NULL AND len(q) > 1 THEN len(list_filter(q[2:len(q) - 1], lambda e: x > e)) + 1 END AS BIGINT) AS bucket FROM m LEFT JOIN q ON date = d WHERE x IS NOT NULL")
def _(t):
    return _momentum(t).withColumn("bucket", X.value_bucket("x", 4, ["date"])).filter("x is not null").select("date", "ticker", "bucket")


@query("x15_fixed_bins", f"{_M} SELECT date, ticker, CASE WHEN x IS NULL THEN NULL WHEN x <= -0.1 THEN 'down' WHEN x <= 0.1 THEN 'flat' ELSE 'up' END AS bin FROM m")
def _(t):
    return _momentum(t).select("date", "ticker", X.cut("x", [-0.1, 0.1], ["down", "flat", "up"]).alias("bin"))


@query("x16_x17_score_scaling", f"{_M}, c AS (SELECT *, avg(x) {XS} AS a, stddev_pop(x) {XS} AS s, median(x) {XS} AS c, count(x) {XS} AS n FROM m), d AS (SELECT *, median(abs(x - c)) {XS} AS d FROM c) SELECT date, ticker, round(CASE WHEN x IS NOT NULL THEN coalesce((x - a) / nullif(s, 0), 0) END, 4) AS z, round(CASE WHEN n >= 3 AND d > 0 THEN greatest(least((x - c) / (d * 1.4826), 5), -5) END, 4) AS robust FROM d WHERE x IS NOT NULL")
def _(t):
    from crosspanel.functions.columns import section, zscore

    df = _momentum(t).withColumn("z", F.when(F.col("x").isNotNull(), F.coalesce(zscore("x", section(), True), F.lit(0.0))))
    return _out(X.with_robust_z(df, "x", ["date"], "robust", limit=5.0).filter("x is not null"), "z", "robust")


@query("x18_dispersion_breadth", f"{_M} SELECT date, round(stddev_samp(x), 4) AS dispersion, round(CASE WHEN count(x) >= 10 THEN avg(CASE WHEN x > 0.05 THEN 1.0 WHEN x <= 0.05 THEN 0.0 END) END, 4) AS breadth FROM m GROUP BY 1")
def _(t):
    return rounded(X.dispersion(_momentum(t), "x", ["date"]))


@query("a07_information_coefficient", f"""{_M}, f AS (SELECT *, lead(price, 4) {W} / price - 1 AS y FROM m), g AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL),
 k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS b FROM g)
 SELECT date, round(corr(a, b), 4) AS ic, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    from crosspanel.operators.metrics import information_coefficient

    df = _momentum(t).withColumn("y", F.lead("price", 4).over(series()) / F.col("price") - 1)
    return rounded(information_coefficient(df, "x", "y", ["date"]))
