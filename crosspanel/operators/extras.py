"""Smaller steps of the ranking and reporting flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import col, div, series
from crosspanel.operators.joins import asof_forward, nearest_within


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """All columns but the keys with a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def with_prefix(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    """Names of the columns that start with one of the prefixes."""
    return [c for c in df.columns if c.startswith(prefixes)]


def core_only(df: DataFrame, keys: list[str], core: list[str]) -> DataFrame:
    """Keys and the core features that exist; none is an error."""
    have = [c for c in core if c in df.columns]
    if not have:
        raise ValueError("none of the core features exists")
    return df.select(*keys, *have)


def trade_summary(trades: DataFrame, day: Column, action: str, status: str, notional: str, slippage: str, source: str) -> DataFrame:
    """Per day: trades, buys and sells, filled ones, sums, mean slippage over all trades (none counts 0), sources."""
    return trades.groupBy(day.alias("day")).agg(
        F.count("*").alias("trades"), F.count(F.when(F.col(action) == "buy", 1)).alias("buys"), F.count(F.when(F.col(action) == "sell", 1)).alias("sells"), F.count(F.when(F.col(status) == "filled", 1)).alias("filled"),
        F.coalesce(F.sum(F.when(F.col(action) == "buy", F.col(notional))), F.lit(0.0)).alias("bought"), F.coalesce(F.sum(F.when(F.col(action) == "sell", F.col(notional))), F.lit(0.0)).alias("sold"),
        F.avg(F.coalesce(slippage, F.lit(0.0))).alias("mean_slippage"), F.count_distinct(source).alias("sources"),
    )


def abnormal_return(events: DataFrame, stock: DataFrame, market: DataFrame, h: int, on: str = "ticker", time: str = "date", price: str = "price") -> DataFrame:
    """Return over h rows from the first price at or after the event, less the market's over its own h rows from there."""
    s = stock.select(on, F.col(time).alias("__d"), (div(F.lead(price, h).over(series(on, time)), price) - 1).alias("own"))
    m = market.select(F.lit(0).alias("__k"), F.col(time).alias("__m"), (div(F.lead(price, h).over(series([], time)), price) - 1).alias("market"))
    out = asof_forward(events, s, [on], "at", "__d")
    # The market is one series, so its days are looked up once each, not in one task with all events.
    days = asof_forward(out.select(F.lit(0).alias("__k"), "at").distinct(), m, ["__k"], "at", "__m").select("at", "market")
    return out.join(days, "at", "left").withColumn("abnormal", F.col("own") - F.col("market")).select(*out.columns, "market", "abnormal").drop("__d")


def topic_ic_score(df: DataFrame, by: list[str], sentiment: str = "sentiment", ic: str = "ic", count: str = "n") -> DataFrame:
    """Per group: topic sentiments weighted by |IC| * sqrt(count), turned round where the IC is negative, and a confidence."""
    w = F.abs(ic) * F.sqrt(count)
    return df.groupBy(*by).agg(F.coalesce(div(F.sum(w * F.signum(ic) * F.col(sentiment)), F.nullif(F.sum(w), F.lit(0.0))), F.lit(0.0)).alias("ic_score"), F.least(F.sum(count) / 20, F.lit(1.0)).alias("ic_confidence"))


def blended_score(base: str | Column, other: str | Column, confidence: str | Column, most: float = 0.6) -> Column:
    """(1 - a) * base + a * other with a = min(most, .2 + .4 * confidence)."""
    a = F.least(F.lit(most), 0.2 + 0.4 * col(confidence))
    return (1 - a) * col(base) + a * col(other)


def peer_gap(df: DataFrame, value: str, group: str, times: float = 3.0, least: int = 2) -> Column:
    """Value less the mean of the group's other members, times a factor, inside [-1, 1]; NULL without enough peers."""
    w = Window.partitionBy(group)
    n = F.count(value).over(w)
    others = div(F.sum(value).over(w) - F.col(value), F.nullif(n - 1, F.lit(0)))
    gap = (F.col(value) - others) * times
    return F.when((n - 1 >= least) & F.col(value).isNotNull(), F.greatest(F.least(gap, F.lit(1.0)), F.lit(-1.0)))


def quarter_snapshots(quarters: DataFrame, revenue: str, income: str, equity: str, entity: str = "ticker", report: str = "report_date", lag_days: int = 60) -> DataFrame:
    """Each quarter as known ``lag_days`` after its end: margins, return on equity from four times the quarter, growth on four rows before."""
    before = F.lag(revenue, 4).over(series(entity, report))
    return quarters.select(
        entity, F.date_add(report, lag_days).alias("date"), div(income, F.nullif(F.col(revenue), F.lit(0.0))).alias("net_margin"), div(F.col(income) * 4, F.nullif(F.col(equity), F.lit(0.0))).alias("roe"),
        (F.col(revenue) * 4).alias("revenue_ttm"), div(F.col(revenue) - before, F.nullif(F.abs(before), F.lit(0.0))).alias("revenue_growth_1y"),
    )


def filing_yield(periods: DataFrame, filings: DataFrame, prices: DataFrame, days: int = 10) -> DataFrame:
    """Four times a quarter's cash flow over the market value at the first price after its filing, which lies within ``days`` of the
    period's end.  Columns: periods (ticker, period_end, fcf, shares), filings (ticker, filed), prices (ticker, date, price)."""
    near = nearest_within(periods, filings, ["ticker"], "period_end", "filed", -days, days)
    priced = asof_forward(near, prices.select("ticker", F.col("date").alias("priced"), "price"), ["ticker"], "filed", "priced", strict=True)
    return priced.withColumn("fcf_yield", div(F.col("fcf") * 4, F.nullif(F.col("price") * F.col("shares"), F.lit(0.0))))


def risk_adjusted(score: str, risk: str, alpha: str | None = None, value: str | None = None) -> Column:
    """Score lowered by filing risk, with additions from an alpha model and from quality and value points where they exist."""
    out = F.col(score) - 0.2 * F.coalesce(F.col(risk), F.lit(0.0))
    for c, w in ((alpha, 0.15), (value, 0.1)):
        if c:
            out = out + w * F.coalesce(F.col(c), F.lit(0.0))
    return F.greatest(F.least(out, F.lit(1.0)), F.lit(-1.0))


def report_lines(summary: DataFrame, digits: int = 4) -> list[str]:
    """'name: value' lines of a one-row summary."""
    row = summary.first()
    return [f"{k}: {v:.{digits}f}" if isinstance(v, float) else f"{k}: {v}" for k, v in (row.asDict() if row else {}).items()]
