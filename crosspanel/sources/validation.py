"""Declared checks over tables: one aggregation for the counts, or the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the logical tables; each is true for a good row.
SCHEMAS: dict[str, dict[str, str]] = {
    "prices": {"date known": "date is not null", "ticker known": "ticker is not null", "price positive": "adj_close > 0"},
    "ohlcv": {"high at least low": "high >= low", "high at least open and close": "high >= open and high >= close", "volume not negative": "volume >= 0"},
    "returns": {"return plausible": "r between -1 and 10"},
    "signals": {"signal in range": "signal between -1 and 1", "confidence in range": "confidence between 0 and 1"},
    "trades": {"side known": "side in ('buy', 'sell')", "quantity positive": "quantity > 0", "price positive": "price > 0"},
    "positions": {"weight in range": "weight between -1 and 1"},
    "weights": {"weight known": "weight is not null"},
    "fundamentals": {"market cap positive": "market_cap is null or market_cap > 0"},
    "transcripts": {"quarter in range": "fiscal_quarter between 1 and 4", "year plausible": "fiscal_year between 1990 and 2100"},
    "news_articles": {"url known": "url is not null", "score in range": "sentiment_score is null or sentiment_score between -1 and 1"},
    "factor_returns": {"market known": "market is not null"},
}


def _bad(rule: str | Column) -> Column:
    r = F.expr(rule) if isinstance(rule, str) else rule
    return ~F.coalesce(r, F.lit(False))


def counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations) in one pass; a rule that gives NULL is broken."""
    one = df.agg(*[F.coalesce(F.sum(_bad(r).cast("long")), F.lit(0)).alias(f"v{i}") for i, r in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(rules)])).alias("s")).select("s.*")


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a rule, with the names of the rules."""
    broken = F.filter(F.array(*[F.when(_bad(r), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def require(df: DataFrame, name: str, rules: dict[str, str] | None = None) -> DataFrame:
    """df, checked when it is read: the first broken rule of a row raises an error with the rule's name."""
    for rule, r in (rules or SCHEMAS[name]).items():
        df = df.filter(F.when(_bad(r), F.raise_error(F.lit(f"{name}: {rule}")).cast("boolean")).otherwise(True))
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_weekdays(dates: DataFrame, time: str = "date") -> DataFrame:
    """Mondays to Fridays between the first and the last date that are missing."""
    span = dates.agg(F.min(time).alias("a"), F.max(time).alias("b")).select(F.explode(F.sequence("a", "b")).alias(time))
    return span.filter(~F.dayofweek(time).isin(1, 7)).join(dates.select(time).distinct(), time, "left_anti")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
