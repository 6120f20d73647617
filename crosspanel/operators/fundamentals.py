"""Fundamental factors and valuation signals over (date, ticker) rows or statement items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import clip, div, rolling, section, series, zscore
from crosspanel.operators.cross_section import winsorised

#: Columns of the fundamentals table.
COLUMNS = ("market_cap", "pe_ratio", "pb_ratio", "ps_ratio", "dividend_yield", "roe", "roa", "gross_margin", "operating_margin", "net_margin", "revenue_ttm", "revenue_growth_1y", "eps_ttm", "eps_growth_1y")


def available(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns with any value: one pass, one row."""
    have = [c for c in columns if c in df.columns]
    row = df.agg(*[F.count(c).alias(c) for c in have]).first() if have else {}
    return {c for c in have if row[c]}


def value_factors() -> dict[str, Column]:
    return {f"value_{n}": div(F.lit(1.0), F.nullif(F.col(c), F.lit(0.0))) for n, c in (("earnings", "pe_ratio"), ("book", "pb_ratio"), ("sales", "ps_ratio"))}


def quality_factors(have: set[str]) -> dict[str, Column]:
    out = {f"quality_{c}": F.col(c) for c in ("roe", "roa", "net_margin", "quick_ratio") if c in have}
    if "debt_equity" in have:
        out["quality_low_debt"] = -F.col("debt_equity")
    if {"total_assets", "total_liabilities"} <= have:
        out["quality_asset_coverage"] = div("total_assets", F.nullif(F.col("total_liabilities"), F.lit(0.0)))
    return out


def yoy_growth(x: str, entity: str = "ticker", time: str = "date", low: float = -2.0, high: float = 5.0) -> Column:
    """Change against four rows before, clipped."""
    before = F.lag(x, 4).over(series(entity, time))
    return clip(div(F.col(x) - before, F.nullif(before, F.lit(0.0))), low, high)


def growth_factors(have: set[str]) -> dict[str, Column]:
    return {f"growth_{n}": F.col(c) if c in have else yoy_growth(raw) for n, c, raw in (("revenue", "revenue_growth_1y", "revenue"), ("eps", "eps_growth_1y", "eps_basic")) if c in have or raw in have}


def profitability_factors(have: set[str]) -> dict[str, Column]:
    margins = {f"prof_{c}": F.col(c) for c in ("gross_margin", "operating_margin", "net_margin") if c in have}
    return margins or {f"prof_{c}": F.col(c) for c in ("roe", "roa") if c in have}


def size_factor(have: set[str]) -> dict[str, Column]:
    c = "market_cap" if "market_cap" in have else "total_assets" if "total_assets" in have else None
    return {"size_log": F.log(F.when(F.col(c) > 0, F.col(c)))} if c else {}


def build_factors(df: DataFrame, have: set[str], p: float = 0.01) -> DataFrame:
    """All factors, winsorised and as z-scores by date."""
    factors = {**(value_factors() if {"pe_ratio", "pb_ratio", "ps_ratio"} <= have else {}), **quality_factors(have), **growth_factors(have), **profitability_factors(have), **size_factor(have)}
    raw = df.select("date", "ticker", *[c.alias(n) for n, c in factors.items()])
    cut = raw.select("date", "ticker", *[winsorised(n, p, ["date"]).alias(n) for n in factors])
    return cut.select("date", "ticker", *[zscore(n, section()).alias(n) for n in factors])


def coverage(df: DataFrame, columns: list[str], unit: str = "year", entity: str = "ticker", time: str = "date") -> DataFrame:
    """(ticker, period, share of cells with a value)."""
    filled = sum(F.count(c) for c in columns)
    return df.groupBy(entity, F.date_trunc(unit, time).cast("date").alias("period")).agg((filled / (F.count(F.lit(1)) * len(columns))).alias("coverage"))


def well_covered(cov: DataFrame, least: float, since: str | None = None, entity: str = "ticker") -> DataFrame:
    """Entities whose mean coverage, overall or from a period on, reaches the least."""
    rows = cov.filter(F.col("period") >= F.lit(since).cast("date")) if since else cov
    return rows.groupBy(entity).agg(F.avg("coverage").alias("coverage")).filter(F.col("coverage") >= least)


def masked(df: DataFrame, columns: list[str], entities: list[str], entity: str = "ticker") -> DataFrame:
    """NULL in the columns of the listed entities."""
    return df.select(*[F.when(~F.col(entity).isin(entities), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def points(x: str | Column, bands: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Points of the first band (least value, points) that x reaches; NULL for NULL."""
    c = F.col(x) if isinstance(x, str) else x
    out = F.when(c.isNull(), F.lit(None).cast("double"))
    for least, p in bands:
        out = out.when(c >= least, float(p))
    return out.otherwise(float(otherwise))


def point_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """100 * points / the greatest points of the parts that have data; NULL without any."""
    got = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p, _ in parts.values()])
    most = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), float(m)).otherwise(0.0) for p, m in parts.values()])
    return div(100 * got, F.nullif(most, F.lit(0.0)))


def grade(score: str) -> Column:
    c = F.col(score)
    return F.when(c >= 80, "A").when(c >= 65, "B").when(c >= 50, "C").when(c >= 35, "D").when(c.isNotNull(), "F")


#: Medians of the gross margin and of price to earnings by sector; others have .40 and 18.
MARGINS = {
    "Technology": 0.55, "Healthcare": 0.50, "Financial Services": 0.60, "Consumer Cyclical": 0.35, "Consumer Defensive": 0.35, "Industrials": 0.30,
    "Basic Materials": 0.25, "Energy": 0.30, "Utilities": 0.35, "Real Estate": 0.55, "Communication Services": 0.45,
}
EARNINGS_MULTIPLES = {
    "Technology": 28, "Healthcare": 22, "Financial Services": 12, "Consumer Cyclical": 18, "Consumer Defensive": 20, "Industrials": 18,
    "Basic Materials": 12, "Energy": 10, "Utilities": 16, "Real Estate": 35, "Communication Services": 18,
}


def quality_value(df: DataFrame, sector: str = "sector") -> DataFrame:
    """Adds quality_score, value_score, composite_score (0 to 100), grade of each of the first two, direction and strength.

    Seven parts of quality and five of value give points on fixed bands; a score is the share of the points that the known parts could
    give, 0 without any.  Columns: roe, roa, gross_margin, operating_margin, debt_equity (above 10: in percent), current_ratio,
    earnings_growth; pe_ratio, pb_ratio, ev_ebitda, ps_ratio, fcf_yield.  Absent columns and NULLs are unknown; multiples of 0 or less
    too, but a negative price to earnings gives 0 points.
    """
    have = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in (
        "roe", "roa", "gross_margin", "operating_margin", "debt_equity", "current_ratio", "earnings_growth", "pe_ratio", "pb_ratio", "ev_ebitda", "ps_ratio", "fcf_yield",
    )}
    of_sector = lambda table, other: F.coalesce(*[F.when(F.col(sector) == k, F.lit(float(v))) for k, v in table.items()], F.lit(float(other)))
    margin, multiple = of_sector(MARGINS, 0.40), of_sector(EARNINGS_MULTIPLES, 18)

    def from_(c: str, *bands: tuple) -> Column:
        """Points of the first band whose limit the value reaches; NULL for an unknown value."""
        return F.when(have[c].isNotNull(), F.coalesce(*[F.when(have[c] >= limit, p) for limit, p in bands], F.lit(0)))

    def below(x: Column, *bands: tuple) -> Column:
        return F.when(x > 0, F.coalesce(*[F.when(x < limit, p) for limit, p in bands], F.lit(0)))

    debt = F.when(have["debt_equity"] > 10, have["debt_equity"] / 100).otherwise(have["debt_equity"])
    owed = F.when(debt.isNotNull(), F.when(debt <= 0.5, 15).when(debt <= 1.0, 10).when(debt <= 2.0, 5).otherwise(0))
    pe = have["pe_ratio"]
    quality = {
        "roe": (from_("roe", (0.15, 20), (0.10, 12), (0.05, 5)), 20), "roa": (from_("roa", (0.08, 15), (0.05, 10), (0.02, 5)), 15),
        "gross": (from_("gross_margin", (margin * 1.2, 15), (margin, 10), (margin * 0.8, 5)), 15), "operating": (from_("operating_margin", (0.15, 15), (0.10, 10), (0.05, 5)), 15),
        "debt": (owed, 15), "current": (from_("current_ratio", (1.5, 10), (1.0, 6)), 10), "growth": (from_("earnings_growth", (0.20, 10), (0.10, 7), (0.0, 4)), 10),
    }
    value = {
        "pe": (F.when(pe < 0, 0).otherwise(below(pe, (15, 25), (multiple, 15), (multiple * 1.5, 8))), 25), "pb": (below(have["pb_ratio"], (3, 20), (5, 12), (10, 5)), 20),
        "ev": (below(have["ev_ebitda"], (10, 20), (15, 12), (20, 5)), 20), "ps": (below(have["ps_ratio"], (2, 15), (5, 8), (10, 3)), 15),
        "fcf": (from_("fcf_yield", (0.05, 20), (0.03, 12), (0.01, 5)), 20),
    }
    out = df.withColumn("quality_score", F.coalesce(point_score(quality), F.lit(0.0))).withColumn("value_score", F.coalesce(point_score(value), F.lit(0.0)))
    out = out.withColumn("composite_score", (F.col("quality_score") + F.col("value_score")) / 2).withColumn("quality_grade", grade("quality_score")).withColumn("value_grade", grade("value_score"))
    c = F.col("composite_score")
    out = out.withColumn("direction", F.when(c >= 65, "long").when(c <= 35, "short"))
    return out.withColumn("strength", F.when(c >= 80, "strong").when(c >= 65, "moderate").when(c <= 20, "strong").when(c <= 35, "weak").otherwise("none"))


def pivot_items(df: DataFrame, items: list[str], keys: tuple[str, ...] = ("symbol", "report_date"), name: str = "item_name", value: str = "item_value") -> DataFrame:
    """Statement items as columns; the list of items is stated, so no extra pass looks for it."""
    return df.groupBy(*keys).pivot(name, items).agg(F.first(value, ignorenulls=True))


def with_ttm(df: DataFrame, x: str, entity: str = "symbol", time: str = "report_date") -> DataFrame:
    """Sum of the last four rows and its change against four rows before."""
    w = series(entity, time)
    df = df.withColumn(f"{x}_ttm", rolling(F.sum, x, 4, w))
    before = F.lag(f"{x}_ttm", 4).over(w)
    return df.withColumn(f"{x}_growth", div(F.col(f"{x}_ttm") - before, F.nullif(F.abs(before), F.lit(0.0))))


def available_on(report: str) -> Column:
    """Date on which a report is public: 75 days after half-year and year ends, else 45."""
    return F.when(F.month(report).isin(6, 12), F.date_add(report, 75)).otherwise(F.date_add(report, 45))


def dcf_value(fcf: str | Column, growth: str | Column, rate: float = 0.10, terminal: float = 0.025, years: int = 5, low: float = -0.1, high: float = 0.25, default: float = 0.05) -> Column:
    """Present value of ``years`` growing cash flows and of what follows."""
    f = F.col(fcf) if isinstance(fcf, str) else fcf
    g = F.coalesce(clip(growth, low, high), F.lit(default))
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda s, i: s + f * F.pow((1 + g) / (1 + rate), i.cast("double")))
    last = f * F.pow(1 + g, F.lit(float(years))) * (1 + terminal) / (rate - terminal) / (1 + rate) ** years
    return F.when(f > 0, flows + last)


def median_growth(values: str | Column, low: float = -0.5, high: float = 1.0, least: int = 3) -> Column:
    """Median of the clipped growth between neighbours of an array, from so many positive points on."""
    a = F.filter(values, lambda v: v > 0)
    n = F.size(a)
    steps = F.when(n >= least, F.array_sort(F.transform(F.sequence(F.lit(2), n), lambda i: F.greatest(F.least(F.element_at(a, i) / F.element_at(a, i - 1) - 1, F.lit(high)), F.lit(low)))))
    m = F.size(steps)
    return (F.element_at(steps, F.floor((m + 1) / 2).cast("int")) + F.element_at(steps, F.floor(m / 2).cast("int") + 1)) / 2


def revisions(now: str, before: dict[str, str]) -> dict[str, Column]:
    """Relative change of an estimate against each earlier one; composite: mean of those known; acceleration: 7 less 30 days."""
    out = {f"rev_{k}": div(F.col(now) - F.col(c), F.nullif(F.abs(c), F.lit(0.0))) for k, c in before.items()}
    known = F.filter(F.array(*out.values()), lambda v: v.isNotNull())
    out["composite"] = div(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.nullif(F.size(known).cast("double"), F.lit(0.0)))
    if {"7", "30"} <= before.keys():
        out["acceleration"] = out["rev_7"] - out["rev_30"]
    return out


def combined_signals(df: DataFrame, a: str, b: str) -> DataFrame:
    """z of both over all rows, their mean, a .4/.6 mix, product and agreement.  The two means and deviations are one row."""
    s = df.agg(*[f(c).alias(f"__{n}_{c}") for c in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    df = df.crossJoin(F.broadcast(s))
    za, zb = (div(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))) for c in (a, b))
    out = df.withColumn("za", za).withColumn("zb", zb).drop(*s.columns)
    return out.withColumn("mean", (F.col("za") + F.col("zb")) / 2).withColumn("mix", 0.4 * F.col("za") + 0.6 * F.col("zb")).withColumn("product", F.col("za") * F.col("zb")).withColumn("double", F.when((F.col("za") > 0) & (F.col("zb") > 0), 1).when((F.col("za") < 0) & (F.col("zb") < 0), -1).otherwise(0))


def monthly(quarters: DataFrame, months: DataFrame, entity: str = "ticker", time: str = "date", columns: tuple[str, ...] = ()) -> DataFrame:
    """Latest known row per month end; months before the first row take that one."""
    from crosspanel.operators.joins import asof_backward

    grid = quarters.select(entity).distinct().crossJoin(F.broadcast(months))  # every entity has every month
    slow = quarters.select(entity, F.col(time).alias("__q"), *columns)
    found = asof_backward(grid, slow, [entity], months.columns[0], "__q")
    first = Window.partitionBy(entity).orderBy("__q")
    earliest = slow.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(entity, *[F.col(c).alias(f"__{c}") for c in columns])
    out = found.join(earliest, entity)
    return out.select(entity, months.columns[0], *[F.when(F.col("__q").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])
