"""Exposure limits, portfolio risk, attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import YEAR, div, section


def exposures(positions: DataFrame, entity: str = "ticker", weight: str = "weight", sector: str = "sector", industry: str | None = None, beta: str | None = None, factors: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, value): each entity's absolute weight, sums by group, portfolio beta and factor exposures."""
    out = positions.select(F.lit("single_name").alias("kind"), F.col(entity).alias("name"), F.abs(weight).alias("value"))
    for kind, c in (("sector", sector), ("industry", industry)):
        if c:
            out = out.union(positions.groupBy(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("Unknown")).alias("name")).agg(F.sum(F.abs(weight)).alias("value")))
    for kind, c in [("beta", beta), *(("factor", f) for f in factors)]:
        if c:
            out = out.union(positions.agg(F.sum(F.col(weight) * F.col(c)).alias("value")).select(F.lit(kind).alias("kind"), F.lit(c).alias("name"), "value"))
    return out


def violations(exposed: DataFrame, limits: DataFrame) -> DataFrame:
    """Exposures outside the limits (kind, low, high, hard); limits on factors hold for absolute values."""
    value = F.when(F.col("kind") == "factor", F.abs("value")).otherwise(F.col("value"))
    joined = exposed.join(F.broadcast(limits), "kind")  # a handful of limits
    return joined.filter((value > F.col("high")) | (value < F.coalesce("low", F.lit(float("-inf"))))).select("kind", "name", "value", "low", "high", "hard")


def illiquid(positions: DataFrame, adv: str, cap: str, least_adv: float = 1e7, least_cap: float = 2e9) -> DataFrame:
    return positions.filter((F.col(adv) < least_adv) | (F.col(cap) < least_cap))


def after_trades(positions: DataFrame, trades: DataFrame, entity: str = "ticker", weight: str = "weight", sector: str = "sector") -> DataFrame:
    """Positions with the trades' changes of weight added."""
    both = positions.select(entity, sector, weight).union(trades.select(entity, sector, weight))
    return both.groupBy(entity).agg(F.max(sector).alias(sector), F.sum(weight).alias(weight))


def allowed(positions: DataFrame, trades: DataFrame, limits: DataFrame, **columns) -> DataFrame:
    """One row: whether the trades break no hard limit, and how many limits are broken."""
    broken = violations(exposures(after_trades(positions, trades, **columns), **columns), limits)
    return broken.agg((F.count(F.when(F.col("hard"), 1)) == 0).alias("allowed"), F.count("*").alias("violations"))


def portfolio_risk(df: DataFrame, r: str, by: list[str], year: int = YEAR) -> DataFrame:
    """Volatility, value at risk at 95 and 99 % (interpolated percentiles, as losses) and the mean loss beyond 95 %."""
    w = Window.partitionBy(*by)
    df = df.filter(F.col(r).isNotNull()).withColumn("__q", F.percentile(r, F.lit(0.05)).over(w))
    return df.groupBy(*by).agg((F.stddev_samp(r) * F.sqrt(F.lit(float(year)))).alias("volatility"), (-F.percentile(r, F.lit(0.05))).alias("var_95"), (-F.percentile(r, F.lit(0.01))).alias("var_99"), (-F.avg(F.when(F.col(r) <= F.col("__q"), F.col(r)))).alias("cvar_95"))


def factor_exposures(df: DataFrame, r: str, factors: list[str], by: list[str], least: int = 60) -> DataFrame:
    """(by.., factor, beta, t): least squares with an intercept for each group.

    Spark sums the cross products of a group, which are few numbers however long the series; only these reach the solver.
    """
    names = ["intercept", *factors]
    complete = df.dropna(subset=[r, *factors]).withColumn("intercept", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = complete.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(F.col(r) * F.col(r)).alias("__yy"), *[F.sum(F.col(a) * F.col(b)).alias(f"__{a}_{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col(r)).alias(f"__{a}_y") for a in names])

    def solve(batches):
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                n = row["__n"]
                xx = np.array([[row.get(f"__{a}_{b}", row.get(f"__{b}_{a}")) for b in names] for a in names])
                xy = np.array([row[f"__{a}_y"] for a in names])
                if n < max(least, len(names) + 1) or np.linalg.matrix_rank(xx) < len(names):
                    continue
                beta = np.linalg.solve(xx, xy)
                s2 = max(0.0, row["__yy"] - beta @ xy) / (n - len(names))
                se = np.sqrt(s2 * np.diag(np.linalg.inv(xx)))
                out += [{**{k: row[k] for k in by}, "factor": f, "beta": float(b), "t": float(b / s) if s > 0 else None} for f, b, s in zip(names, beta, se, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "factor", "beta", "t"])

    schema = ", ".join([*(f"`{k}` {t}" for k, t in df.select(*by).dtypes), "factor string", "beta double", "t double"])
    return sums.mapInPandas(solve, schema)


def covariances(df: DataFrame, r: str, entity: str = "ticker", time: str = "date", block: int = 512, days: int = 512) -> DataFrame:
    """(a, b, cov) of all pairs of entities over their common dates.

    Entities and dates are dealt to blocks; a task multiplies two blocks of entities over one block of dates, counts of common dates
    among the products, and Spark sums the products by pair of blocks.  What is shuffled is each row once per block of entities, and never
    a row per pair and date.
    """
    rows = df.filter(F.col(r).isNotNull()).groupBy(entity, time).agg(F.avg(F.col(r).cast("double")).alias("x"))
    names = rows.select(entity).distinct().withColumn("e", F.row_number().over(Window.orderBy(entity)) - 1)  # a row per entity
    names = names.withColumn("blocks", F.floor(F.max("e").over(Window.partitionBy()) / block) + 1)
    dates = rows.select(time).distinct().withColumn("t", F.row_number().over(Window.orderBy(time)) - 1)  # a row per date
    cells = rows.join(names, entity).join(dates, time).select("e", "t", "x", F.floor(F.col("e") / block).alias("own"), F.floor(F.col("t") / days).alias("span"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    sides = cells.withColumn("other", other)
    sides = sides.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("i", "j", "span", "own", "e", "t", "x")

    def products(part: pd.DataFrame) -> pd.DataFrame:
        i, j, span = (int(part[c].iloc[0]) for c in ("i", "j", "span"))
        first = int(part["t"].min())
        width = int(part["t"].max()) - first + 1
        x, m = np.zeros((2, block, width)), np.zeros((2, block, width))
        for side, k in enumerate((i, j)):
            own = part[part["own"] == k]
            at = (own["e"].to_numpy() - k * block, own["t"].to_numpy() - first)
            x[side][at], m[side][at] = own["x"].to_numpy(), 1
        parts = [m[0] @ m[1].T, x[0] @ m[1].T, m[0] @ x[1].T, x[0] @ x[1].T]
        a, b = np.nonzero(parts[0])
        return pd.DataFrame({"a": a + i * block, "b": b + j * block, **{c: p[a, b] for c, p in zip(("n", "sa", "sb", "sab"), parts, strict=True)}})

    sums = sides.groupBy("i", "j", "span").applyInPandas(products, "a long, b long, n double, sa double, sb double, sab double")
    sums = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])
    cov = F.when(F.col("n") > 1, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1))
    one = sums.select("a", "b", cov.alias("cov"))
    mirrored = one.filter(F.floor(F.col("a") / block) < F.floor(F.col("b") / block)).select(F.col("b").alias("a"), F.col("a").alias("b"), "cov")
    label = lambda c: names.select(F.col("e").alias(c), F.col(entity).alias(f"__{c}"))
    return one.union(mirrored).join(label("a"), "a").join(label("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), "cov")


def series_contributions(weights: DataFrame, returns: DataFrame, r: str, year: int = YEAR, z: float = 1.645, entity: str = "ticker", time: str = "date", weight: str = "weight") -> DataFrame:
    """``risk_contributions`` without pairs: an entity's marginal risk is its covariance with the portfolio's own returns.

    Only dates on which every position has a return count, so that the portfolio is the same on all of them; on complete data the
    result is that of all pairs.  Work grows with the rows.
    """
    rows = returns.filter(F.col(r).isNotNull()).join(weights.select(entity, F.col(weight).alias("__w")), entity)
    size = weights.select(entity).distinct().agg(F.count("*").alias("__all"))
    own = rows.groupBy(time).agg(F.sum(F.col("__w") * F.col(r)).alias("__p"), F.count_distinct(entity).alias("__k")).join(F.broadcast(size), F.col("__k") == F.col("__all"))
    both = rows.join(own.select(time, "__p"), time)
    line = both.groupBy(entity, F.col("__w").alias(weight)).agg((F.covar_samp(r, "__p") * year).alias("__s"))
    total = F.sqrt(F.sum(F.col(weight) * F.col("__s")).over(Window.partitionBy()))  # one row per position
    out = line.withColumn("__t", total).withColumn("marginal", div("__s", F.nullif(F.col("__t"), F.lit(0.0))))
    contribution = F.col(weight) * F.col("marginal")
    return out.select(entity, weight, "marginal", contribution.alias("contribution"), div(contribution, F.nullif(F.col("__t"), F.lit(0.0))).alias("share"), (contribution * z).alias("component_var"))


def risk_contributions(weights: DataFrame, cov: DataFrame, year: int = YEAR, z: float = 1.645, entity: str = "ticker", weight: str = "weight") -> DataFrame:
    """(entity, weight, marginal, contribution, share, component_var): the contributions sum to the portfolio's volatility."""
    w = weights.select(F.col(entity).alias("a"), F.col(weight).alias("wa"))
    v = weights.select(F.col(entity).alias("b"), F.col(weight).alias("wb"))
    line = cov.join(v, "b").groupBy("a").agg((F.sum(F.col("cov") * F.col("wb")) * year).alias("__s"))
    out = w.join(line, "a")
    total = F.sqrt(F.sum(F.col("wa") * F.col("__s")).over(Window.partitionBy()))  # one row per position
    out = out.withColumn("__t", total).withColumn("marginal", div("__s", F.nullif(F.col("__t"), F.lit(0.0))))
    contribution = F.col("wa") * F.col("marginal")
    return out.select(F.col("a").alias(entity), F.col("wa").alias(weight), "marginal", contribution.alias("contribution"), div(contribution, F.nullif(F.col("__t"), F.lit(0.0))).alias("share"), (contribution * z).alias("component_var"))


def decomposition(betas: DataFrame, factor_cov: DataFrame, total_variance: Column) -> DataFrame:
    """One row: systematic and idiosyncratic volatility from betas (factor, beta) and the factors' covariances (a, b, cov)."""
    x = betas.select(F.col("factor").alias("a"), F.col("beta").alias("__a"))
    y = betas.select(F.col("factor").alias("b"), F.col("beta").alias("__b"))
    system = factor_cov.join(x, "a").join(y, "b").agg(F.sum(F.col("__a") * F.col("__b") * F.col("cov")).alias("s"))
    return system.select(F.sqrt(F.greatest("s", F.lit(0.0))).alias("systematic"), F.sqrt(F.greatest(total_variance - F.col("s"), F.lit(0.0))).alias("idiosyncratic"))


def brinson(portfolio: DataFrame, bench: DataFrame, by: list[str], group: str = "sector", weight: str = "weight", r: str = "r") -> DataFrame:
    """(by.., group, allocation, selection, interaction): sums over the groups equal the active return.

    A group's return is its weighted mean; a side without the group has weight and return 0.
    """
    def grouped(df: DataFrame, side: str) -> DataFrame:
        w, x = F.sum(weight), F.sum(F.col(weight) * F.col(r))
        return df.groupBy(*by, group).agg(w.alias(f"w{side}"), F.coalesce(div(x, F.nullif(w, F.lit(0.0))), F.lit(0.0)).alias(f"r{side}"))

    both = grouped(portfolio, "p").join(grouped(bench, "b"), [*by, group], "full").fillna(0.0, subset=["wp", "rp", "wb", "rb"])
    whole = F.sum(F.col("wb") * F.col("rb")).over(section(*by))
    return both.withColumn("__b", whole).select(*by, group, ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("__b"))).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"))


def linked_effect(df: DataFrame, effect: str, r: str, time: str = "date") -> DataFrame:
    """Effects of periods carried forward by the compounded return of the later ones, and summed."""
    w = Window.orderBy(time).rowsBetween(1, Window.unboundedFollowing)  # a row per period
    later = F.coalesce(F.product(1 + F.col(r)).over(w), F.lit(1.0))
    return df.select(time, (F.col(effect) * later).alias("linked"))


def attribution_periods(dates: DataFrame, unit: str, time: str = "date") -> DataFrame:
    """(period, start, end, n): first and last date of each day, week, month or quarter that has two dates or more."""
    return dates.select(time).distinct().groupBy(F.date_trunc(unit, time).cast("date").alias("period")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).filter("n >= 2")


def budget(contributions: DataFrame, budgets: DataFrame, group: str = "sector") -> DataFrame:
    """(group, share, budget, over): share of the absolute contributions against a budget."""
    s = contributions.groupBy(group).agg(F.sum(F.abs("contribution")).alias("__c"))
    s = s.withColumn("share", div("__c", F.nullif(F.sum("__c").over(Window.partitionBy()), F.lit(0.0)))).drop("__c")
    return s.join(budgets, group, "left").select(group, "share", "budget", F.coalesce(F.col("share") > F.col("budget"), F.lit(False)).alias("over"))


def ex_ante_ex_post(weights: DataFrame, returns: DataFrame, r: str, year: int = YEAR, entity: str = "ticker", time: str = "date") -> DataFrame:
    """One row: volatility expected without correlations, realised volatility and their ratio."""
    vol = returns.groupBy(entity).agg(F.var_samp(r).alias("__v"))
    ante = weights.join(vol, entity).agg(F.sqrt(F.sum(F.pow("weight", F.lit(2.0)) * F.col("__v")) * year).alias("ex_ante"))
    series = returns.join(weights, entity).groupBy(time).agg(F.sum(F.col("weight") * F.col(r)).alias("__p"))
    post = series.agg((F.stddev_samp("__p") * F.sqrt(F.lit(float(year)))).alias("ex_post"))
    return ante.crossJoin(post).withColumn("ratio", div("ex_post", F.nullif(F.col("ex_ante"), F.lit(0.0))))  # a row each
