"""Weights from scores, constraints and portfolio returns over (date, ticker, ..) rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import clip, div, draw, first_rank, section, zscore

DAY = ["date"]


def normalised(weight: str | Column, by: list[str] = DAY) -> Column:
    """Weights that sum to 1 by date."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return div(w, F.nullif(F.sum(w).over(section(*by)), F.lit(0.0)))


def top(df: DataFrame, score: str, k: int, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """The k best rows of each date, ties by entity; all rows where there are fewer.  k must be positive."""
    if k <= 0:
        raise ValueError("k must be positive")
    best = Window.partitionBy(*by).orderBy(F.desc(score), entity)
    return df.filter(F.col(score).isNotNull()).withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= k)


def top_equal(df: DataFrame, score: str, k: int, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    return top(df, score, k, by, entity).select(*by, entity, (1.0 / F.count(F.lit(1)).over(section(*by))).alias("weight"))


def score_weighted(df: DataFrame, score: str, k: int, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """Weights in proportion to the scores of the best k, shifted above zero."""
    t = top(df, score, k, by, entity)
    shifted = F.col(score) - F.least(F.min(score).over(section(*by)), F.lit(0.0)) + 1e-6
    return t.withColumn("__s", shifted).select(*by, entity, normalised("__s", by).alias("weight"))


def rank_weighted(df: DataFrame, score: str, k: int, tau: float = 5.0, by: list[str] = DAY, entity: str = "ticker", keep: tuple[str, ...] = ()) -> DataFrame:
    """Weights exp(-rank / tau), best rank 0."""
    t = top(df, score, k, by, entity).withColumn("__s", F.exp(-(F.col("__k") - 1) / tau))
    return t.select(*by, entity, *keep, normalised("__s", by).alias("weight"))


def sector_neutral(df: DataFrame, score: str, k: int, sector: str = "sector", least: int = 1, most: int = 3, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """Each sector gets ``least`` places, then its rounded-down share of the rest within ``most``; places left over go one by one to the
    sectors whose next entity has the best z-score.  The total can exceed k when the minima do, and fall short after one round."""
    g = section(*by, sector)
    df = df.filter(F.col(score).isNotNull()).withColumn("__z", F.coalesce(zscore(score, g), F.lit(0.0)))
    df = df.withColumn("__k", F.row_number().over(Window.partitionBy(*by, sector).orderBy(F.desc("__z"), entity))).withColumn("__n", F.count(F.lit(1)).over(g)).withColumn("__all", F.count(F.lit(1)).over(section(*by)))
    sectors = F.size(F.collect_set(sector).over(section(*by)))
    base = F.least(F.lit(least), F.col("__n"))
    share = F.floor(F.greatest(F.lit(k) - sectors * least, F.lit(0)) * F.col("__n") / F.col("__all"))
    df = df.withColumn("__slots", F.least(base + share, F.lit(most), F.col("__n")))
    taken = F.sum((F.col("__k") <= F.col("__slots")).cast("int")).over(section(*by))
    df = df.withColumn("__left", F.lit(k) - taken).withColumn("__next", (F.col("__k") == F.col("__slots") + 1) & (F.col("__slots") < most))
    extra = F.row_number().over(Window.partitionBy(*by, "__next").orderBy(F.desc("__z"), entity))
    df = df.withColumn("__x", extra).filter((F.col("__k") <= F.col("__slots")) | (F.col("__next") & (F.col("__x") <= F.col("__left"))))
    return df.select(*by, entity, sector, (1.0 / F.count(F.lit(1)).over(section(*by))).alias("weight"))


def inverse_volatility(df: DataFrame, vol: str = "vol", weight: str = "weight", floor: float = 0.01, default: float = 0.25, by: list[str] = DAY) -> DataFrame:
    """weight / volatility; a missing volatility takes the date's median, else the default."""
    v = F.greatest(F.coalesce(F.col(vol), F.median(vol).over(section(*by)), F.lit(default)), F.lit(floor))
    return df.withColumn("__w", F.col(weight) / v).withColumn(weight, normalised("__w", by)).drop("__w")


def beta_tilt(df: DataFrame, beta: str = "beta", weight: str = "weight", low: float = 0.8, high: float = 1.0, by: list[str] = DAY) -> DataFrame:
    """A portfolio beta above ``high`` favours low betas, one below ``low`` high ones; factors stay in [0.5, 1.5]."""
    total = F.sum(F.col(weight) * F.coalesce(F.col(beta), F.lit(1.0))).over(section(*by))
    b = F.coalesce(F.col(beta), F.lit(1.0))
    df = df.withColumn("__b", total).withColumn("__w", F.col(weight) * F.when(F.col("__b") > high, clip(2 - b, 0.5, 1.5)).when(F.col("__b") < low, clip(b, 0.5, 1.5)).otherwise(1.0))
    return df.withColumn(weight, normalised("__w", by)).drop("__b", "__w")


def sector_cap(df: DataFrame, cap: float, sector: str = "sector", weight: str = "weight", by: list[str] = DAY) -> DataFrame:
    """Sectors above the cap are scaled to it, then everything to a sum of 1."""
    total = F.sum(weight).over(section(*by, sector))
    df = df.withColumn("__t", total).withColumn("__w", F.when(F.col("__t") > cap, F.col(weight) * cap / F.col("__t")).otherwise(F.col(weight)))
    return df.withColumn(weight, normalised("__w", by)).drop("__t", "__w")


def position_cap(df: DataFrame, cap: float, weight: str = "weight", rounds: int = 10, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """Up to ``rounds`` times: clip at the cap and hand the excess to the rest in proportion.

    The weights of a date are folded as one array, so all rounds cost a single exchange.  With fewer than 1 / cap entities the cap
    can't hold and the last clip stands.
    """
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(entity, F.col(weight).cast("double").alias("w")))).alias("__a"))

    def once(a: Column, _: Column) -> Column:
        excess = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(x["w"] - cap, F.lit(0.0)))
        room = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x["w"] < cap, x["w"]).otherwise(0.0))
        return F.transform(a, lambda x: F.struct(x[entity].alias(entity), F.when(x["w"] >= cap, F.lit(cap)).otherwise(x["w"] + F.coalesce(F.try_divide(excess * x["w"], room), F.lit(0.0))).alias("w")))

    capped = rows.select(*by, F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("__a"), once))).withColumnRenamed("w", weight)
    return df.drop(weight).join(capped, [*by, entity])


def clip_weights(df: DataFrame, low: float, high: float, weight: str = "weight", by: list[str] = DAY) -> DataFrame:
    return df.withColumn("__w", clip(weight, low, high)).withColumn(weight, normalised("__w", by)).drop("__w")


def long_short(df: DataFrame, score: str, k: int, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """Half in the best k, minus half in the worst k."""
    long = top_equal(df, score, k, by, entity).withColumn("weight", F.col("weight") / 2)
    short = top_equal(df.withColumn("__neg", -F.col(score)), "__neg", k, by, entity).withColumn("weight", -F.col("weight") / 2)
    return long.union(short).groupBy(*by, entity).agg(F.sum("weight").alias("weight"))


def portfolio_return(weights: DataFrame, returns: DataFrame, r: str, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """Sum of weight * return by date; missing returns are skipped."""
    return weights.join(returns.select(*by, entity, F.col(r).alias("__r")), [*by, entity]).groupBy(*by).agg(F.sum(F.col("weight") * F.col("__r")).alias("portfolio_return"))


def risk_stats(df: DataFrame, weight: str = "weight", vol: str = "vol", beta: str = "beta", sector: str = "sector", by: list[str] = DAY) -> DataFrame:
    """Number, greatest weight, weight of the best three and ten, concentration, mean volatility, beta, sectors."""
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(weight), vol)))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(weight).alias("max_weight"), F.sum(F.when(F.col("__k") <= 3, F.col(weight))).alias("top3"), F.sum(F.when(F.col("__k") <= 10, F.col(weight))).alias("top10"),
        F.sum(F.col(weight) * F.col(weight)).alias("hhi"), F.avg(vol).alias("mean_vol"), F.sum(F.col(weight) * F.col(beta)).alias("beta"), F.count_distinct(sector).alias("sectors"),
    )


def sized(returns: DataFrame, signals: DataFrame, method: str, r: str = "r", entity: str = "ticker", fraction: float = 0.5, target: float = 0.15, year: int = 252, least: int = 30) -> DataFrame:
    """(ticker, weight) from each entity's return statistics: equal, kelly, fractional_kelly, vol_target, inverse_variance, inverse_vol.

    Kelly is mean / variance * signal inside [0, 1] for entities with enough returns, scaled down when the sum exceeds 1.
    """
    stats = returns.filter(F.col(r).isNotNull()).groupBy(entity).agg(F.avg(r).alias("__m"), F.var_samp(r).alias("__v"), F.count(r).alias("__n"))
    df = signals.join(stats, entity, "left")
    ok = (F.coalesce("__n", F.lit(0)) >= least) & (F.coalesce("__v", F.lit(0.0)) > 0)
    everything = Window.partitionBy()  # one row per entity
    if method == "equal":
        return df.select(entity, (F.lit(1.0) / F.count(F.lit(1)).over(everything)).alias("weight"))
    if method in ("kelly", "fractional_kelly"):
        share = fraction if method == "fractional_kelly" else 1.0
        raw = F.when(ok, clip(F.col("__m") / F.col("__v") * F.col("signal"), 0.0, 1.0) * share).otherwise(0.0)
    elif method == "vol_target":
        n = F.count(F.lit(1)).over(everything)
        raw = F.when(ok, F.least(target / F.sqrt(F.col("__v") * year), F.lit(2.0)) / n).otherwise(0.0)
    elif method in ("inverse_variance", "inverse_vol"):
        inverse = F.when(ok, 1 / (F.col("__v") if method == "inverse_variance" else F.sqrt("__v"))).otherwise(0.0)
        df = df.withColumn("__i", inverse)
        return df.select(entity, F.coalesce(div("__i", F.nullif(F.sum("__i").over(everything), F.lit(0.0))), F.lit(0.0)).alias("weight"))
    else:
        raise ValueError(f"unknown method: {method}")
    df = df.withColumn("__w", raw).withColumn("__s", F.sum("__w").over(everything))
    return df.select(entity, F.when(F.col("__s") > 1, F.col("__w") / F.col("__s")).otherwise(F.col("__w")).alias("weight"))


def constrained(df: DataFrame, capital: float, most: float = 0.1, least: float = 0.01, sector_most: float = 0.3, sector: str = "sector", weight: str = "weight", price: str = "price") -> DataFrame:
    """Caps each weight, drops small ones, scales sectors down, and gives whole shares."""
    df = df.withColumn("__w", F.least(F.col(weight), F.lit(most))).withColumn("__w", F.when(F.col("__w") < least, 0.0).otherwise(F.col("__w")))
    df = df.withColumn("__s", F.sum("__w").over(Window.partitionBy(sector)))
    df = df.withColumn(weight, F.when(F.col("__s") > sector_most, F.col("__w") * sector_most / F.col("__s")).otherwise(F.col("__w")))
    return df.withColumn("shares", F.floor(F.col(weight) * capital / F.col(price))).drop("__w", "__s")


def equal_weight(df: DataFrame, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    return df.select(*by, entity, (1.0 / F.count(F.lit(1)).over(section(*by))).alias("weight"))


def random_paths(df: DataFrame, k: int, paths: int, seed: int = 42, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    """Equal weights on k entities drawn for each path and date; the draw is a digest of seed, path, date and entity, so it repeats."""
    rows = df.select(*by, entity).withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    return top_equal(rows.withColumn("__h", draw(seed, "path", *by, entity)), "__h", k, ["path", *by], entity)


def tau_half(half: float) -> float:
    """tau of rank weights that halve every ``half`` ranks."""
    return half / math.log(2)


def ranked(df: DataFrame, score: str, by: list[str] = DAY, entity: str = "ticker") -> DataFrame:
    return df.withColumn("rank", first_rank(score, by, entity, ascending=False))
