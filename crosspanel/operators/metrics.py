"""Aggregates, performance metrics and evaluation of scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import YEAR, average_rank, div, draw, last_rows, ranged, rolling, series
from crosspanel.operators.cross_section import quantile


def cumulative_return(r: str, by: list[str], time: str = "date") -> Column:
    return F.product(1 + F.col(r)).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)) - 1


def total_return(r: str) -> Column:
    return F.product(1 + F.col(r)) - 1


def annual_return(r: str, year: int = YEAR) -> Column:
    """0 without rows."""
    n = F.count(r)
    return F.when(n > 0, F.pow(F.product(1 + F.col(r)), F.lit(float(year)) / n) - 1).otherwise(0.0)


def annual_volatility(r: str, year: int = YEAR) -> Column:
    """0 with fewer than two rows."""
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * math.sqrt(year)).otherwise(0.0)


def sharpe(r: str, rate: float = 0.0, year: int = YEAR) -> Column:
    return F.coalesce(div(annual_return(r, year) - rate, F.nullif(annual_volatility(r, year), F.lit(0.0))), F.lit(0.0))


def sortino(r: str, rate: float = 0.0, year: int = YEAR) -> Column:
    """Downside deviation over the negative returns; without two of them infinite for a positive excess, else 0."""
    down = F.when(F.col(r) < 0, F.col(r))
    excess = annual_return(r, year) - rate
    sd = F.when(F.count(down) >= 2, F.stddev_samp(down) * math.sqrt(year))
    return F.when(F.coalesce(sd, F.lit(0.0)) > 0, excess / sd).when(excess > 0, float("inf")).otherwise(0.0)


def max_drawdown(df: DataFrame, r: str, by: list[str], time: str = "date") -> DataFrame:
    """(by.., max_drawdown): the worst fall from the running peak of the compounded returns; the peak starts at the first value."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    nav = df.filter(F.col(r).isNotNull()).select(*by, time, F.product(1 + F.col(r)).over(w).alias("__nav"))
    down = nav.withColumn("__d", div("__nav", F.max("__nav").over(w)) - 1)
    return down.groupBy(*by).agg(F.min("__d").alias("max_drawdown"))


def performance(df: DataFrame, r: str, by: list[str], time: str = "date", year: int = YEAR, rate: float = 0.0) -> DataFrame:
    """One row of metrics for each group."""
    pos, neg = F.when(F.col(r) > 0, F.col(r)), F.when(F.col(r) < 0, F.col(r))
    base = df.groupBy(*by).agg(
        total_return(r).alias("total_return"), annual_return(r, year).alias("annual_return"), annual_volatility(r, year).alias("annual_volatility"),
        sharpe(r, rate, year).alias("sharpe"), sortino(r, rate, year).alias("sortino"),
        F.avg((F.col(r) > 0).cast("double")).alias("hit_rate"), div(F.avg(pos), F.abs(F.coalesce(F.avg(neg), F.lit(-1e-10)))).alias("win_loss"), F.count(r).alias("n"),
    )
    dd = max_drawdown(df, r, by, time)
    return base.join(dd, by, "left").withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0))


def information_ratio(df: DataFrame, r: str, b: str, by: list[str], year: int = YEAR) -> DataFrame:
    """Hit rate and information ratio of r against b over the rows that have both."""
    both = df.filter(F.col(r).isNotNull() & F.col(b).isNotNull()).withColumn("__x", F.col(r) - F.col(b))
    return both.groupBy(*by).agg(F.avg((F.col("__x") > 0).cast("double")).alias("hit_rate"), F.coalesce(div(F.avg("__x") * year, F.nullif(F.stddev_samp("__x") * math.sqrt(year), F.lit(0.0))), F.lit(0.0)).alias("information_ratio"))


def information_coefficient(df: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """Spearman correlation by group; pairs with a NULL go before the ranks are taken.  Groups under ``least`` pairs are left out."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*by, average_rank(x, by).alias("__a"), average_rank(y, by).alias("__b"))
    return ranked.groupBy(*by).agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("n")).filter(F.col("n") >= least)


def pooled_coefficient(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """One Spearman correlation over all rows.

    Ranks come from counts of distinct values and a running sum over those counts in ranges, so the rows themselves never meet in one
    task: only one total per range does.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = both.join(global_rank(both, "x", "a"), "x").join(global_rank(both, "y", "b"), "y")
    return ranked.agg(F.when(F.count("*") >= least, F.corr("a", "b")).alias("ic"), F.count("*").alias("n"))


def global_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """(x, average rank): values are dealt to ranges; each range is ranked by itself, on top of the ranges below."""
    counts = df.groupBy(x).agg(F.count("*").alias("__n"))
    dealt = ranged(counts, x)
    below = dealt.groupBy("__p").agg(F.sum("__n").alias("__s"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    below = below.select("__p", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__below"))
    own = Window.partitionBy("__p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(below, "__p").select(x, (F.col("__below") + F.sum("__n").over(own) - (F.col("__n") - 1) / 2.0).alias(out))


def global_row_number(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with its row number in an order over all rows, and their number as ``out``_of: rows are dealt to ranges of the order, each
    is numbered by itself, on top of the ranges below."""
    dealt = ranged(df, *order)
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__p")  # as many rows as ranges
    below = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", below.alias("__below"), F.sum("__n").over(Window.partitionBy()).alias(f"{out}_of"))
    numbered = dealt.withColumn(out, F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return numbered.join(F.broadcast(sizes), "__p").withColumn(out, F.col(out) + F.col("__below")).drop("__p", "__below")


def ic_summary(ics: DataFrame, ic: str = "ic", by: tuple[str, ...] = ()) -> DataFrame:
    return ics.groupBy(*by).agg(F.avg(ic).alias("mean_ic"), F.stddev_samp(ic).alias("std_ic"), div(F.avg(ic), F.nullif(F.stddev_samp(ic), F.lit(0.0))).alias("ic_ir"), F.avg((F.col(ic) > 1e-12).cast("double")).alias("hit_rate"), F.count(ic).alias("n"))


def rolling_ic(ic: str, n: int, by: list[str], time: str = "date") -> Column:
    return F.avg(ic).over(last_rows(Window.partitionBy(*by).orderBy(time), n))


def quantile_returns(df: DataFrame, x: str, y: str, q: int = 5, by: str = "date", tie: str = "ticker") -> DataFrame:
    """(bucket, mean, std, n): mean of y by date and bucket of x, then over the dates."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bucket", quantile(x, q, [by], tie))
    daily = both.groupBy(by, "bucket").agg(F.avg(y).alias("__y"))
    return daily.groupBy("bucket").agg(F.avg("__y").alias("mean"), F.stddev_samp("__y").alias("std"), F.count("*").alias("n"))


def long_short_spread(df: DataFrame, x: str, y: str, q: int = 5, by: str = "date", tie: str = "ticker") -> DataFrame:
    """(date, spread): top bucket's mean less the bottom one's, on dates that have both."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bucket", quantile(x, q, [by], tie))
    top, low = F.avg(F.when(F.col("bucket") == q, F.col(y))), F.avg(F.when(F.col("bucket") == 1, F.col(y)))
    return both.groupBy(by).agg((top - low).alias("spread")).filter("spread is not null")


def importance_by_category(df: DataFrame, name: str, value: str, prefixes: dict[str, str]) -> DataFrame:
    """(category, total, share); the first prefix that fits counts, values of 0 are dropped."""
    category = F.lit(None)
    for prefix, label in reversed(prefixes.items()):
        category = F.when(F.col(name).startswith(prefix), label).otherwise(category)
    sums = df.filter(F.col(value) != 0).groupBy(F.coalesce(category, F.lit("other")).alias("category")).agg(F.sum(value).alias("total"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))  # a handful of categories


def turnover(weights: DataFrame, by: str = "date", entity: str = "ticker", weight: str = "weight") -> DataFrame:
    """(date, turnover): half the absolute changes against the previous date; the first date sums its positive weights.

    Each weight is compared with the same entity's on the previous and the next date, so an exit counts on the date it happens; no grid
    of dates and entities is made.
    """
    order = Window.orderBy(by)  # a row per date
    dates = weights.select(by).distinct().select(by, F.row_number().over(order).alias("__k"), F.lead(by).over(order).alias("__after"))
    w = Window.partitionBy(entity).orderBy("__k")
    own = weights.join(dates, by).select(by, entity, "__k", "__after", F.coalesce(weight, F.lit(0.0)).alias("__w"))
    own = own.withColumn("__p", F.lag(F.struct("__k", "__w")).over(w)).withColumn("__next", F.lead("__k").over(w))
    before = F.when(F.col("__p.__k") == F.col("__k") - 1, F.col("__p.__w")).otherwise(0.0)
    enters = F.when(F.col("__k") == 1, F.greatest("__w", F.lit(0.0))).otherwise(F.abs(F.col("__w") - before) / 2)
    leaves = F.when(F.coalesce(F.col("__next") == F.col("__k") + 1, F.lit(False)), 0.0).otherwise(F.abs("__w") / 2)
    parts = own.select(F.inline(F.array(F.struct(F.col(by).alias(by), enters.alias("__t")), F.struct(F.col("__after").alias(by), leaves.alias("__t")))))
    return parts.filter(F.col(by).isNotNull()).groupBy(by).agg(F.sum("__t").alias("turnover"))


def net_return(r: str, turn: str, bps: float = 10.0) -> Column:
    """Return less costs of both sides of the turnover; no turnover, no cost."""
    return F.col(r) - F.coalesce(F.col(turn), F.lit(0.0)) * (bps / 1e4 * 2)


def ic_weights(ics: DataFrame, a: str, b: str, n: int, floor: float = 0.0, time: str = "date") -> DataFrame:
    """Two weights from rolling mean ICs: negatives count 0, both 0 gives halves, then a floor and renormalising."""
    w = last_rows(Window.orderBy(time), n)
    pa, pb = (F.greatest(F.coalesce(F.avg(c).over(w), F.lit(0.0)), F.lit(0.0)) for c in (a, b))
    out = ics.withColumn("__a", pa).withColumn("__b", pb)
    wa = F.when(F.col("__a") + F.col("__b") > 0, F.col("__a") / (F.col("__a") + F.col("__b"))).otherwise(0.5)
    out = out.withColumn("__w", wa).withColumn("__x", F.greatest("__w", F.lit(floor))).withColumn("__y", F.greatest(1 - F.col("__w"), F.lit(floor)))
    return out.select(time, (F.col("__x") / (F.col("__x") + F.col("__y"))).alias("weight_a"), (F.col("__y") / (F.col("__x") + F.col("__y"))).alias("weight_b"))


def daily_sentiment(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.avg(score).alias("sent_mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sent_std"), F.count(score).alias("sent_count"), F.avg((F.col(score) > 0).cast("double")).alias("share_positive"), F.avg((F.col(score) < 0).cast("double")).alias("share_negative"))


def with_sentiment_features(df: DataFrame, x: str = "sent_mean", n: str = "sent_count", entity: str = "ticker", time: str = "date") -> DataFrame:
    """Moving averages, change over five rows, z-scores and a five-row sum; windows are rows, not days."""
    w = series(entity, time)
    sd, vol = rolling(F.stddev_samp, x, 20, w, 10), rolling(F.stddev_samp, n, 20, w, 5)
    df = df.select("*", rolling(F.avg, x, 5, w, 1).alias("ma5"), rolling(F.avg, x, 20, w, 5).alias("ma20"), (F.col(x) - F.lag(x, 5).over(w)).alias("change5"), F.sum(x).over(last_rows(w, 5)).alias("sum5"), sd.alias("__s"), vol.alias("__v"), rolling(F.avg, x, 20, w, 10).alias("__m"), rolling(F.avg, n, 20, w, 5).alias("__n"))
    return df.withColumn("z20", (F.col(x) - F.col("__m")) / F.greatest("__s", F.lit(0.01))).withColumn("volume_z", (F.col(n) - F.col("__n")) / F.greatest("__v", F.lit(0.1))).drop("__s", "__v", "__m", "__n")


def with_slope(df: DataFrame, x: str, n: int = 20, entity: str = "ticker", time: str = "date", out: str = "slope") -> DataFrame:
    """Least-squares slope of x over the last n rows."""
    w = series(entity, time)
    df = df.withColumn("__i", F.row_number().over(w).cast("double"))
    return df.withColumn(out, F.when(F.count(x).over(last_rows(w, n)) >= n, F.regr_slope(x, "__i").over(last_rows(w, n)))).drop("__i")


def weight_grid(df: DataFrame, a: str, b: str, y: str, steps: int = 10) -> DataFrame:
    """(weight, ic): Pearson correlation of y with w * a + (1 - w) * b for w = 0, 1/steps, .., 1, all in one pass."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    return both.select(a, b, y, F.explode(grid).alias("weight")).groupBy("weight").agg(F.corr(F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b), y).alias("ic"))


def eps_surprise(df: DataFrame, actual: str, estimate: str, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Surprise in percent of the estimate, its bucket, and a running streak: +1 for a beat, -1 for a miss, back to 0 when inline."""
    w = series(entity, time)
    s = F.when(F.abs(estimate) > 0.01, (F.col(actual) - F.col(estimate)) / F.abs(estimate) * 100)
    sign = F.when(s > 0, 1).when(s < 0, -1).otherwise(0)
    df = df.withColumn("surprise", s).withColumn("__g", sign)
    df = df.withColumn("__island", F.sum(F.when(F.col("__g") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("__g").over(Window.partitionBy(entity, "__island").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    bucket = F.when(s.isNull(), None).when(s <= -10, "big_miss").when(s < 0, "miss").when(s == 0, "inline").when(s < 10, "beat").otherwise("big_beat")
    return df.withColumn("bucket", bucket).withColumn("streak", streak).drop("__g", "__island")


def volume_surge(v: str, entity: str = "ticker", time: str = "date", n: int = 20, least: int = 10) -> Column:
    """Value over the mean of the n rows before it, of which ``least`` must exist."""
    frame = series(entity, time).rowsBetween(-n, -1)
    return F.when(F.count(v).over(frame) >= least, div(F.col(v), F.nullif(F.avg(v).over(frame), F.lit(0.0))))


def quarterly_text_features(df: DataFrame, x: str, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Change to the last and the fourth-last row, distance to the four-row mean and the entity's own mean so far, volatility, flips."""
    w = series(entity, time)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("qoq", F.col(x) - F.lag(x).over(w)).withColumn("yoy", F.col(x) - F.lag(x, 4).over(w))
    df = df.withColumn("gap4", F.col(x) - F.avg(x).over(last_rows(w, 4))).withColumn("own_z", F.coalesce(div(F.col(x) - F.avg(x).over(upto), F.nullif(F.stddev_samp(x).over(upto), F.lit(0.0))), F.lit(0.0)))
    flip = F.when(F.signum(x) != F.signum(F.lag(x).over(w)), 1).otherwise(0)
    return df.withColumn("vol4", rolling(F.stddev_samp, x, 4, w, 2)).withColumn("__f", flip).withColumn("flips4", F.sum("__f").over(last_rows(w, 4)).cast("long")).drop("__f")


def t_test(df: DataFrame, x: str, group: str, a: object, b: object) -> DataFrame:
    """(n1, n2, t) of two samples of equal variance; normal_p() turns t into an approximate p."""
    one, two = F.when(F.col(group) == F.lit(a), F.col(x)), F.when(F.col(group) == F.lit(b), F.col(x))
    s = df.agg(F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"), F.count(one).alias("n1"), F.count(two).alias("n2"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return s.select("n1", "n2", div(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"))


def normal_p(t: float) -> float:
    """Two-sided p of a standard normal value."""
    return math.erfc(abs(t) / math.sqrt(2))


def fisher_p(r: float, n: int) -> float:
    """Two-sided p of a correlation r of n pairs, by Fisher's transform; 1 where it is undefined."""
    return normal_p(math.atanh(r) * math.sqrt(n - 3)) if n > 3 and abs(r) < 1 else 1.0


def bootstrap(df: DataFrame, x: str, draws: int = 1000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """(draw, mean): Poisson bootstrap.  Each row's weight in a draw depends on a digest of its ``key`` (default: all columns) and the
    draw, so any partitioning gives the same result, and a draw is a grouped sum that is combined before the shuffle."""
    u = F.conv(F.substring(draw(seed, "draw", *(key or df.columns)), 1, 10), 16, 10).cast("double") / float(1 << 40)
    cumulative, steps, term = 0.0, [], math.exp(-1)
    for k in range(8):
        cumulative += term / math.factorial(k)
        steps.append(cumulative)
    weight = F.lit(8.0)
    for k in reversed(range(8)):
        weight = F.when(u < steps[k], float(k)).otherwise(weight)
    rows = df.filter(F.col(x).isNotNull()).select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return rows.withColumn("__w", weight).groupBy("draw").agg(div(F.sum(F.col("__w") * F.col(x)), F.nullif(F.sum("__w"), F.lit(0.0))).alias("mean"))


def distribution(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Count, mean, median, spread, range, quartiles and shares above 1 and 0."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"), F.avg((F.col(x) > 1).cast("double")).alias("above_1"), F.avg((F.col(x) > 0).cast("double")).alias("above_0"))


def core_features(df: DataFrame, feature: str, value: str, least: float = 0.01, support: int = 2, mean: float = 0.03) -> DataFrame:
    """Features important enough in at least ``support`` periods and on average."""
    s = df.groupBy(feature).agg(F.sum((F.col(value) >= least).cast("long")).alias("support"), F.avg(value).alias("mean"))
    return s.filter((F.col("support") >= support) & (F.col("mean") >= mean))


def realised(df: DataFrame, r: str, signal: str, entity: str = "ticker") -> DataFrame:
    """By signal: count, mean, upper median, hit rate (a fall is a hit for sells), best and worst."""
    hit = F.when(F.col(signal).contains("sell"), F.col(r) < 0).otherwise(F.col(r) > 0)
    rows = df.filter(F.col(r).isNotNull())
    middle = _upper_medians(rows, r, signal)
    s = rows.groupBy(signal).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.avg(hit.cast("double")).alias("hit_rate"),
        F.max_by(entity, F.struct(r, entity)).alias("best"), F.min_by(entity, F.struct(r, entity)).alias("worst"),
    )
    return s.join(middle, signal).select(signal, "n", "mean", "upper_median", "hit_rate", "best", "worst")


def _upper_medians(rows: DataFrame, x: str, by: str) -> DataFrame:
    """(by, upper_median) of few large groups: values are dealt to ranges, and only the range that holds a group's middle is sorted."""
    dealt = ranged(rows.select(by, F.col(x).alias("__x")), by, "__x")
    sizes = dealt.groupBy(by, "__p").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(by).orderBy("__p")  # as many rows as ranges
    below = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.floor(F.sum("__n").over(Window.partitionBy(by)) / 2) + 1
    held = sizes.withColumn("__k", middle - below).filter((F.col("__k") >= 1) & (F.col("__k") <= F.col("__n"))).select(by, "__p", "__k")
    ranked = dealt.join(held, [by, "__p"]).withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("__x")))
    return ranked.filter("__r = __k").select(by, F.col("__x").alias("upper_median"))


def prune_by_coefficient(df: DataFrame, features: list[str], y: str, floor: float = 0.01, share: float = 0.4, keep: int = 4) -> list[str]:
    """Names of the features whose absolute correlation with y reaches max(floor, its quantile), at least ``keep``; one pass, one row."""
    row = df.agg(*[F.corr(f, y).alias(f) for f in features]).first()
    size = sorted(((abs(row[f]) if row[f] is not None and not math.isnan(row[f]) else 0.0, f) for f in features), key=lambda v: (-v[0], v[1]))
    values = sorted(v for v, _ in size)
    at = share * (len(values) - 1)
    limit = max(floor, values[int(at)] + (at - int(at)) * (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]))
    chosen = [f for v, f in size if v >= limit]
    return chosen if len(chosen) >= keep else [f for _, f in size[:keep]]


def quality_report(df: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """(column, nulls, distinct) of each column with the rows and duplicated keys; one pass for the columns."""
    counts = df.agg(F.count("*").alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    wide = counts.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("s")).select("rows", "s.*")
    twice = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    return wide.crossJoin(F.broadcast(twice))  # a single row


def shrunk_ic(n: str, ic: str, prior: float = 0.05, strength: float = 100.0) -> Column:
    """Absolute IC drawn towards a prior, the less so the more periods there are."""
    k = F.col(n) / (F.col(n) + strength)
    return k * F.abs(ic) + (1 - k) * prior
