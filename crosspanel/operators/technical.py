"""Row-ordered features of a long price panel (entity, date, price).

All functions add columns and keep the rows.  They share one window by entity and date, so a chain of them costs one exchange and one
sort.  Gaps are skipped rows, not calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from crosspanel.functions.columns import YEAR, compound, div, last_rows, rolling, series

def simple_return(price: str = "price", w: WindowSpec | None = None, n: int = 1) -> Column:
    w = w or series()
    return div(price, F.lag(price, n).over(w)) - 1


def log_return(price: str = "price", w: WindowSpec | None = None) -> Column:
    w = w or series()
    return F.log(div(price, F.lag(price).over(w)))


def momentum(r: str, n: int, skip: int = 0, w: WindowSpec | None = None) -> Column:
    """Compound return of the last n rows without the most recent ``skip``; needs n returns."""
    w = w or series()
    return F.when(F.count(r).over(last_rows(w, n)) >= n, compound(r).over(w.rowsBetween(-(n - 1), -skip)) - 1)


def momentum_sum(r: str, n: int, w: WindowSpec | None = None) -> Column:
    w = w or series()
    return rolling(F.sum, r, n, w)


def volatility(r: str, n: int, w: WindowSpec | None = None, year: int = YEAR, least: int | None = None) -> Column:
    w = w or series()
    return rolling(F.stddev_samp, r, n, w, least) * F.sqrt(F.lit(float(year)))


def rolling_sharpe(r: str, n: int, rate: float = 0.0, w: WindowSpec | None = None, year: int = YEAR) -> Column:
    w = w or series()
    mean = rolling(F.avg, r, n, w) - rate / year
    return div(mean * year, F.nullif(volatility(r, n, w, year), F.lit(0.0)))


def with_max_drawdown(df: DataFrame, n: int, price: str = "price", out: str = "max_drawdown", w: WindowSpec | None = None) -> DataFrame:
    """Least drawdown from the rolling peak (from the first row on) over a full window of n rows."""
    w = w or series()
    down = div(price, F.max(price).over(last_rows(w, n))) - 1
    return df.withColumn("__d", down).withColumn(out, rolling(F.min, "__d", n, w)).drop("__d")


def with_rsi(df: DataFrame, n: int = 14, price: str = "price", out: str = "rsi_14", w: WindowSpec | None = None) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss); the first row counts as no change, and no loss gives NULL."""
    w = w or series()
    step = F.col(price) - F.lag(price).over(w)
    gain, loss = F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("__g", F.when(step.isNull(), 0.0).otherwise(gain)).withColumn("__l", F.when(step.isNull(), 0.0).otherwise(loss))
    ratio = div(rolling(F.avg, "__g", n, w), F.nullif(rolling(F.avg, "__l", n, w), F.lit(0.0)))
    return df.withColumn(out, 100 - div(F.lit(100.0), 1 + ratio)).drop("__g", "__l")


def average_ratio(price: str = "price", short: int = 20, long: int = 50, w: WindowSpec | None = None, least_short: int | None = None, least_long: int | None = None) -> Column:
    w = w or series()
    if short >= long:
        raise ValueError("the short window must be shorter than the long one")
    return div(rolling(F.avg, price, short, w, least_short), rolling(F.avg, price, long, w, least_long))


def trend_health(price: str = "price", short: int = 63, long: int = 252, w: WindowSpec | None = None) -> Column:
    w = w or series()
    return average_ratio(price, short, long, w, short // 2, long // 2) - 1


def with_technical(df: DataFrame, moms: tuple[int, ...] = (21, 63, 126, 252), vols: tuple[int, ...] = (21, 63), w: WindowSpec | None = None) -> DataFrame:
    """Returns, momentum, volatility, RSI and the moving-average ratio."""
    w = w or series()
    df = df.withColumn("r", simple_return(w=w))
    df = df.select("*", *[momentum_sum("r", n, w).alias(f"mom_{n}") for n in moms], *[volatility("r", n, w).alias(f"vol_{n}") for n in vols], average_ratio(w=w).alias("ma_ratio_20_50"))
    return with_rsi(df, w=w)


def with_benchmark(df: DataFrame, benchmark: DataFrame, time: str = "date") -> DataFrame:
    """Adds the benchmark's columns by date: it has a row per date, so Spark broadcasts it while that is small."""
    return df.join(benchmark, time, "left")


def beta(r: str, rb: str, n: int = 60, w: WindowSpec | None = None) -> Column:
    """Covariance with the benchmark over its variance, from max(n // 2, 20) pairs on."""
    w = w or series()
    least = min(n, max(n // 2, 20))
    frame = last_rows(w, n)
    both = F.when(F.col(r).isNotNull() & F.col(rb).isNotNull(), F.lit(1))
    cov = F.when(F.count(both).over(frame) >= least, F.covar_samp(r, rb).over(frame))
    var = F.when(F.count(rb).over(frame) >= least, F.var_samp(rb).over(frame))
    return div(cov, F.nullif(var, F.lit(0.0)))


def with_residuals(df: DataFrame, n: int = 60, r: str = "r", rb: str = "rb", w: WindowSpec | None = None) -> DataFrame:
    """beta and the residual r - beta * rb."""
    w = w or series()
    return df.withColumn("beta", beta(r, rb, n, w)).withColumn("resid", F.col(r) - F.col("beta") * F.col(rb))


def deviation(x: str, n: int, w: WindowSpec | None = None) -> Column:
    """Median absolute deviation over a full window of n values.  The window's values are an array of at most n."""
    w = w or series()
    values = F.collect_list(x).over(last_rows(w, n))

    def median(a: Column) -> Column:
        s = F.array_sort(a)
        return (F.element_at(s, F.lit((n + 1) // 2)) + F.element_at(s, F.lit(n // 2 + 1))) / 2.0

    # The window's median is an element of an array of one, so it is computed once and not for each value.
    middle = F.array(median(values))
    spread = F.element_at(F.transform(middle, lambda m: median(F.transform(values, lambda v: F.abs(v - m)))), 1)
    return F.when(F.size(values) == n, spread)


def regime(bench: DataFrame, n: int = 21, trend: int = 200, threshold: float | None = None, price: str = "price", time: str = "date") -> DataFrame:
    """(time, vol, trend_up, regime) of one series: MOMENTUM where volatility is under the threshold and the price above its average,
    else QUALITY.  Without a threshold the median of the whole sample is taken, which looks ahead; pass one fitted on the past."""
    w = series([], time)
    out = bench.withColumn("r", simple_return(price, w)).withColumn("vol", volatility("r", n, w)).withColumn("trend_up", F.coalesce(F.col(price) > rolling(F.avg, price, trend, w), F.lit(False)))
    limit = F.lit(threshold) if threshold is not None else F.median("vol").over(section_all())
    return out.withColumn("regime", F.when(F.coalesce(F.col("vol") < limit, F.lit(False)) & F.col("trend_up"), "MOMENTUM").otherwise("QUALITY")).drop("r")


def section_all() -> WindowSpec:
    """One window over a series that has a row per date."""
    from pyspark.sql import Window

    return Window.partitionBy()


def relative_strength(df: DataFrame, benchmark: DataFrame, spans: tuple[int, int, int] = (21, 63, 126), weights: tuple[float, float, float] = (0.3, 0.5, 0.2), w: WindowSpec | None = None) -> DataFrame:
    """Latest row of each entity: returns over three spans, the first relative to the benchmark, and their weighted sum.

    Entities without the longest span share its weight between the other two.
    """
    w = w or series()
    own = df.select("*", *[simple_return(w=w, n=n).alias(f"r{n}") for n in spans], F.row_number().over(w.orderBy(F.desc("date"))).alias("__n")).filter("__n = 1").drop("__n")
    bw = series([], "date")
    b = benchmark.select("date", simple_return("price", bw, spans[0]).alias("__b"))
    a, m, z = (F.col(f"r{n}") for n in spans)
    short = a - F.coalesce(F.col("__b"), F.lit(0.0))
    score = F.when(z.isNotNull(), weights[0] * short + weights[1] * m + weights[2] * z).otherwise((weights[0] * short + weights[1] * m) / (weights[0] + weights[1]))
    return own.join(b, "date", "left").select("*", short.alias("relative"), score.alias("strength")).drop("__b")


def volatility_scale(r: str, target: float = 0.15, n: int = 20, low: float = 0.25, high: float = 2.0, w: WindowSpec | None = None) -> Column:
    """Target over realised volatility of the last n rows inside [low, high]; 1 with fewer than five values."""
    w = w or series()
    frame = last_rows(w, n)
    sd = F.stddev_samp(r).over(frame) * F.sqrt(F.lit(float(YEAR)))
    return F.when(F.count(r).over(frame) < 5, 1.0).otherwise(F.coalesce(F.greatest(F.least(div(F.lit(target), F.nullif(sd, F.lit(0.0))), F.lit(high)), F.lit(low)), F.lit(1.0)))


def with_enhanced(
    df: DataFrame, benchmark: DataFrame | None = None, reversals: tuple[int, ...] = (5, 10), residual: tuple[int, ...] = (63,), idio: tuple[int, ...] = (63,),
    beta_rows: int = 60, mad: int = 21, trend: tuple[int, int] = (63, 252), sectors: list[str] | None = None, price: str = "price", w: WindowSpec | None = None,
) -> tuple[DataFrame, list[str]]:
    """df with all enhanced features, and their names: short reversals, residual momentum and volatility against a benchmark (date, rb),
    median deviations of returns and of volatility, trend health, and a 0/1 column for each sector.

    Without a benchmark the residual features are left out.  The window is one exchange and one sort for all of them.
    """
    w = w or series()
    df = df.withColumn("r", simple_return(price, w))
    df = df.withColumn("__v", volatility("r", 21, w))
    names = {f"rev_{n}": simple_return(price, w, n) for n in reversals} | {f"mad_ret_{mad}": deviation("r", mad, w), f"mad_vol_{mad}": deviation("__v", mad, w)}
    names |= {f"trend_{trend[0]}_{trend[1]}": trend_health(price, *trend, w)} | {f"sector_{x}": (F.col("sector") == x).cast("double") for x in sectors or []}
    df = df.select("*", *[c.alias(n) for n, c in names.items()])
    if benchmark is not None:
        df = with_residuals(with_benchmark(df, benchmark), beta_rows, w=w)
        more = {f"resid_mom_{n}": momentum_sum("resid", n, w) for n in residual} | {f"idio_vol_{n}": volatility("resid", n, w) for n in idio}
        df, names = df.select("*", *[c.alias(n) for n, c in more.items()]), names | more
    return df.drop("__v"), list(names)


def sector_rotation(df: DataFrame, benchmark: DataFrame, spans: tuple[int, int] = (21, 63), weights: tuple[float, float] = (0.4, 0.6), limit: float = 0.03, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Latest row of each sector index: strength against the benchmark over two spans of rows, their weighted sum as momentum, a signal
    beyond the limit, and the rank by momentum (ties by name).  There are as many rows as sectors."""
    w, bw = series(entity, time), series([], time)
    last = df.select("*", *[simple_return(w=w, n=n).alias(f"__r{i}") for i, n in enumerate(spans)], F.row_number().over(w.orderBy(F.desc(time))).alias("__n")).filter("__n = 1")
    b = benchmark.select(time, *[simple_return("price", bw, n).alias(f"__b{i}") for i, n in enumerate(spans)])
    out = last.join(b, time, "left").select(entity, time, *[(F.col(f"__r{i}") - F.coalesce(f"__b{i}", F.lit(0.0))).alias(f"rs_{n}") for i, n in enumerate(spans)])
    out = out.withColumn("momentum", weights[0] * F.col(f"rs_{spans[0]}") + weights[1] * F.col(f"rs_{spans[1]}"))
    signal = F.when(F.col("momentum") > limit, "overweight").when(F.col("momentum") < -limit, "underweight").otherwise("neutral")
    from pyspark.sql import Window

    return out.withColumn("signal", signal).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("momentum"), entity)).cast("long"))
