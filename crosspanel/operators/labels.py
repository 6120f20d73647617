"""Targets and labels.  Labels look ahead by definition; nothing else here does unless it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosspanel.functions.columns import div, last_rows, section, series
from crosspanel.operators.cross_section import unit_rank
from crosspanel.operators.technical import log_return

def forward_return(h: int, price: str = "price", w: WindowSpec | None = None) -> Column:
    """Return over the next h rows."""
    w = w or series()
    return div(F.lead(price, h).over(w), price) - 1


def with_vol_normalised(df: DataFrame, h: int, n: int = 20, price: str = "price", entity: str = "ticker", clip_sigma: float = 3.0, until: Column | None = None, out: str = "target") -> DataFrame:
    """Forward return over its expected spread, clipped at the entity's mean plus and minus three standard deviations.

    The limits come from rows that satisfy ``until``; without it they come from the whole sample, which looks ahead.
    """
    df = df.withColumn("__l", log_return(price))
    frame = last_rows(series(entity), n)
    sigma = F.when(F.count("__l").over(frame) >= max(1, n // 2), F.stddev_samp("__l").over(frame))
    df = df.withColumn("__y", forward_return(h, price) / (sigma * F.sqrt(F.lit(float(h))) + 1e-8))
    own = Window.partitionBy(entity)
    seen = F.col("__y") if until is None else F.when(until, F.col("__y"))
    m, s, k = F.avg(seen).over(own), F.stddev_samp(seen).over(own), F.count(seen).over(own)
    clipped = F.when((k > 10) & (s > 0) & F.col("__y").isNotNull(), F.greatest(F.least(F.col("__y"), m + clip_sigma * s), m - clip_sigma * s)).otherwise(F.col("__y"))
    return df.withColumn(out, clipped).drop("__l", "__y")


def rank_target(y: str, by: list[str] | None = None) -> Column:
    return unit_rank(y, by or ["date"])


def with_orthogonal(df: DataFrame, y: str, market: str, group: str = "sector", by: str = "date", least: int = 3, out: str = "target") -> DataFrame:
    """y less the market's return, then less its group's mean; dates with fewer than ``least`` values keep y."""
    x = F.col(y) - F.col(market)
    w, g = section(by), section(by, group)
    df = df.withColumn("__x", x)
    return df.withColumn(out, F.when(F.count("__x").over(w) >= least, F.col("__x") - F.avg("__x").over(g)).otherwise(F.col(y))).drop("__x")


def targets(df: DataFrame, mode: str, h: int, **options) -> DataFrame:
    """Adds ``target``: raw, rank, vol_norm or ortho (which needs a column ``market``)."""
    if mode == "vol_norm":
        return with_vol_normalised(df, h, **options)
    raw = df.withColumn("target", forward_return(h))
    if mode == "raw":
        return raw
    if mode == "rank":
        return raw.withColumn("target", rank_target("target"))
    if mode == "ortho":
        return with_orthogonal(raw, "target", "market", **options)
    raise ValueError(f"unknown target mode: {mode}")


def excess_labels(df: DataFrame, benchmark: DataFrame, h: int, by: str = "date") -> DataFrame:
    """Forward return less the benchmark's; only dates on which every entity of the date has a label."""
    b = benchmark.select(by, forward_return(h, w=series([], by)).alias("__b"))
    out = df.withColumn("label", forward_return(h)).join(b, by, "left").withColumn("label", F.col("label") - F.col("__b")).drop("__b")
    w = section(by)
    return out.withColumn("__k", F.count("label").over(w) == F.count(F.lit(1)).over(w)).filter("__k").drop("__k")


def training_frame(df: DataFrame, technical: list[str], other: list[str], label: str) -> DataFrame:
    """NULL in other features counts 0; rows without a label or with a NULL technical feature go."""
    return df.fillna(0.0, subset=other).dropna(subset=[*technical, label])


def sample_weights(df: DataFrame, by: str = "date", strength: float = 0.5, out: str = "weight") -> DataFrame:
    """exp(strength * date index / dates), scaled to a mean of 1; later dates weigh more."""
    dates = df.select(by).distinct().withColumn("__i", F.row_number().over(Window.orderBy(by)) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    dates = dates.select(by, F.exp(strength / n * F.col("__i")).alias("__e"))  # a row per date
    joined = df.join(dates, by)
    mean = joined.agg(F.avg("__e").alias("__mean"))
    return joined.crossJoin(F.broadcast(mean)).withColumn(out, F.col("__e") / F.col("__mean")).drop("__e", "__mean")
