"""Operators over all entities of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import average_rank, bucket, clip, col, div, first_rank, section, zscore

#: Makes the median absolute deviation a standard deviation for normal data.
MAD = 1.4826


def with_robust_z(df: DataFrame, x: str, by: list[str], out: str | None = None, least: int = 3, limit: float | None = None) -> DataFrame:
    """(x - median) / (1.4826 * MAD); NULL with fewer than ``least`` values or no spread."""
    w = section(*by)
    df = df.withColumn("__m", F.median(x).over(w)).withColumn("__d", F.abs(F.col(x) - F.col("__m")))
    mad = F.when(F.count(x).over(w) >= least, F.median("__d").over(w))
    z = div(F.col(x) - F.col("__m"), F.nullif(mad * MAD, F.lit(0.0)))
    return df.withColumn(out or x, clip(z, -limit, limit) if limit else z).drop("__m", "__d")


def with_group_z(df: DataFrame, x: str, by: list[str], group: str, out: str | None = None) -> DataFrame:
    """z within date and group; groups of fewer than two rows keep their values."""
    w = section(*by, group)
    return df.withColumn(out or x, F.when(F.count(F.lit(1)).over(w) >= 2, zscore(x, w)).otherwise(F.col(x)))


def with_all_z(df: DataFrame, columns: list[str], by: list[str], skip: str = "sector_") -> DataFrame:
    """z of every column by date in one select, without those that start with ``skip``."""
    w = section(*by)
    done = {c: zscore(c, w).alias(c) for c in columns if not c.startswith(skip)}
    return df.select(*[done.get(c, F.col(c)) for c in df.columns])


def winsorised(x: str, p: float, by: list[str]) -> Column:
    """x inside its quantiles p and 1 - p of the date, linearly interpolated."""
    w = section(*by)
    low, high = F.percentile(x, F.lit(p)).over(w), F.percentile(x, F.lit(1 - p)).over(w)
    return F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), high), low))


def z_or_zero(x: str, by: list[str]) -> Column:
    """z by date; 0 where the spread is 0 or undefined."""
    w = section(*by)
    return F.when(F.col(x).isNotNull(), F.coalesce(zscore(x, w), F.lit(0.0)))


def unit_rank(x: str, by: list[str]) -> Column:
    """Average rank scaled to [0, 1]; NULL with fewer than two values."""
    n = F.count(x).over(section(*by))
    return F.when(n >= 2, (average_rank(x, by) - 1) / (n - 1))


def percent_rank(x: str, by: list[str]) -> Column:
    """Average rank over the number of values (not SQL's percent_rank)."""
    return div(average_rank(x, by), F.count(x).over(section(*by)))


def mid_percentile(x: str, by: list[str]) -> Column:
    """100 * (values below + half of the equal ones) / values."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())) - 1
    return F.when(F.col(x).isNotNull(), 100 * (below + 0.5 * ties) / F.count(x).over(section(*by)))


def below_percentile(x: str, by: list[str]) -> Column:
    """100 * values strictly below / values."""
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())) - 1
    return F.when(F.col(x).isNotNull(), 100.0 * below / F.count(x).over(section(*by)))


def band(percentile: str | Column) -> Column:
    p = col(percentile)
    return F.when(p >= 90, "very_high").when(p >= 80, "high").when(p <= 10, "very_low").when(p <= 20, "low").when(p.isNotNull(), "mid")


def quantile(x: str, q: int, by: list[str], tie: str = "ticker") -> Column:
    """Bucket 1..q of the ranks of x, ties in the order of another column."""
    return bucket(first_rank(x, by, tie), F.count(x).over(section(*by)), q)


def value_bucket(x: str, q: int, by: list[str]) -> Column:
    """Bucket of x between its own quantiles; equal quantiles merge, so there may be fewer than q."""
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(i / q) for i in range(q + 1)])).over(section(*by)))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.col(x).isNotNull() & (F.size(edges) > 1), F.size(F.filter(inner, lambda e: F.col(x) > e)) + 1).cast("long")


def cut(x: str, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval; the last label has no upper edge."""
    out = F.when(F.col(x).isNull(), F.lit(None))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(F.col(x) <= edge, label)
    return out.otherwise(labels[-1])


def dispersion(df: DataFrame, x: str, by: list[str], threshold: float = 0.05, least: int = 10) -> DataFrame:
    """By date: standard deviation of x, and the share above a threshold where there are enough values."""
    share = F.avg((F.col(x) > threshold).cast("double"))
    return df.groupBy(*by).agg(F.stddev_samp(x).alias("dispersion"), F.when(F.count(x) >= least, share).alias("breadth"))
