"""Column expressions with one NULL contract: NULL means missing, NaN never gets in, aggregates skip NULL.

A rolling aggregate is NULL until its frame holds enough values; division by zero gives NULL; comparisons with NULL are false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosspanel.functions.storage import kept

#: Trading rows of a year.
YEAR = 252


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def no_nan(x: str | Column) -> Column:
    """NaN to NULL, for the edge where data comes in."""
    return F.when(~F.isnan(col(x)), col(x))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """x inside [low, high]; NULL stays NULL, although greatest() and least() skip it."""
    y = col(x)
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(col(x).isNotNull(), y)


def series(entity: str | list[str] = "ticker", time: str = "date") -> WindowSpec:
    """Rows of an entity in time."""
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(time)


def draw(*parts: Column | str | int) -> Column:
    """The SHA-256 in hexadecimal of the parts as text, joined by bars: a random order or number that any engine can repeat."""
    return F.sha2(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]), 256)


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df dealt to ranges of an order, with the range as ``__p``.

    Spark samples the bounds of the ranges, and two reads of a plan may sample different ones; so the dealt rows are kept (a checkpoint),
    and every later read sees the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def upper_median(x: str) -> Column:
    """The middle value, the greater one of two.  Counted by value, so what is kept grows with the different values only."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{x}` desc)")


def section(*by: str) -> WindowSpec:
    """All rows of a date, or of a date and a group."""
    return Window.partitionBy(*(by or ("date",)))


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(fn: Callable[[Column], Column], x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """fn(x) over the last n rows, NULL unless ``least`` (default n) of them have a value."""
    frame = last_rows(w, n)
    return F.when(F.count(col(x)).over(frame) >= (n if least is None else least), fn(col(x)).over(frame))


def compound(r: str | Column) -> Column:
    """Aggregate: the product of 1 + r."""
    return F.product(1 + col(r))


def average_rank(x: str | Column, by: list[str], ascending: bool = True) -> Column:
    """Rank of x within ``by`` where ties share the mean of their ranks; NULL for NULL.  NULLs sort last and take no rank."""
    order = col(x).asc_nulls_last() if ascending else col(x).desc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, col(x)))
    return F.when(col(x).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2.0)


def first_rank(x: str | Column, by: list[str], tie: str, ascending: bool = True) -> Column:
    """1, 2, ... within ``by`` with ties broken by another column; NULL for NULL."""
    order = col(x).asc_nulls_last() if ascending else col(x).desc_nulls_last()
    return F.when(col(x).isNotNull(), F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)).cast("long"))


def bucket(rank: Column, n: Column, q: int) -> Column:
    """Quantile bucket 1..q of a rank among n: right-closed edges at the quantiles of 1..n."""
    return F.when(n > 1, F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(q) / (n - 1)))).when(n == 1, F.lit(1)).cast("long")


def zscore(x: str | Column, w: WindowSpec, population: bool = False) -> Column:
    sd = F.stddev_pop if population else F.stddev_samp
    return div(col(x) - F.avg(col(x)).over(w), F.nullif(sd(col(x)).over(w), F.lit(0.0)))
