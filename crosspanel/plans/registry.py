"""Named queries over the synthetic tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(tables) under ``name``; tables(name) reads a table."""

    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = " ".join(sql.split())
        return fn

    return register


def rounded(df: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """Keys as they are, doubles rounded, for comparison with another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def prices(tables) -> DataFrame:
    """Panel (date, ticker, price, sector): mean line price by week and brand; the sector is the brand's first digit."""
    rows = tables("lineitem").join(tables("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.col("p_brand").alias("ticker")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("price")).withColumn("sector", F.substring("ticker", 7, 1))


PRICES = """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS ticker, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS price,
 substr(p_brand, 7, 1) AS sector FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 4"""


def benchmark(panel: DataFrame) -> DataFrame:
    """(date, price): the mean over all entities."""
    return panel.groupBy("date").agg(F.round(F.avg("price"), 4).alias("price"))


BENCH = "SELECT date, round(avg(price), 4) AS price FROM panel GROUP BY 1"


def over(n: int, part: str = "PARTITION BY ticker ORDER BY date") -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None, part: str = "PARTITION BY ticker ORDER BY date") -> str:
    """SQL of columns.rolling."""
    return f"CASE WHEN count({x}) {over(n, part)} >= {n if least is None else least} THEN {agg}({x}) {over(n, part)} END"
