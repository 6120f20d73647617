"""Stateful and streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, time: str, late: str, size: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Counts and sums by event-time window; works on streams (rows later than ``late`` are dropped) and on tables alike."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums by session: a pause of ``gap`` ends one."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def new_articles(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def append_new(target: str, key: str, time: str | None = None):
    """For foreachBatch: appends rows whose key the Parquet table lacks.  A batch that is replayed adds nothing.

    With ``time`` the table has a folder for each day and a batch is held against the days it has rows of only; a key must keep its day
    then.  Without it the keys of the whole table are read.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if time:
            rows = rows.withColumn("dt", F.col(time).cast("date"))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(rows.schema).parquet(target)
            if time:
                days = [r.dt for r in rows.select("dt").distinct().collect()]  # a batch has few days
                known = known.filter(F.col("dt").isin(days))
            rows = rows.join(known.select(key), key, "left_anti").select(*rows.columns)
        writer = rows.write.mode("append")
        (writer.partitionBy("dt") if time else writer).parquet(target)

    return write


def position_factor(drawdown: str | Column, vol: str | Column, n_returns: str | Column | None = None) -> Column:
    """Cut of a position: .5 for a drawdown below -20 %, .75 below -10 %; times .5 for a yearly volatility above .50, .75 above .35, which
    needs 20 returns at least (``n_returns``; None: enough).  An unknown drawdown or volatility cuts nothing."""
    d, v = (F.col(x) if isinstance(x, str) else x for x in (drawdown, vol))
    enough = F.lit(True) if n_returns is None else (F.col(n_returns) if isinstance(n_returns, str) else n_returns) >= 20
    return F.when(d < -0.2, 0.5).when(d < -0.1, 0.75).otherwise(1.0) * F.when(enough & (v > 0.5), 0.5).when(enough & (v > 0.35), 0.75).otherwise(1.0)


def volatility_scale(vol: str | Column, n_returns: str | Column, target: float = 0.15, lowest: float = 0.25, highest: float = 2.0) -> Column:
    """Exposure that brings a yearly volatility to ``target``, within limits; 1 with fewer than 5 returns or without volatility."""
    v, n = (F.col(x) if isinstance(x, str) else x for x in (vol, n_returns))
    return F.when((n >= 5) & (v > 0), F.greatest(F.lit(lowest), F.least(F.lit(highest), target / v))).otherwise(1.0)


def latest_status(updates: DataFrame, key: str, time: str, status: str, fill: str, price: str) -> DataFrame:
    """Last status of each trade, and slippage: fill less price where it was filled."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(status, fill, price), time).alias("s"))
    return last.select(key, F.col(f"s.{status}").alias(status), (F.col(f"s.{fill}") - F.col(f"s.{price}")).alias("slippage"))


def running_total(events: DataFrame, by: str, value: str, schema: str = "key string, n long, total double") -> DataFrame:
    """Stream: count and sum of each key so far, with the state kept by Spark between the batches."""
    import pandas as pd

    def add(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [str(key[0])], "n": [n], "total": [total]})

    return events.groupBy(by).applyInPandasWithState(add, schema, "n long, total double", "update", "NoTimeout")
