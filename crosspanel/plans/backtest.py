"""Walk-forward evaluation and models.  Features are computed once; each rebalance date sees rows whose labels are already known."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import draw
from crosspanel.functions.storage import kept
from crosspanel.operators.joins import nearest_label
from crosspanel.operators.metrics import ic_weights, information_coefficient, performance
from crosspanel.operators.portfolio import portfolio_return, top_equal


def rebalance_dates(dates: DataFrame, unit: str, time: str = "date", calendar: bool = False) -> DataFrame:
    """Last date of each month or week that the panel has; calendar: only true ends of the period, others vanish."""
    last = dates.select(time).distinct().groupBy(F.date_trunc(unit, time).alias("__p")).agg(F.max(time).alias(time))
    if calendar:
        end = F.last_day(time) if unit == "month" else F.date_add(F.date_trunc(unit, time).cast("date"), 6)
        last = last.filter(F.col(time) == end)
    return last.select(time)


def holding_returns(panel: DataFrame, dates: DataFrame, price: str = "price", entity: str = "ticker", time: str = "date") -> DataFrame:
    """(date, ticker, r): return from each rebalance date to the next one on which the entity has a price."""
    at = panel.join(dates, time, "left_semi")
    return at.select(time, entity, (F.try_divide(F.lead(price).over(Window.partitionBy(entity).orderBy(time)), price) - 1).alias("r"))


def score_backtest(scores: DataFrame, panel: DataFrame, dates: DataFrame, score: str, k: int, time: str = "date", entity: str = "ticker") -> DataFrame:
    """(date, portfolio_return) of the equal-weight best k at each rebalance date."""
    chosen = top_equal(scores.join(dates, time, "left_semi").filter(F.col(score).isNotNull()), score, k, [time], entity)
    returns = holding_returns(panel, dates, time=time, entity=entity).filter("r is not null")
    return portfolio_return(chosen, returns, "r", [time], entity)


def summary(returns: DataFrame, year: int = 12) -> DataFrame:
    return performance(returns.withColumn("all", F.lit("all")), "portfolio_return", ["all"], year=year).drop("all")


def walk_forward(frame: DataFrame, dates: list, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], horizon_rows: int, time: str = "date") -> DataFrame:
    """Scores of each date from a model that saw only rows whose label lies in the past.

    ``frame`` has all features and labels; a row's label is known ``horizon_rows`` dates after its own.  Only the fits loop, over the one
    kept table; ridge regressions of any number of dates need no loop (``one_pass_ridge``).
    """
    index = frame.select(time).distinct().withColumn("__k", F.row_number().over(Window.orderBy(time)))  # a row per date
    indexed = kept(frame.join(F.broadcast(index), time))
    known = {r[time]: r["__k"] for r in indexed.filter(F.col(time).isin(dates)).select(time, "__k").distinct().collect()}
    scored = [fit_predict(indexed.filter(F.col("__k") <= known[d] - horizon_rows).drop("__k"), indexed.filter(F.col("__k") == known[d]).drop("__k")) for d in dates if d in known]
    return reduce(DataFrame.unionByName, scored) if scored else frame.limit(0).withColumn("score", F.lit(None).cast("double"))


def ridge_coefficients(frame: DataFrame, features: list[str], label: str, horizon_rows: int, ridge: float = 1e-3, time: str = "date") -> DataFrame:
    """(date, n, intercept, coefficients): the ridge regression that each date of ``frame`` may use, from the rows whose labels lie
    ``horizon_rows`` dates or more before it.

    Sums of products are taken by date, then accumulated over the dates; so the rows are read once, whatever the number of dates, and
    what the window sees is one row per date.  The penalty is MLlib's: ``ridge`` in units of the label's and the features' deviation.  A
    feature that does not vary has the coefficient 0; without two rows or a label that varies all are 0 and the intercept is the mean
    (NULL without rows).  Rows with a NULL in a feature or the label are not learned from.
    """
    m = len(features)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    known = F.col(label).isNotNull()
    for c in features:
        known &= F.col(c).isNotNull()
    x = [F.when(known, F.col(c).cast("double")) for c in features]
    y = F.when(known, F.col(label).cast("double"))
    terms = [F.when(known, F.lit(1.0)), y, y * y, *x, *[c * y for c in x], *[x[i] * x[j] for i, j in pairs]]
    names = [f"__s{i}" for i in range(len(terms))]
    sums = frame.groupBy(time).agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(n) for t, n in zip(terms, names, strict=True)])
    before = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -horizon_rows)  # a row per date
    moments = sums.select(time, F.array(*[F.coalesce(F.sum(n).over(before), F.lit(0.0)) for n in names]).alias("s"))

    def solve(parts):
        for part in parts:
            out = []
            for s in part["s"]:
                n = s[0]
                if n == 0:
                    out.append((0, None, [0.0] * m))
                    continue
                mean_y, mean = s[1] / n, np.asarray(s[3 : 3 + m]) / n
                cov = np.zeros((m, m))
                for (i, j), v in zip(pairs, s[3 + 2 * m :], strict=True):
                    cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
                with_y, sd = np.asarray(s[3 + m : 3 + 2 * m]) / n - mean * mean_y, max(0.0, s[2] / n - mean_y**2) ** 0.5
                varies = np.diag(cov) > 1e-14 * np.maximum(1.0, mean**2)
                b = np.zeros(m)
                if n > 1 and sd > 0 and varies.any():
                    a = cov[np.ix_(varies, varies)]
                    b[varies] = np.linalg.solve(a + ridge / sd * np.diag(np.diag(a)), with_y[varies])
                out.append((int(n), float(mean_y - b @ mean), b.tolist()))
            found = pd.DataFrame(out, columns=["n", "intercept", "coefficients"])
            found.insert(0, time, part[time].to_numpy())
            yield found

    kind = dict(moments.dtypes)[time]
    return moments.mapInPandas(solve, f"`{time}` {kind}, n long, intercept double, coefficients array<double>")


def one_pass_ridge(frame: DataFrame, dates: DataFrame, features: list[str], label: str, horizon_rows: int, ridge: float = 1e-3, time: str = "date") -> DataFrame:
    """``walk_forward`` with ridge regressions for all dates at once: (columns of frame, score) of the rows of ``dates``, each by the
    model of its own date.  Scoring is one join with a row per date."""
    models = ridge_coefficients(frame, features, label, horizon_rows, ridge, time).join(F.broadcast(dates), time, "left_semi")
    score = F.col("intercept")
    for i, c in enumerate(features):
        score = score + F.col("coefficients")[i] * F.col(c)
    return frame.join(F.broadcast(models), time).withColumn("score", score).drop("n", "intercept", "coefficients")


def gbt_scores(features: list[str], label: str, trees: int = 20, depth: int = 3, seed: int = 42) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """fit_predict with MLlib's gradient-boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    def run(train: DataFrame, now: DataFrame) -> DataFrame:
        assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
        model = GBTRegressor(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, predictionCol="score").fit(assemble.transform(train.dropna(subset=[label])))
        return model.transform(assemble.transform(now)).drop("__x")

    return run


def linear_scores(features: list[str], label: str, ridge: float = 1e-3) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """fit_predict with MLlib's ridge regression: exact, for sanity checks."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    def run(train: DataFrame, now: DataFrame) -> DataFrame:
        assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
        model = LinearRegression(featuresCol="__x", labelCol=label, regParam=ridge, solver="normal", predictionCol="score").fit(assemble.transform(train.dropna(subset=[label])))
        return model.transform(assemble.transform(now)).drop("__x")

    return run


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, share), the largest first."""
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda v: (-v[1], v[0]))


def date_folds(frame: DataFrame, folds: int, time: str = "date") -> DataFrame:
    """Adds ``fold`` 0..folds: blocks of neighbouring dates; fold i is tested on a model of the folds before it."""
    n = Window.partitionBy()
    dates = frame.select(time).distinct().withColumn("__k", F.row_number().over(Window.orderBy(time)) - 1)
    dates = dates.withColumn("fold", F.floor(F.col("__k") * (folds + 1) / F.count(F.lit(1)).over(n))).drop("__k")
    return frame.join(dates, time)


def regime_of(time: str, ranges: list[tuple[str, str, str]]):
    """Label of the half-open calendar range (start, end, label) that holds the date."""
    out = F.lit(None)
    for start, end, label in reversed(ranges):
        out = F.when((F.col(time) >= F.lit(start).cast("date")) & (F.col(time) < F.lit(end).cast("date")), label).otherwise(out)
    return out


def shuffled_labels(frame: DataFrame, label: str, time: str = "date", entity: str = "ticker", seed: int = 42) -> DataFrame:
    """Labels permuted within each date in the order of a seeded digest: a sound model then scores nothing."""
    own = frame.withColumn("__i", F.row_number().over(Window.partitionBy(time).orderBy(entity)))
    other = frame.select(time, F.col(label).alias("__l"), F.row_number().over(Window.partitionBy(time).orderBy(draw(seed, time, entity), entity)).alias("__i"))
    return own.join(other, [time, "__i"]).withColumn(label, F.col("__l")).drop("__l", "__i")


def regime_switch(scores: dict[str, DataFrame], regimes: DataFrame, time: str = "date") -> DataFrame:
    """Of several score tables (date, ticker, score) the one named by the regime known at the date."""
    both = reduce(DataFrame.unionByName, [s.withColumn("regime", F.lit(n)) for n, s in scores.items()])
    return both.join(regimes.select(time, "regime"), [time, "regime"]).drop("regime")


def ensemble(a: DataFrame, b: DataFrame, labels: DataFrame, n: int, floor: float = 0.0, time: str = "date", entity: str = "ticker") -> DataFrame:
    """Scores (date, ticker, score) of two models, weighted by the rolling mean of their information coefficients over the n dates
    before: a date's own coefficient needs returns that are not known yet.  labels: (date, ticker, y)."""
    def coefficients(scores: DataFrame, name: str) -> DataFrame:
        joined = scores.select(time, entity, "score").join(labels, [time, entity])
        return information_coefficient(joined, "score", "y", [time]).select(time, F.col("ic").alias(name))

    ics = coefficients(a, "a").join(coefficients(b, "b"), time)
    known = ics.select(time, *[F.lag(c).over(Window.orderBy(time)).alias(c) for c in "ab"])  # a row per date
    return blended(a, b, ic_weights(known, "a", "b", n, floor, time), time, entity)


def weights_backtest(get_weights: Callable[[object, DataFrame], DataFrame], panel: DataFrame, dates: list, time: str = "date", entity: str = "ticker") -> DataFrame:
    """(date, portfolio_return) of a strategy: get_weights(date, history) gives (ticker, weight) from the rows up to that date."""
    chosen = [get_weights(d, panel.filter(F.col(time) <= F.lit(d))).select(F.lit(d).alias(time), entity, "weight") for d in dates]
    at = panel.sparkSession.createDataFrame([(d,) for d in dates], f"{time} date")
    returns = holding_returns(panel, at, time=time, entity=entity).filter("r is not null")
    return portfolio_return(reduce(DataFrame.unionByName, chosen), returns, "r", [time], entity)


def frozen_scores(frame: DataFrame, end: str, label_end: str, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], time: str = "date") -> DataFrame:
    """Scores of all rows after ``end`` by one model that is fitted once, on rows up to ``label_end`` whose labels are known at ``end``."""
    return fit_predict(frame.filter(F.col(time) <= F.lit(label_end).cast("date")), frame.filter(F.col(time) > F.lit(end).cast("date")))


def split_scores(train: DataFrame, now: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], labels: list[str], fallback: str | None = None, regime: str = "regime", least: int = 2) -> DataFrame:
    """Scores of ``now`` by a model for each regime: rows of a regime with fewer than ``least`` training rows get the fallback's model or
    the nearest regime's in the order of ``labels``."""
    sizes = {r[regime]: r["count"] for r in train.filter(F.col(regime).isin(labels)).groupBy(regime).count().collect()}
    have = {n for n, size in sizes.items() if size >= least}
    parts = [(n, nearest_label(labels, have, n, fallback)) for n in labels]
    return reduce(DataFrame.unionByName, [fit_predict(train.filter(F.col(regime) == use), now.filter(F.col(regime) == n)) for n, use in parts if use is not None])


def suite(strategies: dict[str, DataFrame], periods: DataFrame, r: str = "portfolio_return", time: str = "date", year: int = 12, least: int = 6) -> DataFrame:
    """Metrics of each strategy's returns (date, r) in each named period (name, start, end)."""
    runs = reduce(DataFrame.unionByName, [s.select(time, r).withColumn("strategy", F.lit(n)) for n, s in strategies.items()])
    j = runs.join(F.broadcast(periods), F.col(time).between(F.col("start"), F.col("end")))
    p = performance(j, r, ["strategy", "name"], time, year)
    return p.select("strategy", "name", "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("annual_return", "sharpe", "max_drawdown")])


def best_parameters(frame: DataFrame, grid: list[dict], make: Callable[..., Callable[[DataFrame, DataFrame], DataFrame]], label: str, folds: int = 3, time: str = "date") -> list[tuple[float, dict]]:
    """(mean rank correlation over the folds, parameters), the best first.  Each fold is tested on a model of the folds before it."""
    dealt = date_folds(frame, folds, time).persist()
    out = []
    try:
        for parameters in grid:
            found = []
            for k in range(1, folds + 1):
                scored = make(**parameters)(dealt.filter(F.col("fold") < k), dealt.filter(F.col("fold") == k))
                found.append(information_coefficient(scored, "score", label, [time]).agg(F.avg("ic")).first()[0])
            known = [x for x in found if x is not None]
            out.append((sum(known) / len(known) if known else float("-inf"), parameters))
    finally:
        dealt.unpersist()
    return sorted(out, key=lambda x: -x[0])


def blended(a: DataFrame, b: DataFrame, weights: DataFrame, time: str = "date", entity: str = "ticker") -> DataFrame:
    """Scores of two models mixed by weights (date, weight_a, weight_b)."""
    j = a.select(time, entity, F.col("score").alias("__a")).join(b.select(time, entity, F.col("score").alias("__b")), [time, entity]).join(weights, time)
    return j.select(time, entity, (F.col("weight_a") * F.col("__a") + F.col("weight_b") * F.col("__b")).alias("score"))


def sub_periods(returns: DataFrame, periods: DataFrame, r: str, least: int = 6, time: str = "date", year: int = 12) -> DataFrame:
    """Metrics for each of a few named ranges (name, start, end); NULL for those with fewer than ``least`` rows."""
    j = returns.join(F.broadcast(periods), F.col(time).between(F.col("start"), F.col("end")))
    p = performance(j, r, ["name"], time, year)
    return p.select("name", "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("annual_return", "annual_volatility", "sharpe", "max_drawdown")])
