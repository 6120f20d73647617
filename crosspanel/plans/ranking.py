"""Learning to rank a cross-section: boosted trees on LambdaRank gradients.

A date is a group.  Gradients come from its pairs of entities, weighed by what exchanging the two would change in NDCG.  Each level of a
tree is one Spark job: tasks add up the gradients of their dates by node, feature and bin, Spark sums these histograms, and the driver
picks the splits from (nodes x features x bins) numbers.  Scores are a Spark expression of the trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.storage import kept

#: Rows of a group that are held against all others at a time.
BLOCK = 512


def pair_gradients(score: np.ndarray, relevance: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, hessian) of each entity of one group whose rows stand in the order of their entities, which breaks ties of scores.

    A pair of different relevance pulls the more relevant one up by sigma / (1 + exp(sigma (s_i - s_j))), times the change in NDCG.
    """
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    gain = 2.0**relevance
    rank = np.empty(n)
    rank[np.lexsort((np.arange(n), -score))] = np.arange(1, n + 1)
    ideal = ((np.sort(gain)[::-1] - 1) / np.log2(np.arange(2, n + 2))).sum()
    if ideal <= 0:
        return g, h
    discount = 1 / np.log2(1 + rank)
    for i in range(0, n, BLOCK):
        own = slice(i, min(n, i + BLOCK))
        better = relevance[own, None] > relevance[None, :]
        rho = np.where(better, 1 / (1 + np.exp(np.clip(sigma * (score[own, None] - score[None, :]), -500, 500))), 0)
        weight = np.abs(gain[own, None] - gain[None, :]) * np.abs(discount[own, None] - discount[None, :]) / ideal
        push, curve = sigma * rho * weight, sigma**2 * rho * (1 - rho) * weight
        g[own] += push.sum(1)
        g -= push.sum(0)
        h[own] += curve.sum(1)
        h += curve.sum(0)
    return g, h


def lambda_gradients(df: DataFrame, score: str, relevance: str, by: str = "date", entity: str = "ticker", sigma: float = 1.0) -> DataFrame:
    """(by, entity, gradient, hessian) of scores.  A group is a cross-section: its size is the number of entities.  Rows without a score
    or relevance are left out."""
    rows = df.select(by, entity, F.col(score).cast("double").alias("s"), F.col(relevance).cast("double").alias("y")).dropna(subset=["s", "y"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(entity, kind="stable")
        g, h = pair_gradients(part["s"].to_numpy(), part["y"].to_numpy(), sigma)
        return pd.DataFrame({by: part[by].to_numpy(), entity: part[entity].to_numpy(), "gradient": g, "hessian": h})

    types = dict(rows.dtypes)
    return rows.groupBy(by).applyInPandas(run, f"`{by}` {types[by]}, `{entity}` {types[entity]}, gradient double, hessian double")


@dataclass
class RankTrees:
    """Complete trees of one depth: for each inner node the feature and the limit up to which rows go left; for each leaf its value."""

    features: list[str]
    split: list[list[int]]
    limit: list[list[float]]
    leaf: list[list[float]]

    def column(self) -> Column:
        """The score as an expression of the features; NULL features go left."""
        total = F.lit(0.0)
        for t in range(len(self.leaf)):
            total = total + self._node(t, 0)
        return total

    def _node(self, t: int, k: int) -> Column:
        inner = len(self.split[t])
        if k >= inner:
            return F.lit(self.leaf[t][k - inner])
        if not np.isfinite(self.limit[t][k]):
            return self._node(t, 2 * k + 1)
        return F.when(F.col(self.features[self.split[t][k]]) > self.limit[t][k], self._node(t, 2 * k + 2)).otherwise(self._node(t, 2 * k + 1))


def _leaves(binned: np.ndarray, split: list[int], bins: list[int], depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels; bins are the last bins that go left."""
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(depth):
        node = 2 * node + 1 + (binned[rows, np.array(split)[node]] > np.array(bins)[node])
    return node


def fit_ranker(
    df: DataFrame, features: list[str], relevance: str, by: str = "date", entity: str = "ticker", trees: int = 20, depth: int = 3, bins: int = 32,
    rate: float = 0.1, penalty: float = 1.0, least: int = 20, sigma: float = 1.0,
) -> RankTrees:
    """Trees that raise NDCG of ``relevance`` (whole numbers, larger is better) within each group.

    Rows without a relevance are left out; NULL features count as the least value.  Without rows, or where nothing is left to gain,
    trees are empty and scores 0.  A task holds one group at a time; groups are kept once, as arrays.
    """
    rows = df.filter(F.col(relevance).isNotNull() & F.col(by).isNotNull())
    probs = [i / bins for i in range(1, bins)]
    cuts = [sorted(set(c)) for c in rows.approxQuantile(features, probs, 0.002)]
    out = RankTrees(features, [], [], [])
    if not any(cuts):
        return out
    item = F.struct(entity, F.col(relevance).cast("double").alias("y"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in features]).alias("x"))
    groups = kept(rows.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("g")).select("g.y", "g.x"))
    inner, limits = 2**depth - 1, []  # limits: bins as _leaves takes them, of each tree

    def histogram(split: list[int], at: list[int], level: int) -> pd.DataFrame:
        done = list(zip(out.split, limits, out.leaf, strict=True))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shape = (2**level, len(features), bins)
            sums = np.zeros((3, *shape))
            for part in parts:
                for y, x in zip(part["y"], part["x"], strict=True):
                    x = np.stack(x)
                    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
                    score = np.zeros(len(x))
                    for s, b, leaf in done:
                        score += np.array(leaf)[_leaves(binned, s, b, depth) - inner]
                    g, h = pair_gradients(score, np.asarray(y), sigma)
                    own = _leaves(binned, split, at, level) - (2**level - 1)
                    cell = (own[:, None] * len(features) + np.arange(len(features))) * bins + binned
                    for k, v in enumerate((g, h, np.ones(len(x)))):
                        sums[k] += np.bincount(cell.ravel(), np.repeat(v, len(features)), sums[k].size).reshape(shape)
            node, feature, b = np.nonzero(sums[2])
            yield pd.DataFrame({"node": node, "feature": feature, "bin": b, "g": sums[0][node, feature, b], "h": sums[1][node, feature, b], "n": sums[2][node, feature, b]})

        part = groups.mapInPandas(run, "node int, feature int, bin int, g double, h double, n double")
        return part.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()

    for _ in range(trees):
        split, at = [0] * inner, [bins] * inner
        for level in range(depth):
            sums = np.zeros((3, 2**level, len(features), bins))
            found = histogram(split, at, level)
            for k, c in enumerate("ghn"):
                sums[k][found["node"], found["feature"], found["bin"]] = found[c]
            g, h, n = sums.cumsum(3)
            gt, ht, nt = g[..., -1:], h[..., -1:], n[..., -1:]
            gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
            gain[(n < least) | (nt - n < least)] = 0
            best = gain.reshape(2**level, -1).argmax(1)
            leaf = np.zeros(2 ** (level + 1))
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                good = gain[k, f, cut] > 1e-9
                node = 2**level - 1 + k
                split[node], at[node] = (f, cut) if good else (0, bins)
                left = (g[k, f, cut], h[k, f, cut]) if good else (gt[k, 0, 0], ht[k, 0, 0])
                leaf[2 * k] = rate * left[0] / (left[1] + penalty)
                leaf[2 * k + 1] = rate * (gt[k, 0, 0] - left[0]) / (ht[k, 0, 0] - left[1] + penalty) if good else 0.0
        if all(b == bins for b in at):
            break
        limits.append(at)
        out.split.append(split)
        out.limit.append([cuts[f][b] if b < len(cuts[f]) else float("inf") for f, b in zip(split, at, strict=True)])
        out.leaf.append(leaf.tolist())
    return out


def rank_scores(features: list[str], relevance: str, **parameters) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """fit_predict with a ranker, for ``backtest.walk_forward`` and ``backtest.frozen_scores``."""

    def run(train: DataFrame, now: DataFrame) -> DataFrame:
        return now.withColumn("score", fit_ranker(train, features, relevance, **parameters).column())

    return run


def ndcg(df: DataFrame, score: str, relevance: str, by: str = "date", entity: str = "ticker", top: int | None = None) -> DataFrame:
    """(by, ndcg) over the best ``top`` of each group (all); ties go by entity; NULL where no row is relevant."""
    rows = df.filter(F.col(score).isNotNull() & F.col(relevance).isNotNull())

    def part(order: Column) -> Column:
        k = F.row_number().over(Window.partitionBy(by).orderBy(order, entity))
        worth = (F.pow(F.lit(2.0), relevance) - 1) / F.log2(k + 1)
        return worth if top is None else F.when(k <= top, worth).otherwise(0.0)

    both = rows.select(by, part(F.desc(score)).alias("__d"), part(F.desc(relevance)).alias("__i"))
    return both.groupBy(by).agg(F.try_divide(F.sum("__d"), F.nullif(F.sum("__i"), F.lit(0.0))).alias("ndcg"))
