"""Permutation test and bootstrap of the difference of two groups' means, for thousands of draws.

A draw of the permutation test is a keyed Feistel network over row numbers: it says where a row goes without sorting or moving
anything.  Tasks run over their rows once, draw by draw in numpy, and give one number per draw; rows are never multiplied by draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.metrics import global_row_number

#: Fixed multipliers of the round function, and rounds.
M1, M2, M3, ROUNDS = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 6
_32 = np.uint64(0xFFFFFFFF)


def half_bits(n: int) -> int:
    """Bits of each half of the network's domain, which holds 0..n-1; 4 at least, as smaller networks know few permutations."""
    return max(4, (max(2, n) - 1).bit_length() + 1 >> 1)


def permuted(i: np.ndarray, draw: int, n: int, seed: int = 42) -> np.ndarray:
    """Where row i of n goes in a draw.  Values beyond n go through the network again, so this permutes 0..n-1."""
    bits = half_bits(n)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(32 - bits)
    keys = [np.uint64((draw * M2 + r * M3 + seed * M1) % (1 << 32)) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(bits), v & mask
        for key in keys:
            t = (right * np.uint64(M1) + key) & _32
            t = ((t ^ (t >> np.uint64(15))) * np.uint64(M2)) & _32
            left, right = right, left ^ ((t ^ (t >> np.uint64(13))) >> shift)
        return (left << np.uint64(bits)) | right

    out = once(i.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _poisson(i: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """A Poisson(1) weight of each row in a draw, from a mix of row number, draw and seed."""
    h = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((draw * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % (1 << 64))
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(s))) * np.uint64(m)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_STEPS, u, side="right")


_STEPS = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)]))


def resampled_spreads(df: DataFrame, x: str, first: str, key: list[str], draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(draw, permuted, bootstrap): the difference of the means of the rows where ``first`` is true and where it is false, with the
    rows dealt anew to the two groups, and with the rows of each group drawn with replacement (Poisson weights).

    Rows are numbered by ``key``, which must tell them apart, so results do not depend on partitions.  Rows with a NULL in x or first
    are left out.  NULL where a group is empty.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(first).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(first).cast("int").alias("g"), *key)
    numbered = global_row_number(rows, [F.col(k) for k in key], "i")
    size = rows.agg(F.sum("g").alias("a"), F.count("*").alias("n"), F.sum("x").alias("s")).first()
    n, a, total = size.n, size.a or 0, size.s or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, draws))
        for b in batches:
            i, v, g = (np.asarray(b.column(c)) for c in ("i", "x", "g"))
            for d in range(draws if len(i) else 0):
                sums[0, d] += v[permuted(i - 1, d, n, seed) < a].sum()
                w = _poisson(i, d, seed)
                sums[1:, d] += (w * v * g).sum(), (w * g).sum(), (w * v * (1 - g)).sum(), (w * (1 - g)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *map(pa.array, sums)], names=["draw", "p", "xa", "wa", "xb", "wb"])

    found = numbered.select("i", "x", "g").mapInArrow(run, "draw long, p double, xa double, wa double, xb double, wb double")
    found = found.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("p", "xa", "wa", "xb", "wb")])
    mean = lambda s, w: F.try_divide(s, F.nullif(w, F.lit(0.0)))
    permuted_spread = mean(F.col("p"), F.lit(float(a))) - mean(F.lit(float(total)) - F.col("p"), F.lit(float(n - a)))
    return found.select("draw", permuted_spread.alias("permuted"), (mean(F.col("xa"), F.col("wa")) - mean(F.col("xb"), F.col("wb"))).alias("bootstrap"))


def spread_test(df: DataFrame, x: str, first: str, key: list[str], draws: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: the observed spread, the share of permutations with as large a one, and the bootstrap's mean and 95 % interval."""
    spread = F.avg(F.when(F.col(first), F.col(x))) - F.avg(F.when(~F.col(first), F.col(x)))
    seen = df.filter(F.col(x).isNotNull() & F.col(first).isNotNull()).agg(spread.alias("spread"))
    # As many rows as draws.  Sums of another order differ in their last digits; so near-equal spreads count as equal.
    out = resampled_spreads(df, x, first, key, draws, seed).crossJoin(seen)
    reached = (F.col("permuted") >= F.col("spread") - 1e-9 * F.abs("spread")).cast("double")
    return out.groupBy("spread").agg(F.avg(reached).alias("p_value"), F.avg("bootstrap").alias("bootstrap_mean"), F.percentile("bootstrap", F.lit(0.025)).alias("low"), F.percentile("bootstrap", F.lit(0.975)).alias("high"))
