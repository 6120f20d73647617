"""As-of, offset, tolerance and nearest-neighbour joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asof(fast: DataFrame, slow: DataFrame, on: list[str], time: str, slow_time: str, forward: bool, strict: bool) -> DataFrame:
    """Both sides in one sorted stream by key: each fast row takes the nearest slow row behind (or ahead of) it as a whole, so NULL
    values in that row survive.  One exchange and no pairs, however many rows match."""
    side = [c for c in slow.columns if c not in on]
    left = fast.select("*", F.col(time).alias("__t"), F.lit(None).cast(slow.select(F.struct(*side).alias("s")).schema["s"].dataType).alias("__s"))
    right = slow.select(*on, F.col(slow_time).alias("__t"), F.struct(*side).alias("__s"))
    both = left.withColumn("__fast", F.lit(True)).unionByName(right.withColumn("__fast", F.lit(False)), allowMissingColumns=True)
    # At equal times the slow row stands on the side that makes it count, or not when strict.  Forward goes through the rows backwards:
    # a frame that ends at the current row is carried along, one that starts there is computed anew for every row.
    first = (~F.col("__fast") if strict else F.col("__fast")).cast("int")
    w = Window.partitionBy(*on).orderBy(F.desc("__t") if forward else F.asc("__t"), first)
    found = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    keep = [c for c in fast.columns]
    names = [c if c not in keep else f"{c}_right" for c in side]
    return both.withColumn("__m", found).filter("__fast").select(*keep, *[F.col("__m").getField(c).alias(n) for c, n in zip(side, names, strict=True)])


def asof_backward(fast: DataFrame, slow: DataFrame, on: list[str], time: str, slow_time: str, strict: bool = False) -> DataFrame:
    """The latest slow row at or before (strict: before) each fast row."""
    return _asof(fast, slow, on, time, slow_time, False, strict)


def asof_forward(fast: DataFrame, slow: DataFrame, on: list[str], time: str, slow_time: str, strict: bool = False) -> DataFrame:
    """The first slow row at or after (strict: after) each fast row."""
    return _asof(fast, slow, on, time, slow_time, True, strict)


def forward_rows(events: DataFrame, prices: DataFrame, on: list[str], time: str, price_time: str, price: str, rows: list[int], strict: bool = False) -> DataFrame:
    """Price at the first row at or after the event, and returns to the rows so many later."""
    w = Window.partitionBy(*on).orderBy(price_time)
    ahead = prices.select(*on, price_time, price, *[F.lead(price, h).over(w).alias(f"__p{h}") for h in rows])
    found = asof_forward(events, ahead, on, time, price_time, strict)
    return found.select(*[c for c in found.columns if not c.startswith("__p")], *[F.try_divide(f"__p{h}", price).alias(f"__q{h}") for h in rows]).select("*", *[(F.col(f"__q{h}") - 1).alias(f"fwd_{h}") for h in rows]).drop(*[f"__q{h}" for h in rows])


def forward_days(events: DataFrame, prices: DataFrame, on: list[str], time: str, price_time: str, price: str, days: int) -> DataFrame:
    """Price at the first row at or after the event plus so many calendar days."""
    later = events.withColumn("__at", F.date_add(time, days))
    return asof_forward(later, prices.select(*on, F.col(price_time).alias("later_date"), F.col(price).alias("later_price")), on, "__at", "later_date").drop("__at")


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, low: int, high: int, target: int = 0, ties: str | None = None) -> DataFrame:
    """For each left row the right row whose time lies low..high days after it and is nearest to ``target`` days; others are left out.

    Right rows are dealt to buckets as wide as the range, so a left row meets two buckets only.
    """
    width = max(1, high - low + 1)
    day = F.datediff(F.col(time), F.lit("1970-01-01").cast("date"))
    l = left.withColumn("__id", F.monotonically_increasing_id()).withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((day + low) / width), F.floor((day + high) / width)))))
    r = right.select(*[F.col(c).alias(c if c in on else f"{c}_right" if c in left.columns else c) for c in right.columns])
    rt = f"{right_time}_right" if right_time in left.columns else right_time
    r = r.withColumn("__b", F.floor(F.datediff(F.col(rt), F.lit("1970-01-01").cast("date")) / width))
    gap = F.datediff(F.col(rt), F.col(time))
    near = l.join(r, [*on, "__b"]).filter(gap.between(low, high)).withColumn("__gap", F.abs(gap - target))
    w = Window.partitionBy("__id").orderBy("__gap", rt, *([ties] if ties else []))
    return near.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__gap", "__b", "__id")


def with_dimension(df: DataFrame, dim: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join of a dimension; values of unknown keys take the defaults."""
    out = df.join(dim, on, "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def outer_zero(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer join of two weightings; a missing side counts 0."""
    return a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), on, "full").select(*on, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a shard of the base, about; similarities that a task holds at a time; how far sums of products in another order may differ.
SHARD, HELD, SLACK = 5_000, 2_000_000, 1e-9


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Arrow lists of one length as the rows of a matrix, null ones as zeros, and which of them are not null."""
    known = ~np.asarray(column.is_null().combine_chunks() if isinstance(column, pa.ChunkedArray) else column.is_null(), bool)
    flat = np.concatenate([np.asarray(c.flatten()) for c in column.chunks] or [np.zeros(0)])
    out = np.zeros((len(known), len(flat) // max(1, int(known.sum()))))
    out[known] = flat.reshape(int(known.sum()), -1)
    return out, known


def nearest_rows(rows: pa.Table, wanted: pa.Table, k: int, apart: bool = False) -> pa.Table:
    """(query, id, group, similarity): the k of ``rows`` (id, group, v) nearest to each of ``wanted`` by the product of their vectors,
    then by id, without its own id and, if ``apart``, without its own group.  Pairs without a vector come last, their similarity is null.

    A product of matrices chooses what comes near the k-th; that is then summed in the order of the dimensions, as ``dot`` does, so
    copies tie exactly wherever they lie.
    """
    queries, found, groups, near = [], [], [], []
    order = np.argsort(np.array(rows["id"].to_pylist()), kind="stable") if len(rows) else []
    if len(rows) and len(wanted):
        rows = rows.take(pa.array(order))
        (base, known), (asked, asked_known) = matrix(rows["v"]), matrix(wanted["v"])
        base = base if base.shape[1] else np.zeros((len(base), asked.shape[1]))
        asked = asked if asked.shape[1] else np.zeros((len(asked), base.shape[1]))
        ids, own = np.array(rows["id"].to_pylist()), wanted["id"].to_pylist()
        of = np.array(rows["group"].to_pylist(), object) if "group" in rows.column_names else np.full(len(rows), None)
        their = wanted["group"].to_pylist() if apart else [None] * len(wanted)
        step, k_ = max(1, HELD // len(base)), max(0, len(base) - k)
        for i in range(0, len(asked), step):
            part = asked[i : i + step] @ base.T
            part[:, ~known] = -2
            part[~asked_known[i : i + step]] = -2
            for n, s in enumerate(part, i):
                s[np.searchsorted(ids, own[n], "left") : np.searchsorted(ids, own[n], "right")] = -np.inf
                if their[n] is not None:
                    s[of == their[n]] = -np.inf
                best = np.flatnonzero((s >= np.partition(s, k_)[min(k_, len(s) - 1)] - SLACK) & (s > -np.inf))
                exact = np.where(s[best] == -2, -2, np.cumsum(base[best] * asked[n], axis=1)[:, -1] if base.shape[1] else -2)
                first = np.argsort(-exact, kind="stable")[:k]
                queries += [own[n]] * len(first)
                found += ids[best[first]].tolist()
                groups += of[best[first]].tolist()
                near += [x if x > -2 else None for x in exact[first].tolist()]
    kind = rows.schema.field("id").type
    return pa.table([pa.array(queries, kind), pa.array(found, kind), pa.array(groups, pa.string()), pa.array(near, pa.float64())], names=["query", "id", "group", "similarity"])


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int, vector: str = "embedding", id_col: str = "id", block: int = 10_000) -> DataFrame:
    """(query, id, similarity, rank): exact cosine top-k of a stated set of queries against all rows.

    Every query meets every row, so the work is their product; it is dealt to tasks that hold about ``SHARD`` rows and ``block`` queries
    each, however many there are.  Of these k rows per query and shard are shuffled to the final ranking.  Null vectors and those of
    length 0 have no similarity and come last.
    """

    def unit(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null").withColumn("__n", F.sqrt(dot("v", "v")))
        return rows.select("id", F.when(F.col("__n") > 0, F.transform("v", lambda x: x / F.nullif(F.col("__n"), F.lit(0.0)))).alias("v"))

    b, q = unit(base), unit(queries)
    shards, blocks = max(1, -(-b.count() // SHARD)), max(1, -(-q.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    b = b.select("id", "v", dealt(shards).alias("shard"), each(blocks).alias("block"))
    q = q.select("id", "v", dealt(blocks).alias("block"), each(shards).alias("shard"))

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        return nearest_rows(rows, wanted, k).drop_columns("group")

    kind = dict(b.dtypes)["id"]
    pairs = b.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(run, f"query {kind}, id {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def union_first(*sources: DataFrame, key: str) -> DataFrame:
    """All rows of the first source, then of each next one those whose key no earlier source has."""
    return reduce(lambda have, more: have.unionByName(more.join(have.select(key).distinct(), key, "left_anti"), allowMissingColumns=True), sources)


def in_not_in(df: DataFrame, include: DataFrame | None, exclude: DataFrame | None, key: str) -> DataFrame:
    """Keys to take first, keys to leave out then."""
    if include is not None:
        df = df.join(include.select(key).distinct(), key, "left_semi")
    return df.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else df


def nearest_label(labels: list[str], have: set[str], wanted: str, fallback: str | None = None) -> str | None:
    """The wanted label, else the fallback, else the nearest label outward with the earlier one first; None if there is none."""
    if wanted in have:
        return wanted
    if fallback in have:
        return fallback
    at = labels.index(wanted)
    for d in range(1, len(labels)):
        for i in (at - d, at + d):
            if 0 <= i < len(labels) and labels[i] in have:
                return labels[i]
    return None
