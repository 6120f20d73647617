"""Nearest vectors by an inverted-file index, and what is said in retrieved passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import div, draw
from crosspanel.functions.storage import kept
from crosspanel.operators.joins import HELD, nearest_rows

#: Rows that the centroids are fitted on at most, the first in the order of a digest of the id; rows of a shard of a cell, about.
SAMPLE, SHARD = 20_000, 20_000


@dataclass
class Index:
    """Every row under the cell of its nearest centroid: (id, group, v, cell, shard), v of length 1; and the centroids."""

    rows: DataFrame
    shards: DataFrame
    centroids: np.ndarray


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Spherical k-means of unit vectors; a cell that runs empty starts anew from the row that fits its own cell least."""
    rng = np.random.default_rng(seed)
    out = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = sample @ out.T
        own = near.argmax(1)
        worst = iter(np.argsort(near[np.arange(len(sample)), own]))
        for k in range(len(out)):
            rows = sample[own == k]
            found = rows.sum(0) if len(rows) else sample[next(worst)]
            out[k] = found / max(np.linalg.norm(found), 1e-12)
    return out


def _units(df: DataFrame, id_col: str, vector: str, group: str | None) -> DataFrame:
    other = F.lit(None).cast("string") if group is None else F.col(group).cast("string")
    found = df.select(F.col(id_col).alias("id"), other.alias("group"), F.col(vector).cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return found.withColumn("__n", length).filter(F.col("__n") > 0).withColumn("v", F.transform("v", lambda x: x / F.col("__n"))).drop("__n")


def _near(df: DataFrame, points: np.ndarray, probes: int) -> DataFrame:
    """df once for each of the ``probes`` cells whose centroids are nearest, as ``cell``."""
    kinds = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A slice at a time, since its rows stand for the similarities of all cells and go out once for each probe.
            step = max(1, HELD // max(len(points), probes * points.shape[1]))
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                v = np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1)
                cells = np.argpartition(-(v @ points.T), min(probes, len(points)) - 1, axis=1)[:, :probes]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.ravel().astype(np.int32))], names=[*kinds.names, "cell"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "cell int"])
    return df.mapInArrow(run, schema)


def build_index(base: DataFrame, cells: int | None = None, vector: str = "embedding", id_col: str = "id", group: str | None = None, sample: int = SAMPLE, shard: int = SHARD, seed: int = 42) -> Index:
    """An index of all rows of base that have a vector other than zero.

    Centroids (the square root of the number of rows, unless told) come from at most ``sample`` rows; every row is listed.  A cell with
    more than ``shard`` rows is cut by a hash of the id, so copies that fill one cell do not fill one task.
    """
    rows = _units(base, id_col, vector, group)
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), sample, n))
    share = min(1.0, (1.5 * sample + 100) / max(1, n))
    few = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(draw(seed, "id"), "id").limit(sample)
    found = np.array([r.v for r in few.select("v").collect()])
    points = centroids(found, cells, seed=seed) if len(found) else np.zeros((1, 1))
    # Cells are computed once: the last bits of a product need not repeat, so a row between two cells could be listed in one of them and
    # its shards counted in the other.
    listed = kept(_near(rows, points, 1)) if len(found) else rows.withColumn("cell", F.lit(0))
    shards = listed.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))  # a row per cell
    listed = listed.join(F.broadcast(shards), "cell").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards")
    return Index(listed, shards, points)


def search(index: Index, queries: DataFrame, k: int, probes: int = 16, vector: str = "embedding", id_col: str = "id", group: str | None = None) -> DataFrame:
    """(query, id, group, similarity, rank): the k rows nearest to each query by cosine, of the ``probes`` nearest cells, in the order of
    similarity and id; a query's own id is left out, and rows of its own group, if ``group`` names a column of queries.

    Cells choose candidates only; similarities are exact.  With as many probes as cells the result is exact.  Each shard meets the
    queries that probe its cell, keeps k rows of each, and only those are shuffled to the final ranking.
    """
    asked = _near(_units(queries, id_col, vector, group), index.centroids, min(probes, len(index.centroids)))
    asked = asked.join(F.broadcast(index.shards), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    kind = dict(index.rows.dtypes)["id"]
    apart = group is not None

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        return nearest_rows(rows, wanted, k, apart)

    found = index.rows.select("cell", "shard", "id", "group", "v").groupBy("cell", "shard").cogroup(asked.select("cell", "shard", "id", "group", "v").groupBy("cell", "shard")).applyInArrow(run, f"query {kind}, id {kind}, `group` string, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def tuned_probes(index: Index, exact: DataFrame, queries: DataFrame, recall: float = 0.9, vector: str = "embedding", id_col: str = "id") -> int:
    """The fewest probes with which a search would have found that share of ``exact`` (query, id), the true neighbours of ``queries``:
    the rank of each neighbour's cell among the query's cells says how many probes reach it.  Ranks are counted, a row per rank."""
    points = index.centroids
    cells = index.rows.select("id", "cell").join(exact.select("query", "id"), "id").select("query", "cell")
    found = cells.join(_units(queries, id_col, vector, None).select(F.col("id").alias("query"), "v"), "query").select("cell", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, HELD // len(points))
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                near = np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1) @ points.T
                own = near[np.arange(part.num_rows), np.asarray(part.column("cell"))]
                yield pa.RecordBatch.from_arrays([pa.array((near > own[:, None]).sum(1) + 1, pa.int64())], names=["probes"])

    counts = sorted((r["probes"], r["n"]) for r in found.mapInArrow(run, "probes long").groupBy("probes").agg(F.count("*").alias("n")).collect())
    wanted, have = max(1, int(np.ceil(recall * sum(n for _, n in counts)))), 0
    for probes, n in counts:
        have += n
        if have >= wanted:
            return probes
    return len(points)


def peer_tone(hits: DataFrame, passages: DataFrame, tones: DataFrame, least: int = 2, times: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """(by.., group, peers, gap): how much more positive each company's tone is than its peers' in passages on the same theme.

    hits (by.., id) are retrieved passages, passages (id, group, positive, negative) their companies and word counts, tones (group,
    tone) the companies that are asked for.  A peer's tone is (positive - negative) / (positive + negative) over all its retrieved
    passages, 0 without such words; the gap is the own tone less the mean over the peers other than oneself, times a factor, within
    [-1, 1]; 0 with fewer than ``least`` peers.  Sums over all peers are taken once and the own part is taken off, so companies are
    never paired.
    """
    by = by or []
    found = hits.select(*by, "id").join(passages, "id").groupBy(*by, "group").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    found = found.withColumn("t", F.coalesce(div(F.col("p") - F.col("n"), F.nullif(F.col("p") + F.col("n"), F.lit(0))), F.lit(0.0)))
    whole = found.groupBy(*by).agg(F.sum("t").alias("total"), F.count("*").alias("all"))
    asked = whole.crossJoin(tones.select("group", "tone")) if by else F.broadcast(whole).crossJoin(tones.select("group", "tone"))  # themes are few
    asked = asked.join(found.select(*by, "group", "t"), [*by, "group"], "left")
    peers = F.col("all") - F.col("t").isNotNull().cast("long")
    mean = (F.col("total") - F.coalesce("t", F.lit(0.0))) / peers
    gap = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("tone") - mean) * times))
    return asked.select(*by, "group", peers.alias("peers"), F.when(peers >= least, gap).otherwise(0.0).alias("gap"))


def word_count(text: str | Column, words: list[str]) -> Column:
    """How often any of the words stands in the text, in lower case."""
    return F.regexp_count(F.lower(text), F.lit(rf"\b({'|'.join(words)})\b"))
