"""Connected components by alternating large and small stars, with grouped minima and joins, on edges that are contracted by batches first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows, table


def _star(edges: DataFrame) -> DataFrame:
    """One large star, then one small star; edges (a, b) with a > b."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return large.join(low, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a > b").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with shorter paths: edges meet in the order of their lesser nodes, and those of a batch become stars of their
    own least nodes.  A batch is all that a task holds."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for some, others in batches:
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for a, b in zip(some, others, strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            stars = [(a, r) for a in parent if (r := root(a)) != a]
            yield [[a for a, _ in stars], [r for _, r in stars]]

    return map_rows(edges.repartitionByRange("b").sortWithinPartitions("b"), ["a", "b"], "a long, b long", run)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node that can be reached.  Loops and nulls are left out.

    Each round is written, and its shuffle files go; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = table(_contracted(edges), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, edges = now, table(_star(edges), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
