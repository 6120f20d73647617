"""What both exact substring operators share: documents under a key, repeated anchors, runs to remove.

The key of a row is a hash of its id and text, so neither null nor repeated ids matter.  Rows with the same id and the same text have
the same key and are taken as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows, table

#: Occurrences from which an anchor counts as crowded.
CROWD = 4_000
#: Units (bytes or words) that numpy looks at together: texts are joined up to that, longer ones are cut with an overlap.
SEGMENT = 262_144


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text); null texts become empty."""
    key = F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("key")
    return docs.select(key, F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(f"`{text_col}`", F.lit("")).alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters uint64 values, so that their order says nothing about the text."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of all windows of a fixed width, modulo 2^64, from prefix sums of at most a segment and its overlap."""

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.power = self.inverse = np.ones(0, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if n >= len(self.power):
            size = max(n + n // 4, 1 << 16)
            own = ((np.uint64(1), self.base), (np.uint64(1), pow(self.base, -1, 1 << 64)))
            self.power, self.inverse = (np.cumprod(np.concatenate([[one], np.full(size, b, np.uint64)])) for one, b in own)
        return np.concatenate([[np.uint64(0)], np.cumsum(values.astype(np.uint64) * self.inverse[:n])])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:-width]) * self.power[:n]) if n > 0 else np.zeros(0, np.uint64)


def joined(sizes: list[int], width: int, most: int = SEGMENT) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, from, to) of about ``most`` units: whole short texts together, long ones cut so that each window of ``width``
    units lies in exactly one part as a start."""
    group, total = [], 0
    for row, n in enumerate(sizes):
        for a in range(0, max(1, n - width + 1), most):
            part = (row, a, min(n, a + most + width - 1))
            group.append(part)
            total += part[2] - part[1]
            if total >= most:
                yield group
                group, total = [], 0
    if group:
        yield group


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position how often its keys occur here, and whether it is the first of them.

    This is the combining before a shuffle: of what repeats within a batch only one row is sent on, so no key gets more rows than
    there are batches.
    """
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    starts = np.concatenate([[True], ~same])[: len(order)]
    sizes = np.diff(np.append(np.flatnonzero(starts), len(order)))
    count, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
    count[order], first[order] = np.repeat(sizes, sizes), starts
    return count, first


def combined(h1: np.ndarray, h2: np.ndarray | None, own: np.ndarray, pos: np.ndarray, near: np.ndarray) -> list[pa.Array]:
    """Columns (h1, h2, key, pos, n) of a batch: the first row of a hash goes where the hash's other rows go and carries their number;
    the others are known to repeat and are dealt out by position."""
    count, first = first_of(h1) if h2 is None else first_of(h1, h2)
    extra = ~first
    h1 = np.where(extra, own * 31 + pos, h1.view(np.int64))
    h2 = np.where(extra, pos + 1, 0 if h2 is None else h2.view(np.int64))
    n = np.where(extra, 2, np.maximum(count, 1 + near)).astype(np.int32)
    return [pa.array(x) for x in (h1, h2, own, pos.astype(np.int32), n)]


def repeated(rows: DataFrame, crowd: int | None = None) -> DataFrame:
    """(key, pos) of the rows (h1, h2, key, pos, n) whose h1 and h2 occur twice or more, counting n for each row.

    Rows meet by hash and come sorted, so a task holds one batch at a time.  With ``crowd``, hashes that occur so often give one
    further row: the hash as key, and the number of occurrences below zero as pos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        total, before = 0, False  # of the held row's hash: occurrences in earlier rows, whether there are any
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(c).astype(np.int64) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            same = (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1])
            hit = (now[4] > 1) | np.concatenate([[before], same]) | np.concatenate([same, [False]])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sums = np.add.reduceat(now[4], starts)
            sums[0] += total
            # The last row waits: the next batch may begin with its like.
            before = bool(same[-1]) if len(same) else before
            total = int(sums[-1] - now[4][-1])
            held = [c[-1:] for c in now]
            keep = np.flatnonzero(hit[:-1])
            yield pair(now[2][keep], now[3][keep])
            if crowd:
                many = np.flatnonzero(sums[:-1] >= crowd)
                yield pair(now[0][starts[many]], -np.minimum(sums[many], 2**31 - 1))
        if held is not None and (held[4][0] > 1 or before):
            yield pair(held[2], held[3])
            if crowd and total + held[4][0] >= crowd:
                yield pair(held[0], -np.minimum([total + held[4][0]], 2**31 - 1))

    ready = rows.select("h1", "h2", "key", "pos", "n").repartition("h1").sortWithinPartitions("h1", "h2")
    return ready.mapInArrow(run, "key long, pos int")


def pair(key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.asarray(pos).astype(np.int32))], names=["key", "pos"])


def anchors(docs: DataFrame, fn: Callable[[], Callable], name: str, crowd: int | None = None) -> DataFrame:
    """A table (key, pos) of the repeated anchors of ``keyed`` docs.

    fn() gives a function from a list of texts to batches (row, hash, position, whether it is known to repeat).
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        find = fn()
        for keys, texts in batches:
            for i, j in slices([len(t) for t in texts], 4_000_000):
                got = list(find(texts[i:j]))
                if got:
                    own, h, pos, near = (np.concatenate([g[k] for g in got]) for k in range(4))
                    yield combined(h, None, np.array(keys[i:j], np.int64)[own], pos, near)

    rows = map_rows(docs, ["key", "text"], "h1 long, h2 long, key long, pos int, n int", run)
    return table(repeated(rows, crowd), name)


def lists(found: DataFrame) -> DataFrame:
    """(key, at): the sorted positions of each document with any."""
    return found.filter("pos >= 0").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def runs(found: DataFrame) -> DataFrame:
    """(key, runs): the ranges (key, start, stop) of each document as a sorted array of structs."""
    return found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges in order of their starts; ranges that touch become one."""
    if not len(starts):
        return starts, stops
    reach = np.maximum.accumulate(stops)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def finish(docs: DataFrame, ranges: DataFrame, width: int, measure: Callable, id_col: str, unit: str) -> DataFrame:
    """One row (id, counts, kept text as bytes) per row of ``keyed`` docs.

    ranges (key, start, stop) hold the starts of windows of ``width`` units that are removed.  measure gives a text's number of units
    and a function from the spans (from, to) that stay to their bytes.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts, found in batches:
            out: list[tuple] = []
            for key, text, own in zip(ids, texts, found, strict=True):
                n, keep = measure(text)
                start = stop = np.zeros(0, np.int64)
                if own:
                    start = np.array([r["start"] for r in own], np.int64)
                    start, stop = merged(start, np.minimum(n, np.array([r["stop"] for r in own], np.int64) + width - 1))
                spans = zip([0, *stop.tolist()], [*start.tolist(), n], strict=True)
                data = keep([(a, b) for a, b in spans if a < b])
                out.append((key, n, int((stop - start).sum()), len(start), hashlib.sha256(data).hexdigest(), data))
            yield [list(c) for c in zip(*out, strict=True)]

    schema = f"{id_col} long, n_{unit} long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return map_rows(docs.join(runs(ranges), "key", "left"), ["id", "text", "runs"], schema, run)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``most``, so that numpy arrays stay small."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        total += n
        if total >= most:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(sizes):
        yield i, len(sizes)
