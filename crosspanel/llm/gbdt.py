"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete, of one depth, and flattened into three arrays, so scoring a batch is ``depth`` rounds of numpy indexing per
tree.  Fitting reads a bounded sample of the labelled rows (``SAMPLE``); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows

#: At most so many labelled rows are used for the fit, the first in the order of a hash of the id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, LAMBDA = 60, 4, 64, 0.15, 20, 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "white": (9, 10, 11, 12, 13, 32), "line": (10,),
    "stop": b".?", "comma": b",;:", "bang": b"!", "pipe": b"|", "symbol": b"#*$%&<>", "bracket": b"()[]{}", "quote": b"\"'=_/\\",
    "high": range(128, 256),
}
_MASK = np.array([[b in list(v) for b in range(256)] for v in _CLASSES.values()], float).T
FEATURES = ("log_bytes", "log_words", "word_bytes", *_CLASSES, "distinct_words", "top_word", "distinct_lines", "line_words", "long_words", "repeated_neighbours")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; an empty or null one has zeros."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MASK / n
    words = data.split()
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    m = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), (len(data) - shares[3] * n) / m, *shares.tolist(),
        len(count) / m, max(count.values(), default=0) / m, len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)),
        sum(1 for w in words if len(w) > 20) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
    ]


@dataclass
class Trees:
    """split[t, node] and limit[t, node] for inner nodes in heap order, leaf[t, i]; base is the log odds before any tree."""

    base: float
    split: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, limit, leaf in zip(self.split, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, split[node]] > limit[node])
            total += leaf[node - len(split)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosts log loss.  Without rows every score is 0.5; with one class it is near that class."""
    inner = 2**depth - 1
    out = Trees(0.0, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(x):
        return out
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out.base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)  # v <= cuts[b]: bin at most b
    width, total = x.shape[1], np.full(len(x), out.base)
    columns = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            cell = (((node - first) * width * bins)[:, None] + columns + binned).ravel()
            shape = (k, width, bins)
            gs, hs, ns = (np.bincount(cell, np.repeat(v, width), k * width * bins).reshape(shape).cumsum(2) for v in (g, h, np.ones(len(x))))
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + LAMBDA) + (gt - gs) ** 2 / (ht - hs + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
            best = gain.reshape(k, -1).argmax(1)
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            f, b = best // bins, best % bins
            at = np.where(good, b, bins)  # a node without a good split sends all rows left
            out.split[t, first : first + k] = f
            out.limit[t, first : first + k] = [cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            own = node - first
            node = 2 * node + 1 + (binned[np.arange(len(x)), f[own]] > at[own])
        own = node - inner
        gs, hs = np.bincount(own, g, inner + 1), np.bincount(own, h, inner + 1)
        out.leaf[t] = rate * gs / (hs + LAMBDA)
        total += out.leaf[t][own]
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, x array<double>) per row of docs."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            yield [ids, [statistics(t) for t in texts]]

    return map_rows(docs, [id_col, text_col], f"{id_col} long, x array<double>", run)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(parts)) == part, F.lit(False))


def lowest(key: str, wanted: int, of: Column | int) -> Column:
    """Whether the hash of a key is among the lowest, so that some more than ``wanted`` of ``of`` rows pass: cuts rows where they are,
    before what is left is sorted by that hash."""
    share = F.least(F.lit(1.0), (F.lit(1.5) * wanted + 100) / F.greatest(F.lit(1), of if isinstance(of, Column) else F.lit(of)))
    return F.xxhash64(key).cast("double") <= share * 2.0**64 - 2.0**63


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees learned from labelled rows outside the held-out quarter.

    Rows with a null id or label are not used.  Where an id has several labels or texts, each pair counts once, and twice ``sample``
    pairs at most come to the driver.  Without labelled rows the trees score 0.5.
    """
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    rows = labels.filter(key.isNotNull() & label.isNotNull() & ~held_out(id_col, 4, 2)).select(key.alias("k"), label.cast("double").alias("y")).distinct()
    rows = rows.filter(lowest("k", sample, rows.count())).orderBy(F.xxhash64("k"), "k", "y").limit(sample)  # bounds the broadcast
    chosen = docs.select(key.alias("k"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(rows.select("k").distinct()), "k", "left_semi")
    got = features(chosen, "k", "text").join(F.broadcast(rows), "k").select("k", "x", "y").orderBy("k", "y").limit(2 * sample).collect()
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got]))


def _scores(trees: Trees, texts: list[str | None]) -> np.ndarray:
    return trees.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES)))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) per row of docs, null and empty texts too (their statistics are zeros).

    Rows are scored one by one: copies and repeated rows score the same, a long text is one row's memory, an empty table gives an empty
    result.  A score that equals the threshold passes it.  Other columns of docs are ignored.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            score = _scores(trees, texts)
            yield [ids, score.tolist(), (score >= threshold).astype(int).tolist()]

    return map_rows(docs, [id_col, text_col], f"{id_col} long, score double, predicted int", run)


def good_documents(docs: DataFrame, trees: Trees, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that ``score_quality`` predicts to be good, with all their columns; nothing is shuffled."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(trees, texts.tolist()))

    return docs.filter(score(F.col(f"`{text_col}`")) >= threshold)
