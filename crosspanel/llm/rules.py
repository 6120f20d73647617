"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and repeated 8-word windows.  The method then compresses the whole text and every
fixed chunk of it with zstandard: a ratio (bytes before / after) above the upper limit means repetition, one below the lower limit
means noise.  Longer texts compress better whatever they hold, so the limits depend on the length: for each octave of bytes they lie
some standard deviations around the curve that good documents follow there.  Without labelled documents fixed bands are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import WORD, map_rows, table
from crosspanel.llm.gbdt import held_out

#: Standard deviations around the curve of good documents, and how many of these a curve needs.
DEVIATIONS, LEAST, OCTAVES = 3.5, 200, 40
#: Without labels: (bytes up to, least ratio, greatest ratio).  The last band has no upper end.
BANDS = ((64, 0.2, 3.0), (256, 0.5, 4.0), (1024, 1.0, 4.0), (4096, 1.3, 4.0), (16384, 1.4, 4.0), (None, 1.45, 4.0))
#: Bytes of a chunk, and the share of a text's chunks that may lie outside their band.
CHUNK, BAD_CHUNKS = 4096, 0.25
LEVEL = 3
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more.  Exact: windows are ranked by doubling, without hashing.  window: a power of 2."""
    n = len(ids)
    if n <= window:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < window:
        key = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank, counts = np.unique(key, return_inverse=True, return_counts=True)
        width *= 2
        if counts.max() < 2:
            return 0
    starts = np.flatnonzero(counts[rank] >= 2)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(change[:n])))


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.  Null: zeros."""
    text = text or ""
    found = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    return len(found), sum(map(len, found)), sum(map(text.count, SYMBOLS)), dup, repeat_words(ids)


class Compression:
    """zstandard ratios of a whole text and of its chunks."""

    def __init__(self, level: int = LEVEL, chunk: int = CHUNK) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        self.chunk = chunk

    def ratio(self, data: bytes) -> float:
        return len(data) / max(1, len(self.compress(data)))

    def measure(self, text: str | None) -> tuple[int, float, list[float]]:
        """Bytes, the whole text's ratio (0 for an empty one), and the chunks'."""
        data = (text or "").encode("utf-8", "replace")
        whole = self.ratio(data) if data else 0.0
        if len(data) < 2 * self.chunk:
            return len(data), whole, [whole] if data else []
        # The last chunk takes the rest along, as the ratio of a few bytes says little.
        starts = [*range(0, len(data) - 2 * self.chunk + 1, self.chunk)]
        starts.append(starts[-1] + self.chunk)
        return len(data), whole, [self.ratio(data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]


@dataclass(frozen=True)
class Limits:
    """For each octave of bytes (0: one byte, 1: two or three, ..) a center p0 + p1 x + p2 x^2, x being log2 of the bytes, and the widths
    below and above it."""

    rows: tuple[tuple[float, float, float, float, float], ...]

    def of(self, size: int) -> tuple[float, float]:
        x = math.log2(max(1, size))
        p0, p1, p2, below, above = self.rows[min(len(self.rows) - 1, max(0, size.bit_length() - 1))]
        center = p0 + p1 * x + p2 * x * x
        return center - below, center + above

    def inside(self, size: Column, ratio: Column) -> Column:
        """Whether the ratio of so many bytes (one at least) lies within the limits."""
        octave = F.least(F.length(F.bin(size)) - 1, F.lit(len(self.rows) - 1))
        p0, p1, p2, below, above = (F.get(F.array(*map(F.lit, c)), octave) for c in zip(*self.rows, strict=True))
        x = F.log2(size.cast("double"))
        away = ratio - (p0 + x * p1 + x * x * p2)
        return (away >= -below) & (away <= above)


def fixed_limits() -> Limits:
    """BANDS; a band that ends within an octave counts for all of it."""
    rows = []
    for k in range(OCTAVES):
        low, high = next((lo, hi) for upto, lo, hi in BANDS if upto is None or 2**k < upto)
        rows.append(((low + high) / 2, 0.0, 0.0, (high - low) / 2, (high - low) / 2))
    return Limits(tuple(rows))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, the base counts, base_failed, n_bytes, whole_ratio, chunk_ratios) per row of docs."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        compression = Compression()
        for ids, texts in batches:
            rows = []
            for key, text in zip(ids, texts, strict=True):
                n, chars, symbols, dup, repeat = base_features(text)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                rows.append((key, n, chars, symbols, dup, repeat, failed, *compression.measure(text)))
            yield [list(c) for c in zip(*rows, strict=True)]

    schema = f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, whole_ratio double, chunk_ratios array<double>"
    return map_rows(docs, [id_col, text_col], schema, run)


def fit_limits(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", deviations: float = DEVIATIONS, least: int = LEAST) -> Limits:
    """Limits from all documents that are labelled good, outside the held-out quarter, and pass the base rules.

    Spark sums the moments of each octave; the curve of an octave is a least-squares parabola over it and as many octaves on both sides
    as give ``least`` documents.  With fewer documents in all, the fixed bands.  Ids that are null count nowhere, an id with several
    labels or texts counts for each text once.
    """
    key = F.col(f"`{id_col}`")
    good = labels.filter(key.isNotNull() & (F.col(f"`{label_col}`") == 1) & ~held_out(id_col, 4, 2)).select(key.alias("k")).distinct()
    x, y = F.log2(F.col("n_bytes").cast("double")), F.col("whole_ratio")
    rows = measured.filter("n_bytes > 0 and not base_failed").select(key.alias("k"), (F.length(F.bin("n_bytes")) - 1).alias("octave"), x.alias("x"), y.alias("y"))
    sums = [F.sum(F.pow("x", F.lit(k))) for k in range(5)] + [F.sum(F.pow("x", F.lit(k)) * F.col("y")) for k in range(3)] + [F.sum(F.col("y") * F.col("y"))]
    got = rows.join(good, "k", "left_semi").groupBy("octave").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()
    moments = {r.octave: np.array(r[1:], float) for r in got}
    if sum(m[0] for m in moments.values()) < least:
        return fixed_limits()
    return Limits(tuple(_curve(moments, k, deviations, least) for k in range(OCTAVES)))


def _curve(moments: dict[int, np.ndarray], octave: int, deviations: float, least: int) -> tuple[float, float, float, float, float]:
    for reach in range(1, OCTAVES + 64):
        m = sum((v for k, v in moments.items() if abs(k - octave) <= reach), np.zeros(9))
        if m[0] >= least:
            break
    a, b = np.array([[m[i + j] for j in range(3)] for i in range(3)]) / m[0], m[5:8] / m[0]
    p = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    width = deviations * math.sqrt(max(m[8] / m[0] - float(p @ b), 1e-4))
    return float(p[0]), float(p[1]), float(p[2]), width, width


def judge(measured: DataFrame, limits: Limits) -> DataFrame:
    """``measure``'s counts with bad_chunk_share and kept.  A text without bytes is not kept."""
    size = F.lit(CHUNK).cast("long")
    last = F.col("n_bytes") - (F.size("chunk_ratios") - 1) * size
    outside = F.filter("chunk_ratios", lambda r, i: ~limits.inside(F.when(i < F.size("chunk_ratios") - 1, size).otherwise(last), r))
    share = F.when(F.col("n_bytes") > 0, F.size(outside) / F.size("chunk_ratios")).otherwise(0.0)
    good = F.when(F.col("n_bytes") > 0, limits.inside(F.col("n_bytes"), F.col("whole_ratio"))).otherwise(False)
    out = measured.withColumn("bad_chunk_share", share).withColumn("kept", ~F.col("base_failed") & good & (F.col("bad_chunk_share") <= BAD_CHUNKS))
    return out.drop("n_bytes", "chunk_ratios")


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the base counts, base_failed, whole_ratio, bad_chunk_share, kept.

    Limits come from the labelled documents, if there are any.  Null or empty text has no words, so it fails the base rules; its ratio
    is 0.  Rows are judged one by one: copies get the same verdict.  A long text is one row's memory.  An empty table gives an empty
    result.  Other columns of docs are ignored.
    """
    if labels is None:
        return judge(measure(docs, id_col, text_col), fixed_limits())
    measured = table(measure(docs, id_col, text_col), "rules")
    return judge(measured, fit_limits(measured, labels, id_col))
