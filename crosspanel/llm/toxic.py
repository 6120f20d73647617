"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

A word is a run of letters, lower-cased, between two spaces; each letter, and the space that ends a word, is predicted from up to
``ORDER`` - 1 symbols before it, none of them before the word's own space.  Counts of these grams are kept for toxic and for ordinary
documents.  What a class has not seen backs off to continuation counts that both classes share, so rare expressions and unknown words
weigh alike in both models and say little.

Both models compare a document by the difference of its log-likelihoods, normalised by length: over the whole document and over
its most toxic words.  A logistic curve turns these into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm._rows import Scratch, by_block, in_blocks, map_rows
from crosspanel.llm.gbdt import lowest

#: Symbols of a gram, and what each count gives to the order below.
ORDER, DISCOUNT = 6, 0.9
#: Labelled documents that the curve is fitted on, the first in the order of a hash of the id.
SAMPLE = 20_000
#: Up to so many rows are broadcast: labels to their documents, and the model to the scoring tasks.  Beyond, both are joined.
SMALL = 4_000_000
#: Words whose difference a task remembers, and characters of a block when the model is joined.
CACHE, BLOCK = 500_000, 16_000_000
_LETTERS = re.compile(r"[^\W\d_]{1,1000}")
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
FEATURES = ("mean", "root", "first", "second", "third", "share", "log_words")


def letters(text: str | None) -> list[str]:
    """The words of a text; a run of more than 1,000 letters is several."""
    return _LETTERS.findall(text.lower()) if text else []


def hashes(symbols: np.ndarray, last: np.ndarray, size: np.ndarray, kind: int) -> np.ndarray:
    """64-bit hashes of the grams that end at ``last`` and have ``size`` symbols; kind tells grams (0) from contexts (1)."""
    out, power = (size.astype(np.uint64) * np.uint64(2) + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93), _BASE
    for j in range(ORDER):
        out = out + np.where(size > j, symbols[np.maximum(last - j, 0)].astype(np.uint64) * power, np.uint64(0))
        power = np.multiply(power, _BASE, dtype=np.uint64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def grams(words: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words in one string, its symbols, and for each predicted symbol its place, its gram's size, and the number of its word."""
    text = f" {' '.join(words)} "
    symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = symbols == 32
    at = np.arange(len(symbols))
    before = np.maximum.accumulate(np.where(space, at, 0))[:-1]
    return text, symbols, at[1:], np.minimum(ORDER, at[1:] - before + 1), np.cumsum(space)[:-1] - 1


def count_grams(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): occurrences in the documents that labels (k, y) mark 1 and 0.  Each task adds up what a batch has."""
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("text")).join(labels, "k").filter(F.col("text").isNotNull())

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for texts, marks in batches:
            sums: dict[str, list[int]] = {}
            for mark in (1, 0):
                count: Counter = Counter()
                for text, y in zip(texts, marks, strict=True):
                    if y == mark:
                        count.update(letters(text))
                if not count:
                    continue
                text, symbols, at, size, word = grams(list(count))
                _, first, own = np.unique(hashes(symbols, at, size, 0), return_index=True, return_inverse=True)
                n = np.bincount(own, np.array(list(count.values()), float)[word]).astype(np.int64)
                for i, k, m in zip(at[first].tolist(), size[first].tolist(), n.tolist(), strict=True):
                    sums.setdefault(text[i - k + 1 : i + 1], [0, 0])[1 - mark] += m
            if sums:
                yield [list(sums), [s[0] for s in sums.values()], [s[1] for s in sums.values()]]

    counted = map_rows(rows, ["text", "y"], "gram string, toxic long, ordinary long", run)
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _suffixes(least: int, most: int):
    """The suffixes of a gram, from those of ``least`` symbols to those that leave ``most`` symbols out at least."""
    return F.expr(f"transform(sequence({most} + 1, length(gram) - {least} + 1), i -> substring(gram, i))")


def shared_backoff(counted: DataFrame) -> DataFrame:
    """(part, size, own, rest): for each gram that backing off may lead to what its continuation count gives its last symbol, and what
    share the order below gets.

    The count of a gram is the number of distinct symbols before it, over both classes and in grams of any order.
    """
    longer = counted.select(F.explode(_suffixes(2, 0)).alias("gram")).distinct()
    counts = longer.groupBy(F.expr("substring(gram, 2)").alias("part")).agg(F.count("*").alias("n"))
    context = Window.partitionBy(F.expr("substring(part, 1, length(part) - 1)"), F.length("part"))
    total = F.sum("n").over(context)
    own, rest = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / total, DISCOUNT * F.count("*").over(context) / total
    return counts.select("part", F.length("part").alias("size"), own.alias("own"), rest.alias("rest"))


def log_ratios(counted: DataFrame, work: Scratch) -> DataFrame:
    """(gram, kind, ratio): log P(toxic) - log P(ordinary) of the last symbol, for grams that either class has (kind 0); and for contexts
    that either has (kind 1) of any other symbol, where both back off to the same.

    The shared probability of a gram is folded from its suffixes, the shortest first, on top of equal shares of all symbols.
    """
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    same = Window.partitionBy("context")
    sums = [F.sum(c).over(same).alias(f"{c}_n") for c in ("toxic", "ordinary")] + [F.sum((F.col(c) > 0).cast("long")).over(same).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    full = work.write(counted.withColumn("context", context).select("*", *sums), "contexts")
    shared = work.write(shared_backoff(counted), "shared")
    symbols = max(1, shared.filter("size = 1").count())

    def rest(c: str):
        return F.when(F.col(f"{c}_n") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0)

    def p(c: str):
        seen = F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0)
        return seen + rest(c) * F.col("p")

    columns = [c for c in full.columns if c != "context"]
    parts = full.select(*columns, F.explode(_suffixes(1, 1)).alias("part")).join(shared, "part")
    levels = F.sort_array(F.collect_list(F.struct("size", "own", "rest")))  # at most ORDER - 1 rows
    seen = parts.groupBy(*columns).agg(F.aggregate(levels, F.lit(1.0 / symbols), lambda q, x: x["own"] + x["rest"] * q).alias("p"))
    known = seen.select("gram", F.lit(0).alias("kind"), (F.log(p("toxic")) - F.log(p("ordinary"))).alias("ratio"))
    other = full.select("context", "toxic_n", "ordinary_n", "toxic_kinds", "ordinary_kinds").distinct()
    return known.union(other.select(F.col("context").alias("gram"), F.lit(1).alias("kind"), (F.log(rest("toxic")) - F.log(rest("ordinary"))).alias("ratio")))


def _coded(ratios: DataFrame) -> DataFrame:
    """(code, ratio) of the rows of ``log_ratios``."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for keys, kinds, values in batches:
            symbols = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
            size, kind = np.array([len(k) for k in keys]), np.array(kinds)
            last = np.cumsum(size) - 1
            yield [np.where(kind == 0, hashes(symbols, last, size, 0), hashes(symbols, last, size, 1)), values]

    return map_rows(ratios, ["gram", "kind", "ratio"], "code long, ratio double", run)


def differences(words: list[str], codes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """log P(toxic) - log P(ordinary) of each word, from sorted codes: that of the gram, else that of its context, else 0."""
    if not words or not len(codes):
        return np.zeros(len(words))
    _, symbols, at, size, word = grams(words)
    out = np.zeros(len(at))
    for kind, last, n in ((1, at - 1, size - 1), (0, at, size)):
        h = hashes(symbols, last, n, kind)
        found = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
        out = np.where(codes[found] == h, ratios[found], out)
    return np.bincount(word, out, len(words))


def statistics(found: np.ndarray, distinct: np.ndarray, symbols: int) -> list[float]:
    """The features of a document from the differences of its words, those of its distinct words, and its number of symbols."""
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    top = np.zeros(3)
    best = np.sort(np.partition(distinct, max(0, len(distinct) - 3))[-3:])[::-1]
    top[: len(best)] = np.maximum(best, 0)
    return [float(found.sum()) / symbols, float(found.sum()) / n**0.5, *top.tolist(), float(np.maximum(distinct - 1, 0).sum()) / len(distinct), float(np.log1p(n))]


class _Words:
    """Differences of words, remembered up to CACHE words."""

    def __init__(self, codes: np.ndarray, ratios: np.ndarray) -> None:
        self.codes, self.ratios, self.known = codes, ratios, {}

    def features(self, texts: list[str | None]) -> list[list[float]]:
        lists = [letters(t) for t in texts]
        new = list(dict.fromkeys(w for ws in lists for w in ws if w not in self.known))
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(dict.fromkeys(w for ws in lists for w in ws))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, differences(part, self.codes, self.ratios).tolist(), strict=True))
        get = self.known.__getitem__
        return [statistics(np.fromiter(map(get, ws), float, len(ws)), np.fromiter(map(get, set(ws)), float), sum(map(len, ws)) + len(ws)) for ws in lists]


@dataclass
class Model:
    """Log ratios by code, as a table and, if they are few enough, as a broadcast pair of arrays; and the curve over the features."""

    table: DataFrame
    arrays: object | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


def document_features(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the features of every document, by the broadcast arrays or, if the model is too large, by blocks that are joined with it."""
    if model.arrays is not None:
        arrays = model.arrays

        def run(batches: Iterator[list[list]]) -> Iterator[list]:
            known = _Words(*arrays.value)
            for ids, texts in batches:
                yield [ids, known.features(texts)]

        return map_rows(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), ["id", "text"], "id long, x array<double>", run)
    work = Scratch(docs.sparkSession, "toxic-blocks")
    texts = work.write(in_blocks(docs, F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), BLOCK).drop("extra"), "texts")

    def wanted(batches: Iterator[list[list]]) -> Iterator[list]:
        block, words = None, {}

        def rows() -> list:
            _, symbols, at, size, _ = grams(list(words))
            codes = np.unique(np.concatenate([hashes(symbols, at, size, 0), hashes(symbols, at - 1, size - 1, 1)]))
            return [np.full(len(codes), block), codes]

        for blocks, own in batches:
            for b, text in zip(blocks, own, strict=True):
                if b != block:
                    if words:
                        yield rows()
                    block, words = b, {}
                words.update(dict.fromkeys(letters(text)))
        if words:
            yield rows()

    def scored(own: pa.Table, found: pa.Table) -> dict:
        order = np.argsort(found["code"].to_numpy())
        known = _Words(found["code"].to_numpy()[order], found["ratio"].to_numpy()[order])
        x = [f for part in own.to_batches(max_chunksize=256) for f in known.features(part["text"].to_pylist())]
        return {"id": own["id"].combine_chunks(), "x": x}

    needed = map_rows(work.read("texts"), ["block", "text"], "block long, code long", wanted).join(model.table, "code")
    return by_block(texts, needed, "id long, x array<double>", scored)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """The models and the curve, learned from labelled rows whose crc32 of the id as text is not 2 modulo 4.

    Remainders 0 and 1 give the counts, all of them; remainder 3 the curve, at most ``sample`` rows, so that no document is compared by
    its own counts.  Rows with a null id or label are not used; an id with several labels or texts counts with each pair.  Without
    labelled rows every score is 0.5, with one class it is near that class.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "toxic")
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    part = F.pmod(F.crc32(F.col("k").cast("string")), F.lit(4))
    rows = labels.filter(key.isNotNull() & label.isNotNull()).select(key.alias("k"), label.cast("int").alias("y")).distinct().withColumn("part", part)
    learn = work.write(rows.filter(F.col("part") != 2), "labels")
    few = learn.count() <= small
    marked = learn.filter("part < 2").drop("part")
    counted = work.write(count_grams(docs, id_col, text_col, F.broadcast(marked) if few else marked), "grams")
    table = work.write(_coded(log_ratios(counted, work)), "model")
    work.drop("grams", "contexts", "shared")
    arrays = None
    if table.count() <= small:
        got = table.toArrow()
        order = np.argsort(got["code"].to_numpy())
        arrays = spark.sparkContext.broadcast((got["code"].to_numpy()[order], got["ratio"].to_numpy()[order].astype(np.float32)))
    model = Model(table, arrays)
    curve = learn.filter("part = 3").drop("part")
    chosen = curve.filter(lowest("k", sample, curve.count())).orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    texts = docs.select(key.alias("k"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi")
    got = document_features(texts, model, "k", "text").withColumnRenamed("id", "k").join(F.broadcast(chosen), "k").select("k", "x", "y").orderBy("k", "y").limit(2 * sample).collect()
    x, y = np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], float)
    model.mean, model.scale, model.weights = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1)
    if len(x):
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) per row of docs; null, empty and wordless texts have the score of features that are all 0.

    Whole texts are compared, repeated rows alike; a long text is one row's memory; an empty table gives an empty one.  A score that
    equals the threshold passes it.  Other columns are ignored.
    """
    curve = Model(None, None, model.mean, model.scale, model.weights)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, x in batches:
            score = curve.score(np.array(x).reshape(len(x), len(FEATURES)))
            yield [ids, score.tolist(), (score >= threshold).astype(int).tolist()]

    found = document_features(docs, model, id_col, text_col)
    return map_rows(found, ["id", "x"], "id long, score double, predicted int", run).withColumnRenamed("id", id_col)
