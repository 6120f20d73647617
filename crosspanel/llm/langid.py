"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; one linear classifier per bit sees hashed byte 2- and 3-grams of the whole text.  A text
gets the language whose codeword has the least loss, where each bit's logistic loss is weighted by that bit's accuracy in training.
A small gap to the next codeword flags the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows, table
from crosspanel.llm.gbdt import held_out, lowest

#: At most so many documents of each language are used for the fit, the first in the order of a hash of the id; fewer, but LEAST of each,
#: where these would be more than ROWS.  Every language is learned.
PER_LANGUAGE, LEAST, ROWS = 500, 8, 20_000
WIDTH, MAX_BITS, STEPS, RATE, DECAY = 2048, 31, 150, 4.0, 1e-4
AMBIGUOUS = 0.6
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether any character is alphabetic (str.isalpha)."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def grams(text: str | None) -> np.ndarray:
    """Square roots of the hashed 2- and 3-gram shares: a unit vector per kind.  Zeros for texts of fewer than two bytes."""
    b = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503)
    three = two[:-1] * np.uint32(31) + b[2:] * np.uint32(2246822519)
    half = WIDTH // 2
    out = np.concatenate([np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(half - 1), minlength=half) / max(1, len(h)) for h in (two, three)])
    return np.sqrt(out).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: all distinct splits of the languages for few of them, else MAX_BITS seeded splits that separate all pairs."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        return np.array([[1 if (s >> i) & 1 == 0 else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)])
    rng, best = np.random.default_rng(0), None
    for _ in range(max(1, min(200, 8_000_000 // n**2))):
        code = rng.choice([-1, 1], (n, MAX_BITS + 2 * int(np.log2(n))))
        gap = min(int((code[i] != code[:i]).sum(1).min()) for i in range(1, n))
        if best is None or gap > best[0]:
            best = gap, code
    return best[1]


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its share of exp(-loss) for each row."""
        z = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -z) * self.trust) @ (self.code.T > 0) + (np.logaddexp(0, z) * self.trust) @ (self.code.T < 0)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), share.max(1) / share.sum(1)


def fit(x: np.ndarray, language: list[str]) -> Codes:
    """Full-batch logistic regression for all bits at once; languages weigh the same however many texts they have.  x is used up."""
    names = sorted(set(language))
    code = codewords(len(names))
    place = {v: i for i, v in enumerate(names)}
    own = np.array([place[v] for v in language])
    target = code[own].astype(np.float32)
    share = (1 / np.bincount(own, minlength=len(names)))[own][:, None] / len(names)
    center = x.mean(0)
    x -= center
    w, bias, moved = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1]), 0
    for _ in range(STEPS):
        grad = share * target / (1 + np.exp(np.clip(target * (x @ w + bias), -30, 30)))
        moved = 0.9 * moved + x.T @ grad - DECAY * w
        w += RATE * moved
        bias += RATE * grad.sum(0)
    right = (share * (np.sign(x @ w + bias) == target)).sum(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Codes(names, code, w.astype(np.float32), (bias - center @ w).astype(np.float32), trust / trust.mean())


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Codes | None:
    """Codes learned from rows with a language and a letter outside the held-out third; None if there are none.

    A bounded number of rows is read for each language: a threshold on the id's hash, set by the language's number of rows, cuts them
    where they are, then the first ``per_language`` by that hash are taken.  With many languages each gives fewer, so that the fit has
    some ROWS rows; no language is left out.  Rows with a null id, text or language are not used; rows that share an id are all used or
    none, twice as many as ids at most.
    """
    key, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    rows = docs.filter(key.isNotNull() & lang.isNotNull() & ~held_out(id_col, 3, 1)).select(key.alias("k"), lang.alias("lang"))
    counts = table(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = max(1, counts.count())
    per_language = max(LEAST, min(per_language, ROWS // languages))
    rows = rows.join(F.broadcast(counts), "lang").filter(lowest("k", per_language, F.col("n")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("k").distinct()
    chosen = docs.select(key.alias("k"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang")).filter("lang is not null").join(F.broadcast(rows), "k", "left_semi")

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts, langs in batches:
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            yield [[ids[i] for i in keep], [langs[i] for i in keep], [grams(texts[i]).tobytes() for i in keep]]

    got = map_rows(chosen, ["k", "text", "lang"], "k long, lang string, x binary", run).orderBy("k", "lang").limit(2 * per_language * languages).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(got), WIDTH).copy() if len(got) else None
    return fit(x, got["lang"].to_pylist()) if len(got) else None


def predict_languages(docs: DataFrame, codes: Codes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score, ambiguous) per row of docs; `und` with score 0 for null texts, texts without a letter, and all
    texts if nothing was learned.

    Of codewords with equal loss the first language by name is chosen.  Rows are judged one by one: copies get the same language, a
    long text is one row's memory, an empty table gives an empty result.  Other columns of docs are ignored.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            for i in range(0, len(ids), 512):
                some = texts[i : i + 512]
                known = [j for j, t in enumerate(some) if codes is not None and has_letter(t)]
                lang, score = ["und"] * len(some), [0.0] * len(some)
                if known:
                    best, share = codes.decode(np.stack([grams(some[j]) for j in known]))
                    for j, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                        lang[j], score[j] = codes.languages[b], float(s)
                yield [ids[i : i + 512], lang, score, [x != "und" and s < AMBIGUOUS for x, s in zip(lang, score, strict=True)]]

    return map_rows(docs, [id_col, text_col], f"{id_col} long, lang_pred string, score double, ambiguous boolean", run)
