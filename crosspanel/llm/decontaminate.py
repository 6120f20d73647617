"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage by k = RATE * n edits.  Cut into k + 1 pieces, one of them is in the passage
unchanged.  One Aho-Corasick automaton finds all pieces of all items in a text; around each hit Myers' bit-parallel algorithm gives
the least edit distance of the item to any substring there.

Texts and items are compared in lower case with single spaces between words.  Items are taken in blocks of bounded size, so the
broadcast does not grow with the benchmark; each block is held against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows

RATE = 0.05
#: Items of a block; characters below which an item drops no document.
BLOCK, SHORT = 5_000, 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    k = budget(item, rate) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' automaton of one item in integers of as many bits as the item has characters."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """(distance, end) of the substring of text with the least distance, the first such end."""
        full, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = full, 0, self.size
        best = (score, 0)
        get = self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | minus
            d0 = (((x & plus) + plus) ^ plus) | x
            hp = minus | (full & ~(d0 | plus))
            hm = plus & d0
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp, hm = hp << 1 & full, hm << 1 & full
            plus = hm | (full & ~(d0 | hp))
            minus = hp & d0
            if score < best[0]:
                best = (score, j)
        return best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE) -> None:
        import ahocorasick

        self.items = items
        self.rate = rate
        self.patterns: dict[int, Pattern] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for offset, piece in pieces(item, rate):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    @staticmethod
    def whole_words(text: str, item: str, start: int, stop: int) -> Iterator[int]:
        """Where the item occurs in text[start:stop] with no letter or digit beside it."""
        at = text.find(item, start, stop)
        while at >= 0:
            end = at + len(item)
            if not (at and text[at - 1].isalnum() and item[0].isalnum()) and not (text[end : end + 1].isalnum() and item[-1].isalnum()):
                yield at
            at = text.find(item, at + 1, stop)

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item number, distance, end in the normal text) of the best match of each item within its budget."""
        if not self.patterns and not len(self.automaton):
            return
        spans: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            start = end - size + 1
            for n, offset in places:
                length = len(self.items[n][1])
                k = budget(self.items[n][1], self.rate)
                a, b = max(0, start - offset - k), start - offset + length + k
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1] and own[-1][0] <= a:
                    own[-1][1] = max(own[-1][1], b)  # hits come in the order of their ends, so most windows just grow
                else:
                    own.append([a, b])
        for n, own in spans.items():
            item = self.items[n][1]
            k, best = budget(item, self.rate), None
            for a, b in own:
                at = text.find(item, a, b)
                if k == 0:
                    at = next((x for x in self.whole_words(text, item, a, b)), -1)
                    if at < 0:
                        continue
                d, end = (0, at + len(item)) if at >= 0 else (0, 0)
                if at < 0:
                    if n not in self.patterns:
                        self.patterns[n] = Pattern(item)
                    d, end = self.patterns[n].nearest(text[a:b])
                    end += a
                if d <= k and (best is None or (d, end) < best):
                    best = d, end
            if best is not None:
                yield n, *best


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (id, item, distance, end) for each document and item whose least distance is within the item's budget.

    ``end`` is where the match ends in the normal form of the text; of equal distances the first end counts.  Null and empty texts or
    items match nothing; repeated rows of either table give repeated rows; null ids stay null.  Items shorter than 1 / rate characters
    must occur unchanged and as whole words.  A long text is one row's memory.  Empty tables give an empty result.  Other columns are
    ignored.
    """
    return reduce(DataFrame.union, [_against(docs, own, rate, id_col, text_col, item_col) for own in _blocks(items, item_col, item_text_col)])


def _blocks(items: DataFrame, item_col: str, text_col: str, least: int = 1) -> Iterator[list[tuple[int | None, str]]]:
    """The items (id, normal text) in blocks of about BLOCK rows: a bounded part of the benchmark each, however large that is."""
    items = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text")).filter(F.length(F.trim("text")) > 0)
    blocks = max(1, -(-items.count() // BLOCK))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield [(r.item, t) for r in rows if len(t := normal(r.text)) >= least]


def _against(docs: DataFrame, items: list[tuple[int | None, str]], rate: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        matcher = Matcher(shared.value, rate)
        for ids, texts in batches:
            out = [(key, matcher.items[n][0], d, end) for key, text in zip(ids, texts, strict=True) if text for n, d, end in matcher.find(normal(text))]
            yield [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4

    return map_rows(docs, [id_col, text_col], f"{id_col} long, {item_col} long, distance int, end int", run)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = SHORT) -> DataFrame:
    """The rows of docs whose text matches no item of ``least`` characters or more; shorter ones occur by chance and drop nothing.

    Each row is judged by its own text and nothing is shuffled, so null ids, repeated rows and the names of columns do no harm.
    """
    for own in _blocks(items, item_col, item_text_col, least):
        docs = docs.filter(~_matches(docs, own, rate)(F.col(f"`{text_col}`")))
    return docs


def _matches(docs: DataFrame, items: list[tuple[int | None, str]], rate: float):
    """A function of a text column: whether the text matches one of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for texts in batches:
            yield pd.Series([bool(t) and next(matcher.find(normal(t)), None) is not None for t in texts], dtype=bool)

    return matches
