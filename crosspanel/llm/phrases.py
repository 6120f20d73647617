"""Phrases that are commoner than their parts, mined from vertical positional lists.

A block of texts keeps a list of positions for each of its words (``postings``).  Phrases of one length grow by one word where the list of
one meets the list of another that is moved back by a word: what meets is the longer phrase's list, and the length of a list is its exact
number of occurrences in the block.  Lists stay with their block.  Only their lengths go out, as packed columns of sorted numbers that are
dealt to parts by a spread of the phrase's number; a part sums them over the blocks and answers each block with a bit for each number it
sent and with the ids of the frequent ones (``_summed``).  A phrase's number is made of the ids of its first and its last words, so only
phrases that are frequent over all blocks, with a frequent end, are extended further.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm._rows import Scratch, map_rows

#: Characters of a block.  A longer text is a block of its own.
BLOCK = 8_000_000
#: Parts that sum up lengths: so many, and one more for so many characters.
PARTS, PART = 12, 32_000_000
#: Piece ends become a line feed and white space a space; A to Z become a to z.
_TABLE = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shares of a language that are ranked apart, and phrases that are broadcast at most to be spelt.
SALTS, SMALL = 64, 100_000


def placed(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and their positions: neighbours in a piece differ by one, words of different pieces by two."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    codes = np.frombuffer(data, np.uint8)
    ends = codes == 10
    gap = ends | (codes == 32)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(gap) else np.zeros(0, np.int64)
    return data.split(), np.arange(len(starts)) + np.cumsum(np.diff(np.cumsum(ends)[starts], prepend=0) > 0)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 as one compressed value: each in as many byte planes as its largest number takes."""
    out = [np.int64(len(columns)).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c).astype("<u8", copy=False)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        out += [np.array([len(c), width], "<i8").tobytes(), c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.compress(b"".join(out), 3)


def unpacked(data: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.decompress(data), [], 8
    for _ in range(int.from_bytes(data[:8], "little")):
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(full.view("<u8").ravel())
        at += 16 + n * width
    return out


def _gaps(numbers: np.ndarray) -> np.ndarray:
    """What ascending numbers add to the one before, the first to 0."""
    return np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))


def packed_lists(keys: np.ndarray, sizes: np.ndarray, pos: np.ndarray) -> bytes:
    """Positional lists as one value: ascending keys, lengths of the lists, and steps between positions, those back to the next list's
    start as 32-bit complements."""
    return packed(_gaps(keys), sizes, np.diff(pos.astype(np.int32), prepend=np.int32(0)).view(np.uint32))


def unpacked_lists(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, sizes, steps = unpacked(data)
    return np.cumsum(keys), sizes.astype(np.int64), np.cumsum(steps.astype(np.uint32), dtype=np.uint32).astype(np.int64)


def postings(docs: DataFrame, text_col: str, lang_col: str, block: int, parts: int) -> DataFrame:
    """(block, lists) with the positional lists of all words of a block, and (block, part, langs, words, counts): its words of a part, those
    of each language together, with their numbers of occurrences.  Words are numbered in the order of these rows."""
    rows = docs.select(F.coalesce(f"`{text_col}`", F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))

    def lists(number: int, words: dict[str, dict[bytes, int]], ids: list[np.ndarray], places: list[np.ndarray]) -> Iterator[list]:
        own = [w for known in words.values() for w in known]
        lang = np.repeat(np.arange(len(words)), [len(k) for k in words.values()])
        seen = np.fromiter((i for known in words.values() for i in known.values()), np.int64, len(own))
        part = np.fromiter((zlib.crc32(w, s) for name, known in words.items() for s in [zlib.crc32(name.encode("utf-8", "replace"))] for w in known), np.int64, len(own)) * parts >> 32
        order = np.lexsort((seen, lang, part))  # in a part, words stand in the order of languages and of first places
        rank = np.empty(len(own), np.int64)
        rank[seen[order]] = np.arange(len(own))
        flat, pos = rank[np.concatenate(ids)], np.concatenate(places)
        sizes = np.bincount(flat, minlength=len(own))
        by_word = np.sort(flat << 32 | pos)
        yield [[number], [packed_lists(np.arange(len(own)), sizes, by_word & 0xFFFFFFFF)], [None], [None], [None], [None]]
        for p, at in _slices(part[order], parts):
            held = zstandard.compress(b"\n".join([own[i] for i in order[at]]), 3)
            yield [[number], [None], [p], [list(words)], [held], [packed(np.bincount(lang[order[at]], minlength=len(words)), sizes[at])]]

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        from pyspark import TaskContext

        number, held, total, base = TaskContext.get().partitionId() << 32, 0, 0, 0
        words, ids, places = {}, [], []
        for texts, langs in batches:
            for text, lang in zip(texts, langs, strict=True):
                found, pos = placed(text)
                held += len(text)
                if found:
                    known = words.setdefault(lang, {})
                    for w in set(found).difference(known):
                        known[w] = total
                        total += 1
                    ids.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    places.append(pos + base)
                    base += int(pos[-1]) + 2
                if held >= block and ids:
                    yield from lists(number, words, ids, places)
                    number, held, total, base = number + 1, 0, 0, 0
                    words, ids, places = {}, [], []
        if ids:
            yield from lists(number, words, ids, places)

    return map_rows(rows, ["text", "lang"], "block long, lists binary, part int, langs array<string>, words binary, counts binary", run)


def _slices(part: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Each part that occurs and where its rows stand, in ascending parts."""
    ends = np.searchsorted(part, np.arange(parts + 1))
    return ((p, slice(i, j)) for p, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if i < j)


class Numbers:
    """Numbers of pairs of ids below ``n``, spread over 0 to 2 ** bits - 1 one to one, so that equal ranges of them are parts of like size."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, n: int, parts: int) -> None:
        self.n, self.parts, self.bits = n, parts, max(2, (n * n - 1).bit_length())
        if self.bits > 64:
            raise ValueError(f"{n} ids are too many: their pairs pass 64 bits")
        self.mask, self.shift = np.uint64((1 << self.bits) - 1), np.uint64((self.bits + 1) // 2)

    def _turned(self, x: np.ndarray, factor: int) -> np.ndarray:
        x = x * np.uint64(factor & int(self.mask)) & self.mask
        x ^= x >> self.shift  # undoes itself, since it moves by half the bits or more
        return x * np.uint64(factor & int(self.mask)) & self.mask

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self._turned(first.astype(np.uint64) * np.uint64(self.n) + last.astype(np.uint64), self.FACTOR)

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = self._turned(numbers, pow(self.FACTOR, -1, 1 << self.bits))
        return code // np.uint64(self.n), code % np.uint64(self.n)

    def part(self, numbers: np.ndarray) -> np.ndarray:
        """The part of each number; it ascends with the numbers."""
        top = numbers >> np.uint64(self.bits - 32) if self.bits > 32 else numbers << np.uint64(32 - self.bits)
        return top * np.uint64(self.parts) >> np.uint64(32)


def _table(schema: pa.Schema, **columns) -> pa.Table:
    """Rows with these columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _answer(hit: np.ndarray, found: np.ndarray) -> bytes:
    """Which of the phrases that a block sent are frequent, and their places among the frequent ones of the part."""
    return packed(np.array([len(hit)]), np.packbits(hit), found)


_COUNTED = pa.schema({"block": pa.int64(), "part": pa.int32(), "data": pa.binary(), "id": pa.int64(), "f": pa.int64(), "first": pa.int64(), "last": pa.int64(), "lang": pa.string(), "word": pa.string()})
_COUNTED_SQL = "block long, part int, data binary, id long, f long, first long, last long, lang string, word string"


def _words_summed(least: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """From a part's words of all blocks: the frequent ones (id, f, lang, word), answers (block, part, data), and the part's number of
    occurrences of each language (f, lang)."""

    def run(rows: pa.Table) -> pa.Table:
        part, blocks = rows["part"][0].as_py(), rows["block"].to_pylist()
        langs, held, counts = rows["langs"].to_pylist(), rows["words"], rows["counts"]

        def block(i: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
            words, (each, n), at = zstandard.decompress(held[i].as_py()).split(b"\n"), unpacked(counts[i].as_py()), 0
            for lang, k in zip(langs[i], each.tolist(), strict=True):
                if k:
                    yield lang, words[at : at + k], n[at : at + k]
                at += k

        total: dict[str, dict[bytes, int]] = {}
        for i in range(len(blocks)):
            for lang, words, n in block(i):
                known = total.setdefault(lang, {})
                for w, x in zip(words, n.tolist(), strict=True):
                    known[w] = known.get(w, 0) + x
        sums = {lang: sum(known.values()) for lang, known in total.items()}
        found = [(lang, w, f) for lang, known in total.items() for w, f in known.items() if f >= least]
        place: dict[str, dict[bytes, int]] = {lang: {} for lang in total}
        for i, (lang, w, _) in enumerate(found):
            place[lang][w] = i
        del total
        data = []
        for i in range(len(blocks)):
            own = np.concatenate([np.fromiter((place[lang].get(w, -1) for w in words), np.int64, len(words)) for lang, words, _ in block(i)])
            data.append(_answer(own >= 0, own[own >= 0]))
        return pa.concat_tables([
            _table(_COUNTED, block=blocks, part=[part] * len(blocks), data=data),
            _table(_COUNTED, id=[i * parts + part for i in range(len(found))], f=[f for _, _, f in found], lang=[x for x, _, _ in found], word=[w.decode("utf-8", "replace") for _, w, _ in found]),
            _table(_COUNTED, f=list(sums.values()), lang=list(sums)),
        ])

    return run


def _summed(least: int, numbers: Numbers) -> Callable[[pa.Table], pa.Table]:
    """From a part's phrases of all blocks: the frequent ones (id, f, first, last), and answers (block, part, data)."""

    def run(rows: pa.Table) -> pa.Table:
        part, blocks = rows["part"][0].as_py(), rows["block"].to_pylist()
        sent, counts = [], []
        for data in rows["data"]:
            first, gaps, n = unpacked(data.as_py())
            sent.append(np.cumsum(gaps) + first)
            counts.append(n)
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        f = np.add.reduceat(np.concatenate(counts)[order], starts)
        known, f = every[starts][f >= least], f[f >= least]
        data = []
        for own in sent:
            at = np.searchsorted(known, own)
            hit = np.zeros(len(own), bool)
            inside = at < len(known)
            hit[inside] = known[at[inside]] == own[inside]
            data.append(_answer(hit, _gaps(at[hit])))
        first, last = numbers.pairs(known)
        return pa.concat_tables([
            _table(_COUNTED, block=blocks, part=[part] * len(blocks), data=data),
            _table(_COUNTED, id=np.arange(len(known)) * numbers.parts + part, f=f.astype(np.int64), first=first.astype(np.int64), last=last.astype(np.int64)),
        ])

    return run


def extended(own: np.ndarray, pos: np.ndarray, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one length (own: their ids) at positions, met with those that start a word later: the number and position of each
    phrase that is a word longer, by position."""
    if not len(pos):
        return np.zeros(0, np.uint64), pos
    at = np.full(int(pos.max()) + 2, -1, np.int64)
    at[pos] = own
    start = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    return numbers.of(at[start], at[start + 1]), start


_GROWN = pa.schema({"block": pa.int64(), "lists": pa.binary(), "part": pa.int32(), "data": pa.binary()})
_GROWN_SQL = "block long, lists binary, part int, data binary"


def _grown(length: int, before: Numbers | None, numbers: Numbers) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From a block's lists and answers: the lists of its frequent phrases of ``length`` words (block, lists), and the numbers of occurrences
    of those that are a word longer (block, part, data).

    before are the numbers of phrases of ``length`` words, numbers those of the longer ones.
    """

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        block = state["block"][0].as_py()
        keys, sizes, pos = unpacked_lists(state["lists"][0].as_py())
        hit, ids = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        for part, data in sorted(zip(answers["part"].to_pylist(), answers["data"].to_pylist(), strict=True)):
            n, bits, found = unpacked(data)
            hit.append(np.unpackbits(bits.astype(np.uint8), count=int(n[0])).astype(bool))
            ids.append((found if before is None else np.cumsum(found)).astype(np.int64) * numbers.parts + part)
        hit, ids = np.concatenate(hit), np.concatenate(ids)
        if before is None:  # the lists are those of the phrases that were sent
            own = np.repeat(np.arange(len(hit)), sizes)
        else:
            sent, pos = extended(np.repeat(keys, sizes), pos, before)
            own = np.unique(sent, return_inverse=True)[1]
        keep = hit[own]
        own, pos = ids[np.cumsum(hit)[own[keep]] - 1], pos[keep]
        longer, start = extended(own, pos, numbers)
        sent, n = np.unique(longer, return_counts=True)
        cuts = [(p, at) for p, at in _slices(numbers.part(sent).astype(np.int64), numbers.parts)]
        out = [_table(_GROWN, block=[block] * len(cuts), part=[p for p, _ in cuts], data=[packed(sent[at][:1], _gaps(sent[at] - sent[at][0]), n[at]) for _, at in cuts])]
        if length < 3 and len(sent):
            met = np.zeros(int(pos.max()) + 2, bool)
            met[start] = met[start + 1] = True  # other positions have no part in longer phrases
            own, pos = own[met[pos]], pos[met[pos]]
            by_phrase = np.sort(own.astype(np.uint64) << np.uint64(32) | pos.astype(np.uint64))
            known, sizes = np.unique(by_phrase >> np.uint64(32), return_counts=True)
            out.append(_table(_GROWN, block=[block], lists=[packed_lists(known, sizes, by_phrase & np.uint64(0xFFFFFFFF))]))
        return pa.concat_tables(out)

    return run


def frequent_phrases(docs: DataFrame, work: Scratch, least: int, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(lang, n) for each language; (id, lang, word, f) of the frequent words; (id, first, last, f) of the frequent phrases of 2, 3 and 4
    words, first and last being the ids of all their words but the last, and but the first.  The results are tables of ``work``."""
    size = docs.agg(F.sum(F.length(f"`{text_col}`"))).first()[0] or 0
    parts = PARTS + size // PART
    grown = work.write(postings(docs, text_col, lang_col, block, parts), "grown0")
    sent = grown.filter("part is not null").select("part", "block", "langs", "words", "counts")
    counted = work.write(sent.groupBy("part").applyInArrow(_words_summed(least, parts), _COUNTED_SQL), "counted0")
    words = counted.filter("id is not null").select("id", "lang", "word", "f")
    totals = counted.filter("id is null and block is null").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases, before = [], None
    for length in (1, 2, 3):
        numbers = Numbers((counted.agg(F.max("id")).first()[0] or 0) + 1, parts)
        lists = grown.filter("lists is not null").select("block", "lists")
        answers = counted.filter("block is not null").select("block", "part", "data")
        found = lists.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_grown(length, before, numbers), _GROWN_SQL)
        grown = work.write(found, f"grown{length}")
        work.drop(f"grown{length - 1}")
        sent = grown.filter("part is not null").select("part", "block", "data")
        counted = work.write(sent.groupBy("part").applyInArrow(_summed(least, numbers), _COUNTED_SQL), f"counted{length}")
        phrases.append(counted.filter("id is not null").select("id", "first", "last", "f"))
        before = numbers
    work.drop("grown3")
    return totals, words, phrases


def _named(df: DataFrame, mark: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{mark}_{c}") for c in df.columns])


def _joined(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases with the columns of their first words (x_..) and of their last ones (y_..)."""
    return found.join(_named(shorter, "x"), F.col("first") == F.col("x_id")).join(_named(shorter, "y"), F.col("last") == F.col("y_id"))


def scored(work: Scratch, words: DataFrame, phrases: list[DataFrame], share: int) -> DataFrame:
    """(lang, ws, a, score, l, r) of all frequent phrases of 2 to 4 words that none a word longer, and so none longer still, stands for."""

    def weakest(*cuts: tuple[str, str]) -> list:
        score = [F.expr(f"(CAST(2000000 AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(20, 0))) div (CAST({x} AS DECIMAL(20, 0)) + {y})") for x, y in cuts]
        made = [F.struct(s.alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (s, (x, y)) in enumerate(zip(score, cuts, strict=True))]
        return [F.array_min(F.array(*made)).alias("m")]

    two = _joined(phrases[0], words.select("id", "lang", "f"))
    two = two.select("id", F.col("x_lang").alias("lang"), F.array("first", "last").alias("ws"), "f", F.col("x_f").alias("head"), F.col("y_f").alias("tail"), *weakest(("x_f", "y_f")))
    two = work.write(two, "two")
    three = _joined(phrases[1], two.drop("m"))
    ws = F.concat("x_ws", F.slice("y_ws", -1, 1)).alias("ws")
    three = three.select("id", "first", "last", F.col("x_lang").alias("lang"), ws, "f", F.col("x_head").alias("head"), F.col("y_tail").alias("tail"), F.col("x_f").alias("left"), F.col("y_f").alias("right"), *weakest(("x_head", "y_f"), ("x_f", "y_tail")))
    three = work.write(three, "three")
    four = _joined(phrases[2], three.select("id", "lang", "ws", "f", "head", "tail", "left", "right"))
    four = four.select("first", "last", F.col("x_lang").alias("lang"), ws, "f", *weakest(("x_head", "y_f"), ("x_left", "y_right"), ("x_f", "y_tail")))
    four = work.write(four, "four")
    out = four.select("lang", "ws", "f", "m")
    exact = [F.col(c).cast("decimal(20,0)") for c in ("longer", "f")]
    for short, long in ((two, phrases[1]), (three, phrases[2])):
        longer = long.select(F.explode(F.array("first", "last")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
        kept = short.join(longer, "id", "left").filter(F.col("longer").isNull() | (exact[0] * 100 < exact[1] * share))
        out = out.union(kept.select("lang", "ws", "f", "m"))
    # A phrase of four words has none longer; it stands in any case.
    return out.select("lang", "ws", F.col("f").alias("a"), "m.score", "m.l", "m.r")


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, share: int = 80, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """The best phrases of 2 to 4 words of each language: (lang, rank, phrase, a, l, r, n, score).

    A to Z are lower-cased; phrases lie within pieces, which end at . , ; : ! ? and line ends, and consist of runs of other characters
    than spaces and tabs.  a is the phrase's number of occurrences (``least`` or more), overlaps included; l and r are those of the two
    parts of its weakest cut (ties: the first); score is 2,000,000 a / (l + r), rounded down; n is the language's number of words.
    A phrase goes if a longer one that holds it occurs ``share`` % as often.  Each language's ``top`` rows by score, a (both falling)
    and phrase (bytes) are kept, since this is a report of the best.

    Null texts are empty; a null language is ``und``.  Ids play no part, and repeated rows count each time.  A long text is a block of
    its own.  An empty table gives an empty one.  Numbers are exact: products are decimals of 38 digits.
    """
    work = Scratch(docs.sparkSession, "phrases")
    totals, words, phrases = frequent_phrases(docs, work, least, text_col, lang_col, block)
    found = work.write(scored(work, words, phrases, share).withColumn("salt", F.pmod(F.xxhash64("ws"), F.lit(SALTS))), "scored")
    work.drop("two", "three", "four")
    # The best of each share first, so that no task sees a whole language.  Ties at the end are only spelt here: their order is that of words.
    least_kept, order = found.select("lang", "salt", "score", "a"), [F.col("score").desc(), F.col("a").desc()]
    for part in (["lang", "salt"], ["lang"]):
        least_kept = least_kept.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= top)
    least_kept = least_kept.filter(F.col("rank") == top).select("lang", F.struct("score", "a").alias("least"))
    asked = found.join(F.broadcast(least_kept), "lang", "left").filter(F.col("least").isNull() | (F.struct("score", "a") >= F.col("least"))).drop("least")
    asked = work.write(asked, "asked")
    spelt = asked.select("ws", F.posexplode("ws").alias("i", "id"))
    spelt = (F.broadcast(spelt) if asked.count() <= SMALL else spelt).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("ws").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = asked.join(spelt, "ws")
    for part in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
