"""Alignment of the tokens of two tokenizers, by distinct segments.

A text is cut before its runs of white space, where neither vocabulary can merge across: the byte-level pattern of A ends a match there,
and no piece of B holds the two characters side by side (``cutter`` verifies both from the files, and cuts nowhere else).  So the
tokens of a text are those of its segments in turn.

Texts lie in blocks.  A block asks for its distinct segments; what all blocks ask for meets by segment, is tokenised and aligned once,
and goes back, packed, to the blocks that asked, where documents are composed of it.  Link counts go the same way: a block sends each of its id
pairs once, with the number of its documents that hold it, and gets the pair's count back.  No word occurrence is ever shuffled.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import Scratch, by_block, in_blocks, map_rows

#: Characters of a block, and of the texts that are packed together.  A longer text is a block of its own.
BLOCK, PACK = 12_000_000, 1_000_000
#: White space before which a text may be cut.
SPACES = " \n\t"
_PLAIN = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: What B writes for a space.
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character of a byte-level vocabulary for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Cuts:
    """Where texts may be cut (None: nowhere)."""

    cut: re.Pattern | None
    odd: re.Pattern | None

    def segments(self, text: str) -> list[str]:
        """The text with a space before it, cut.  Where no character needs a second look, a plain pattern gives the same faster."""
        if not self.cut:
            return [f" {text}"]
        if not self.odd or self.odd.search(text):
            return self.cut.split(f" {text}")
        return _PLAIN.findall(f" {text}")


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers, the bytes of their tokens, the cuts, and a character that merges with nothing, with its number of B's tokens."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    cuts: Cuts
    prefix: str
    skip: int

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B.  B puts a space before what it encodes, so a segment's own first space is left to it; other segments
        stand behind a character that merges with nothing, whose tokens are taken off."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        lead = [len(s) > 1 and s[0] == " " for s in segments]
        b = self.b.encode([s[1:] if own else self.prefix + s for s, own in zip(segments, lead, strict=True)], num_threads=1)
        return a, [ids if own else ids[self.skip :] for ids, own in zip(b, lead, strict=True)]


def read_tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers of two vocabulary files: byte-level BPE as JSON (A) and a sentencepiece model (B)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    alphabet = byte_alphabet()
    size = max(a.get_vocab().values(), default=-1) + 1
    a_bytes = [b""] * size
    for token, i in a.get_vocab().items():
        a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    pieces = [b.id_to_piece(i) for i in range(len(b))]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    normal = [p for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, odd, prefix = cutter(spec, normal)
    return Tokenizers(a, b, a_bytes, b_bytes, Cuts(cut, odd), prefix, len(b.encode(prefix)) if prefix else 0)


def cutter(spec: dict, pieces: list[str]) -> tuple[re.Pattern | None, re.Pattern | None, str]:
    """Where a text may be cut, as a pattern of empty matches; a pattern of the characters for which it cuts less than before each of
    SPACES that follows another character (None: always); and a character that no piece holds.

    A cut lies before a white space and behind a character that is none.  A is sure if its file says that it normalises nothing and
    splits by the byte-level pattern, none of whose matches goes on from other characters into white space.  B is sure if no piece
    holds that character and the space next to each other, since a merge would make such a piece.  Where a file isn't sure, or every
    candidate for the single character is in a piece, there is no cut, and whole texts are the segments.
    """
    before = spec.get("pre_tokenizer") or {}
    sure = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    held = set("".join(pieces))
    alone = next((c for c in "\n\x01\x02" if c not in held), "")
    if not sure or not alone:
        return None, None, ""
    ways, odd = [], set(MARK)
    for space in SPACES:
        inner = MARK if space == " " else space
        pairs = {p[i - 1] for p in pieces for i in range(1, len(p)) if p[i] == inner and p[i - 1] != inner}
        if space == " " or MARK not in pairs:
            odd |= pairs
            ways.append(rf"(?<=[^\s\x1c-\x1f{MARK}{re.escape(''.join(sorted(pairs)))}])(?={space})")
    seen = re.compile(rf"[^\S{SPACES}]|[{re.escape(''.join(sorted(odd)))}]") if len(ways) == len(SPACES) else None
    return re.compile("|".join(ways)), seen, alone


def aligned(tools: Tokenizers, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all links of all segments in turn their ids as a * len(B) + b and steps, and the number of links of each segment.

    A link's step says what differs from the link before it: 0 another group, 1 the token of A, 2 that of B (where both change, a group
    ends).  A segment whose joined bytes differ from it under A or B has no link.  All segments are laid end to end, so that ends
    that agree and tokens that overlap are found by sorted searches.
    """
    a, b = tools.encode(segments)
    data = [s.encode() for s in segments]
    good = [b"".join(map(tools.a_bytes.__getitem__, x)) == d and b"".join(map(tools.b_bytes.__getitem__, y)) == d for x, y, d in zip(a, b, data, strict=True)]
    a, b = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (a, b))
    n_a = np.fromiter(map(len, a), np.int64, len(a))
    all_a, all_b = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
    if not len(all_a):
        return all_a, np.zeros(0, np.int8), n_a
    end_a, end_b = (np.cumsum([len(own[i]) for i in ids.tolist()]) for own, ids in ((tools.a_bytes, all_a), (tools.b_bytes, all_b)))
    # Token i of A overlaps those of B from the first that ends behind its start to the first that ends at or behind its end.
    first, last = np.searchsorted(end_b, np.concatenate([[0], end_a[:-1]]), "right"), np.searchsorted(end_b, end_a, "left")
    links = last - first + 1
    starts = np.cumsum(links) - links
    from_b = np.arange(int(links.sum())) - np.repeat(starts - first, links)
    steps = np.full(len(from_b), 2, np.int8)
    # A token of A begins a group if a token of B ended with the one before it; else the same token of B goes on.
    steps[starts] = np.concatenate([[0], np.where(end_b[last[:-1]] == end_a[:-1], 0, 1)])
    n = np.concatenate([[0], np.cumsum(links)])[np.concatenate([[0], np.cumsum(n_a)])]
    return np.repeat(all_a, links) * len(tools.b_bytes) + all_b[from_b], steps, np.diff(n)


def spelt(codes: np.ndarray, steps: np.ndarray, sizes: np.ndarray, b_size: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each segment the number of A's tokens, of groups, and the groups as text, such as 1,2|3;4|5."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    new = steps == 0
    sides = []
    for ids, fresh in ((codes // b_size, steps != 2), (codes % b_size, steps != 1)):
        at = np.flatnonzero(fresh)
        text = list(map(str, ids[at].tolist()))
        cuts = np.append(np.flatnonzero(new[at]), len(at)).tolist()
        sides.append([",".join(text[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    groups = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
    n_a, n_groups = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (steps != 2, new))
    return np.diff(n_a), np.diff(n_groups), [";".join(groups[i:j]) for i, j in zip(n_groups[:-1].tolist(), n_groups[1:].tolist(), strict=True)]


def read_links(text: str, steps: np.ndarray, b_size: int) -> np.ndarray:
    """The linked ids, as a * len(B) + b, of groups that ``spelt`` wrote (segments joined by spaces), from the links' steps."""
    data = np.frombuffer(f"{text} ".encode(), np.uint8)
    digit = data >= 48
    digit &= data < 58
    last = np.flatnonzero(digit[:-1] & ~digit[1:])
    value, own = np.zeros(len(last), np.int64), np.ones(len(last), bool)
    for k in range(int(np.diff(np.flatnonzero(~digit), prepend=-1).max(initial=0))):  # as many as the longest number has digits
        at = last - k
        own &= (at >= 0) & digit[np.maximum(at, 0)]
        value += np.where(own, (data[np.maximum(at, 0)].astype(np.int64) - 48) * 10**k, 0)
    bar, end = np.cumsum(data == 124), np.cumsum(data == 59)
    closed = np.cumsum((data == 32) & np.concatenate([[False], digit[:-1]]))  # a space behind a group ends it too
    of_b = bar[last] > end[last] + closed[last]
    if not len(steps):
        return np.zeros(0, np.int64)
    return value[~of_b][np.cumsum(steps != 2) - 1] * b_size + value[of_b][np.cumsum(steps != 1) - 1]


def _pack(*parts: np.ndarray | str) -> bytes:
    """Arrays and texts in one compressed value; what is shuffled is mostly these."""
    return zstandard.compress(pickle.dumps([p if isinstance(p, str) else p.tobytes() for p in parts]), 3)


def _planes(values: np.ndarray) -> np.ndarray:
    """Numbers as int32 with the bytes of one place next to one another, which compresses better."""
    return np.ascontiguousarray(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _split(text: str, sizes: np.ndarray) -> list[str]:
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [text[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _packed_texts(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """(block, data): the ids and texts of about PACK characters of a block each."""
    rows = in_blocks(docs, F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), block)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        block, ids, texts, held = None, [], [], 0

        def row() -> list:
            known = np.array([i is not None for i in ids])
            return [[block], [_pack(np.array([i or 0 for i in ids], np.int64), known, np.array(list(map(len, texts)), np.int32), "".join(texts))]]

        for blocks, own, found in batches:
            for b, i, text in zip(blocks, own, found, strict=True):
                if ids and (b != block or held >= PACK):
                    yield row()
                    ids, texts, held = [], [], 0
                block, held = b, held + len(text)
                ids.append(i)
                texts.append(text)
        if ids:
            yield row()

    return map_rows(rows, ["block", "id", "text"], "block long, data binary", run)


def _texts(data: bytes) -> tuple[list[int | None], list[str]]:
    ids, known, sizes, text = pickle.loads(zstandard.decompress(data))
    ids = [i if ok else None for i, ok in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(known, bool).tolist(), strict=True)]
    return ids, _split(text, np.frombuffer(sizes, np.int32))


def _wanted(texts: DataFrame, cuts: Cuts) -> DataFrame:
    """(block, segment): the distinct segments of each block."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        block, held = None, {}
        for blocks, packs in batches:
            for own, data in zip(blocks, packs, strict=True):
                if own != block:
                    if held:
                        yield [[block] * len(held), list(held)]
                    block, held = own, {}
                for text in _texts(data)[1]:
                    if text:
                        held.update(dict.fromkeys(cuts.segments(text)))
        if held:
            yield [[block] * len(held), list(held)]

    return map_rows(texts, ["block", "data"], "block long, segment string", run)


def _aligned_rows(wanted: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignments of the rows (block, segment), which meet by segment and come sorted: equal ones follow one another and are aligned
    once.  What a batch has for a block is one row: the segments, what ``spelt`` says of them, and their links."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        tools = read_tokenizers(a_path, b_path)
        for blocks, segments in batches:
            place = {s: i for i, s in enumerate(dict.fromkeys(segments))}
            distinct = list(place)
            codes, steps, sizes = aligned(tools, distinct)
            n_a, n_groups, groups = spelt(codes, steps, sizes, len(tools.b_bytes))
            starts = np.cumsum(sizes) - sizes
            own, block = np.array([place[s] for s in segments], np.int64), np.array(blocks, np.int64)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                rows = own[part]
                n = sizes[rows]
                take = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                texts = [distinct[i] for i in rows.tolist()]
                counts = [np.array(list(map(len, texts)), np.int32), *(x[rows].astype(np.int32) for x in (sizes, n_a, n_groups))]
                yield [[int(block[part[0]])], [_pack(*counts, steps[take], "".join(texts), " ".join([groups[i] for i in rows.tolist()]))]]

    ready = wanted.repartition("segment").sortWithinPartitions("segment")
    return map_rows(ready, ["block", "segment"], "block long, data binary", run)


def _composed(cuts: Cuts, b_size: int):
    """A function from a block's texts and its aligned segments to rows of three kinds: 0, a document with the segments it has; 1, the
    block's links by segment; 2, an id pair and the number of the block's documents that hold it."""

    def run(texts: pa.Table, found: pa.Table) -> dict:
        place: dict[str, int] = {}
        groups: list[str] = []
        counts, own_pairs, own_codes = [], [], []
        for data in found["data"]:
            *own, steps, text, spelling = pickle.loads(zstandard.decompress(data.as_py()))
            sizes, *own = (np.frombuffer(x, np.int32) for x in own)
            place.update(zip(_split(text, sizes), range(len(place), len(place) + len(sizes)), strict=True))
            groups += spelling.split(" ")
            counts.append(own)
            linked, codes = np.unique(read_links(spelling, np.frombuffer(steps, np.int8), b_size), return_inverse=True)
            own_pairs.append(linked)
            own_codes.append(codes.astype(np.int32))
        n_links, n_a, n_groups = (np.concatenate(c).astype(np.int64) for c in zip(*counts, strict=True)) if counts else [np.zeros(0, np.int64)] * 3
        starts = np.concatenate([[0], np.cumsum(n_links)])
        # Links are held as numbers of pairs, which take half the room of pairs; no array of all links is sorted.
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *own_pairs]))
        codes = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(pairs, p).astype(np.int32)[c] for p, c in zip(own_pairs, own_codes, strict=True))])
        del counts, own_pairs, own_codes
        df = np.zeros(len(pairs), np.int64)
        out: list[tuple] = []
        for data in texts["data"]:
            for id_, text in zip(*_texts(data.as_py()), strict=True):
                own = np.fromiter(map(place.__getitem__, cuts.segments(text) if text else ()), np.int64)
                if not len(own) or not n_links[own].all():
                    out.append((id_, 0, 0, 0, 0, "", None))
                    continue
                digest = hashlib.sha256(";".join(map(groups.__getitem__, own.tolist())).encode()).hexdigest()
                a, g, n = int(n_a[own].sum()), int(n_groups[own].sum()), int(n_links[own].sum())
                at, times = np.unique(own, return_counts=True)
                size = n_links[at]
                df[np.unique(codes[np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())])] += 1
                out.append((id_, a, n + g - a, g, n, digest, _pack(_planes(np.diff(at, prepend=0)), _planes(times))))
        # A pair that only documents without tokens would hold has no document.
        held = np.flatnonzero(df)
        d, k = len(out), len(held)
        block = (texts if len(texts) else found)["block"][0].as_py()
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
        blank = [None] * (1 + k)
        return {
            "block": [block] * (d + 1 + k), "kind": [0] * d + [1] + [2] * k, "id": [*columns[0], *blank], "n_a": [*columns[1], *blank],
            "n_b": [*columns[2], *blank], "n_groups": [*columns[3], *blank], "n_links": [*columns[4], *blank],
            "groups_sha256": [*columns[5], *blank], "data": [*columns[6], _pack(pairs, codes, n_links.astype(np.int32)), *[None] * k],
            "pair": [*[None] * (d + 1), *pairs[held].tolist()], "df": [*[None] * (d + 1), *df[held].tolist()],
        }

    return run


_COMPOSED = "block long, kind int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, data binary, pair long, df long"


def _scored(rows: pa.Table, counts: pa.Table) -> dict:
    """The documents of a block with the counts of their links."""
    kind = rows["kind"].to_numpy()
    docs, one = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))

    known, codes, sizes = pickle.loads(zstandard.decompress(one["data"][0].as_py())) if len(one) else (b"", b"", b"")
    known, codes, sizes = np.frombuffer(known, np.int64), np.frombuffer(codes, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
    order = np.argsort(counts["pair"].to_numpy())
    pairs = counts["pair"].to_numpy()[order]
    values = np.stack([counts["n"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)], 1)
    sums = np.zeros((len(sizes) + 1, 2), np.int64)
    if len(pairs):
        # Segments of documents without tokens hold pairs that no document counts; nothing reads their sums.
        found = values[np.minimum(np.searchsorted(pairs, known), len(pairs) - 1)]
        ends = np.cumsum(sizes)
        for k in (0, 1):  # one after the other, since all links of the block are summed up
            total = np.concatenate([[0], np.cumsum(found[codes, k])])
            sums[:-1, k] = total[ends] - total[ends - sizes]
    best, total = [], []
    for data in docs["data"].to_pylist():
        steps, times = map(_from_planes, pickle.loads(zstandard.decompress(data)) if data else (b"", b""))
        own = times.astype(np.int64) @ sums[np.cumsum(steps)]
        total.append(int(own[0]))
        best.append(int(own[1]))
    same = {c: docs[c].combine_chunks() for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return same | {"n_best": best, "count_sum": total}


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: numbers of tokens, groups and links, the digest of the groups, and the counts of its links.

    A encodes a space and the text, B the text, before which it sets a space itself.  Offsets where tokens of both end cut them into
    groups; tokens whose bytes overlap are linked.  The count of an id pair is the number of rows of docs that hold it linked;
    n_best counts the links whose count is the highest that their A id has, ties included.

    Null and empty texts, and texts whose joined bytes differ from a space and the text (a U+2581 in it), have no tokens: zeros and an
    empty digest.  Rows with null or repeated ids, and repeated rows, stand for themselves and each count as a document.  A long text is
    a block of its own.  An empty table gives an empty one; columns of docs other than the two named are ignored.
    """
    work = Scratch(docs.sparkSession, "align")
    texts = work.write(_packed_texts(docs, id_col, text_col, block), "texts")
    tools = read_tokenizers(a_path, b_path)
    cuts, b_size = tools.cuts, len(tools.b_bytes)
    known = _aligned_rows(_wanted(work.read("texts"), cuts), a_path, b_path)
    rows = work.write(by_block(texts, known, _COMPOSED, _composed(cuts, b_size)), "composed")
    work.drop("texts")
    pairs = rows.filter("kind = 2").select("block", "pair", "df")
    counts = pairs.groupBy("pair").agg(F.sum("df").alias("n"))
    counts = work.write(counts.withColumn("a", F.expr(f"pair div {b_size}")), "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    ranked = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return by_block(work.read("composed").filter("kind < 2"), pairs.drop("df").join(ranked, "pair"), schema, _scored).withColumnRenamed("id", id_col)
