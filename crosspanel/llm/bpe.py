"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pairs wait in buckets, one per merge rank, that hold positions of a linked list of parts.  A bitmap with one bit per rank, under
a smaller bitmap that says which of its words are not empty, gives the next rank by find-first-set in two steps.  Entries whose pair
has changed meanwhile are skipped when they come up.  A piece of n bytes costs O(n log n) at worst (the log only orders equal
ranks), so a pre-token of megabytes is no special case.

Null texts encode to no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows, parts

#: Bytes of each of a task's two caches, about; a full one starts anew, which costs time only.
CACHE = 96_000_000
#: Bytes of an entry besides its ids and characters: a place in a dictionary and the heads of two objects.
ENTRY = 220
#: Longer pieces and chunks are not kept.
CACHE_CHARS = 64
#: Bytes of the pieces that share a queue (a longer piece has its own), and characters that are chunks at a time: the more pieces meet in
#: a bucket, the fewer calls of numpy.
AT_ONCE, CHARS = 2_000_000, 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file with lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """Rank of the token that two neighbouring tokens make together, for arrays of token pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values(), default=0) + 1
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left * self.size + right] = rank
        self.table = found
        self.bits = max(8, (4 * len(found)).bit_length())
        keys = np.fromiter(found, np.int64, len(found))
        values = np.fromiter(found.values(), np.int64, len(found))
        # Open addressing, filled by all keys that are still without a place at once.
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        at, self.probes = self.slot(keys), 0
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = self.keys[at] != keys
            at, keys, values = (at[rest] + 1) & ((1 << self.bits) - 1), keys[rest], values[rest]
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two make no token."""
        keys = left * self.size + right
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


class Encoder:
    """Encodes pieces (pre-tokens), many in one queue: they share the buckets but no links, so each merges as it would alone.

    The bitmap has two levels: words of 256 ranks, and one summary with a bit per word.  Both are plain integers, in which
    ``x & -x`` isolates the first set bit.  A finished call leaves the queue empty, so nothing is cleared.  A large bucket is merged
    in numpy, but for pairs whose order matters.
    """

    LARGE = 48

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.pairs = Pairs(ranks)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
        self.packed = np.arange(self.pairs.size, dtype=np.int32).tobytes()
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions whose rank is not -1 go to their buckets."""
        good = ranks >= 0
        ranks, positions = ranks[good], positions[good]
        order = np.argsort(ranks, kind="stable")
        first, at = np.unique(ranks[order], return_index=True)
        positions, at = positions[order].tolist(), [*at.tolist(), len(order)]
        for k, r in enumerate(first.tolist()):
            if r in self.buckets:
                self.buckets[r] += positions[at[k] : at[k + 1]]
            else:
                self.buckets[r] = positions[at[k] : at[k + 1]]
                self.low[r >> 8] |= 1 << (r & 255)
                self.top |= 1 << (r >> 8)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its bucket, which leaves the queue."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.low[w]
        r = (w << 8) + (word & -word).bit_length() - 1
        self.low[w] = word = word & (word - 1)
        if not word:
            self.top &= self.top - 1
        return r, self.buckets.pop(r)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(pieces)]

    def encode_packed(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as int32 bytes.  A piece that is a token is that token, whatever its parts would merge to."""
        known = [self.ranks.get(x) for x in pieces]
        rest = [x for x, r in zip(pieces, known, strict=True) if r is None]
        n = sum(map(len, rest))
        token = np.append(self.bytes[np.frombuffer(b"".join(rest), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        starts = np.zeros(n + 2, bool)
        starts[0] = starts[n] = True
        starts[np.cumsum([len(x) for x in rest], dtype=np.int64)] = True
        piece = np.cumsum(starts)
        pair = np.full(n + 1, -1)  # the rank wanted for the part at i and the next one of its piece
        inner = np.flatnonzero(~starts[1:n]) if n > 1 else np.zeros(0, np.int64)
        pair[inner] = self.pairs.ranks(token[inner], token[inner + 1])
        self.push(pair[inner], inner)
        state = tuple(memoryview(x) for x in (token, after, before, starts, pair))
        while self.top:
            rank, bucket = self.pop()
            if len(bucket) >= self.LARGE:
                bucket = self._merge(rank, bucket, token, after, before, starts, pair, piece)
            self._merge_each(rank, bucket, *state)
        heads = np.flatnonzero(starts[:n])
        alive = np.zeros(n + 1, bool)
        at = heads
        while len(at):
            alive[at] = True
            at = after[at]
            at = at[~starts[at]]
        where = np.flatnonzero(alive)
        packed, cut = token[where].astype(np.int32).tobytes(), [*(4 * np.searchsorted(where, heads)).tolist(), 4 * len(where)]
        found = (packed[cut[k] : cut[k + 1]] for k in range(len(heads)))
        return [self.packed[4 * r : 4 * r + 4] if r is not None else next(found) if x else b"" for x, r in zip(pieces, known, strict=True)]

    def _merge(self, rank: int, bucket: list[int], token, after, before, starts, pair, piece) -> list[int]:
        """Merges pairs of the bucket at once, and returns those that must go one by one: pairs that touch or follow one another, and all
        of a piece where a merge asks for a lower rank."""
        i = np.sort(np.array(bucket))
        i = i[pair[i] == rank]  # the others are stale: their pairs have changed
        if not len(i):
            return []
        k = after[after[i]]
        meets = (k[:-1] >= i[1:]) & (piece[i[:-1]] == piece[i[1:]])
        apart = ~(np.append(meets, False) | np.append(False, meets))
        inside, left = ~starts[k], ~starts[i]
        ahead, behind = np.full(len(i), -1), np.full(len(i), -1)
        ahead[inside] = self.pairs.ranks(np.full(int(inside.sum()), rank), token[k[inside]])
        behind[left] = self.pairs.ranks(token[before[i[left]]], np.full(int(left.sum()), rank))
        lower = ((ahead >= 0) & (ahead < rank)) | ((behind >= 0) & (behind < rank))
        if lower.any():
            apart &= ~np.isin(piece[i], piece[i[lower]])
        one_by_one = i[~apart].tolist()
        i, k, inside, left, ahead, behind = (x[apart] for x in (i, k, inside, left, ahead, behind))
        pair[after[i]] = -1
        token[i], after[i], pair[i] = rank, k, ahead
        before[k[inside]] = i[inside]
        m = before[i[left]]
        pair[m] = behind[left]
        self.push(np.concatenate([ahead, behind[left]]), np.concatenate([i, m]))
        return one_by_one

    def _merge_each(self, rank: int, bucket: list[int], token, after, before, starts, pair) -> None:
        """One pair after another, from the left; a lower rank that turns up goes first, and the rest of the bucket waits."""
        buckets, low, size, rank_of = self.buckets, self.low, self.pairs.size, self.pairs.table.get
        bucket.sort()
        for done, i in enumerate(bucket, 1):
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[j]
            token[i], after[i], pair[j], pair[i] = rank, k, -1, -1
            lower = False
            for a, b in ((i, k), (before[i], i)):
                if starts[b]:
                    continue
                if b == k:
                    before[k] = i
                r = pair[a] = rank_of(token[a] * size + token[b], -1)
                if r >= 0:
                    lower |= r < rank
                    if r in buckets:
                        buckets[r].append(a)
                    else:
                        buckets[r] = [a]
                        low[r >> 8] |= 1 << (r & 255)
                        self.top |= 1 << (r >> 8)
            if lower and done < len(bucket):
                buckets[rank] = bucket[done:]
                low[rank >> 8] |= 1 << (rank & 255)
                self.top |= 1 << (rank >> 8)
                return


#: The characters that the pattern language's \\s stands for.
WHITE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with the one space before it, or white space up to that: no match of PATTERN spans two of these.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class Chunks:
    """Ids of whole texts by way of their chunks.  Frequent chunks and pieces are kept in two caches of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: re.Pattern | None) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.cut = chunk.findall if chunk else lambda text: [text]
        self.encoder = Encoder(ranks)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = [0, 0]

    def learn(self, parts: list[str]) -> None:
        """Adds the parts to chunks."""
        if self.held[1] > CACHE:
            self.pieces.clear()
            self.held[1] = 0
        found = list(map(self.find, parts))
        new = list(set().union(*found).difference(self.pieces))
        data = [p.encode("utf-8", "replace") for p in new]
        for i, j in runs(np.fromiter(map(len, data), np.int64, len(data)), AT_ONCE):
            self.pieces.update(zip(new[i:j], self.encoder.encode_packed(data[i:j]), strict=True))
        get = self.pieces.__getitem__
        self.chunks.update(zip(parts, [get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for ps in found], strict=True))
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.pieces[p]
            else:
                self.held[1] += ENTRY + 5 * len(p)

    def packed(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of each list of chunks as int32 bytes."""
        missing = list(set().union(*parts).difference(self.chunks))
        if self.held[0] > CACHE:
            self.chunks.clear()
            self.held[0] = 0
            missing = list(set().union(*parts))
        self.learn(missing)
        out = [b"".join(map(self.chunks.__getitem__, ps)) for ps in parts]
        for x in missing:
            if len(x) > CACHE_CHARS:
                del self.chunks[x]
            else:
                self.held[0] += ENTRY + 5 * len(x)
        return out


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of neighbours whose sizes add up to at most so much; what is larger by itself is a run of its own."""
    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + most, "right")))
        yield i, j
        i = j


def id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: re.Pattern | None = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids) per row of docs; each match of ``pattern`` is encoded by itself, special tokens are ordinary text.

    ``chunk`` cuts a text where no match of the pattern reaches across, so that the ids of frequent chunks can be kept; it suits
    patterns that bind at most one space to what follows.  None: the whole text is one chunk.

    The ranks go to the executors as one broadcast: a vocabulary's size is fixed, whatever the data.  Null or empty text: no ids.
    Rows are encoded one by one, so copies, repeated and null ids do no harm; a task holds about CHARS characters at a time and one
    whole text.  An empty table gives an empty result.  Ranks must hold all single bytes, else a KeyError is raised.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        encoder = Chunks(shared.value, pattern, chunk)
        for ids, texts in batches:
            for some, parts in batched(ids, texts, encoder.cut):
                yield [some, id_lists(encoder.packed(parts))]

    return map_rows(docs, [id_col, text_col], f"{id_col} long, ids array<int>", run)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: re.Pattern | None = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, ids_sha256, decoded_sha256, ids_text_equal) per row of docs: the digests of the ids and of the bytes that
    they decode to, and whether those are the text.  Encoding and decoding are one pass, so that the ids stay in the task that made
    them.  Nulls, copies, long texts and empty tables are as in encode_documents."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        encoder, tokens = Chunks(shared.value, pattern, chunk), token_bytes(shared.value)
        decimal = [b"%d" % i for i in range(len(tokens))].__getitem__
        for ids, texts in batches:
            for some, parts in batched(ids, texts, encoder.cut):
                packed = encoder.packed(parts)
                digests = [hashlib.sha256(b",".join(map(decimal, memoryview(x).cast("i")))).hexdigest() for x in packed]
                decoded = decode_lists(id_lists(packed), tokens).to_pylist()
                equal = [d == "".join(ps).encode("utf-8", "replace") for d, ps in zip(decoded, parts, strict=True)]
                yield [some, [len(x) // 4 for x in packed], digests, [hashlib.sha256(d).hexdigest() for d in decoded], equal]

    return map_rows(docs, [id_col, text_col], f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids_text_equal boolean", run)


def token_bytes(ranks: dict[bytes, int]) -> pa.BinaryArray:
    """The bytes of each id; ids without a token have none."""
    table = [b""] * (max(ranks.values(), default=0) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def batched(ids: list, texts: list[str | None], cut, chars: int = CHARS) -> Iterator[tuple[list, list[list[str]]]]:
    """Some rows at a time, of about so many characters together, with the chunks of each text."""
    some, parts, size = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        some.append(key)
        parts.append(cut(text) if text else [])
        size += len(text or "")
        if size >= chars:
            yield some, parts
            some, parts, size = [], [], 0
    if some:
        yield some, parts


def decode_lists(ids: pa.ListArray, tokens: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each list of ids: one buffer with all tokens' bytes, cut where the lists end."""
    data = tokens.take(ids.flatten())
    ends = np.asarray(ids.offsets) - ids.offsets[0].as_py()
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset + ends] if len(data) else np.zeros(len(ends), np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), data.buffers()[2] or pa.py_buffer(b"")])


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id, n_tokens, ids_sha256, decoded) per row: the bytes that the ids stand for.  Null ids: none.

    The ids' digest is taken on the way, so that the ids need not be joined to the bytes again.  Rows are decoded one by one, repeated
    ones too; lists of any length are one row's memory.  An empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(shared.value)
        for batch in batches:
            for part in parts(batch):
                key, count, digest, ids = part.columns
                yield pa.RecordBatch.from_arrays([key, count, digest, decode_lists(ids, tokens)], names=[id_col, "n_tokens", "ids_sha256", "decoded"])

    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    ready = encoded.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), ids.alias("ids"))
    return ready.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded binary")
