"""Suffix-array dedup: a byte goes if a string of WIDTH bytes that covers it also starts earlier.

Every window of WIDTH bytes is dealt to a shard by the least hash of the GRAM-byte strings in it, so equal windows meet, and
neighbours with the same least hash travel as one string.  Least hashes that occur once are left out before any text is shuffled.  A
shard's distinct strings are joined; their suffix array gives the Burrows-Wheeler transform, on which intervals are extended
backwards breadth-first: the extensions of the intervals of common prefixes of length l mark where neighbouring suffixes share l
bytes only.  The search stops at WIDTH bytes; neighbours still unmarked then share a window.

A least hash with very many different strings (what surrounds a passage that a third of all documents hold) is no shard of its own:
its strings are cut by where their windows hold the gram, and what all windows of a piece have in common names the shard.  At the
finest cut that is the whole window, so all strings of a shard are equal, and each batch sends one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._repeats import CROWD, Rolling, anchors, finish, joined, keyed, lists, merged, slices
from crosspanel.llm._rows import map_rows, table

WIDTH, GRAM, SEED = 100, 24, 8
#: Windows of WIDTH bytes that hold a given gram.
SPAN = WIDTH - GRAM + 1
#: Bytes of one transform.  A shard with more bytes of distinct strings is cut finer, and its pieces are dealt out again.
BLOCK = 1_500_000
#: Windows of one string: a longer run of one least hash (a periodic text) is cut.
LONGEST = 4096
#: Pieces that a gram's windows are cut into: a few, then one for each window.
FEW = 32
#: Crowded grams that are cut before the first shuffle, at most; the others are cut after it.
CROWDS = 100_000
_LAST = np.iinfo(np.int64).max
_ROLL = 0x9E3779B97F4A7C15


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Strings:
    """Cuts texts into runs of windows with the same least hash."""

    def __init__(self) -> None:
        self.rolling = Rolling(_ROLL)

    def runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Batches of runs (text, least hash, first window, number of windows, whether the gram occurs again near by)."""
        for group in joined([len(t) for t in texts], WIDTH):
            data = np.frombuffer(b"".join([texts[k][a:b] for k, a, b in group]), np.uint8)
            own, base, stop = (np.array(x, np.int64) for x in zip(*group, strict=True))
            begin = np.cumsum(stop - base) - (stop - base)
            grams = self.rolling.windows(self.rolling.prefix(data), GRAM)
            m = least(grams, SPAN)
            if not len(m):
                continue
            change = np.zeros(len(m) + 1, np.int32)
            some = stop - base >= WIDTH
            change[begin[some]] += 1
            change[(begin + stop - base)[some] - WIDTH + 1] -= 1
            valid = np.cumsum(change[:-1]) > 0
            m[~valid] = 0
            new = valid & np.concatenate([[True], (m[1:] != m[:-1]) | ~valid[:-1]])
            new[begin[some]] = True
            start, end = np.flatnonzero(new), np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True))
            # Grams that are the least of a window: as large as the greatest least hash of the windows around them.
            pad = np.zeros(SPAN - 1, np.uint64)
            at = np.flatnonzero(grams == ~least(~np.concatenate([pad, m, pad]), SPAN))
            at = at[np.lexsort((at, grams[at]))]
            # At a distance of SPAN the second takes over where the first leaves the window, so the run goes on.
            near = np.unique(grams[at][1:][(grams[at][1:] == grams[at][:-1]) & (np.diff(at) <= SPAN)])
            part = np.searchsorted(begin, start, "right") - 1
            yield own[part], m[start], start - begin[part] + base[part], end - start + 1, np.isin(m[start], near)


def _anchors():
    strings = Strings()

    def find(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        for own, m, start, _, near in strings.runs([t.encode("utf-8", "replace") for t in texts]):
            yield own, m, start, near

    return find


def hashed(data: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def finer(data: bytes, n: int, at: int, pieces: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, first window, windows, place of the gram in the piece) of the pieces of a string whose gram is at ``at``.

    A window that starts o bytes before the gram goes to piece o * pieces // SPAN.  All windows of a piece hold the bytes from its
    least o before the gram to those that its greatest o leaves behind it: these name the shard, so equal windows meet.
    """
    for piece in range(min(at, SPAN - 1) * pieces // SPAN, max(at - n + 1, 0) * pieces // SPAN - 1, -1):
        low, high = -(-piece * SPAN // pieces), min(SPAN - 1, -(-(piece + 1) * SPAN // pieces) - 1)
        first, last = max(0, at - high), min(n - 1, at - low)
        if first <= last:
            yield hashed(b"%d:" % piece + data[at - low : at + WIDTH - high]), first, last - first + 1, at - first


def cut(rows: Iterable[tuple], rolling: Rolling) -> Iterator[tuple]:
    """The pieces of rows (m, at, near, id, key, start, n, data) as such rows.

    at says how far a string is cut: the place of its gram if into FEW pieces, -1 if not at all, -2 if into single windows.
    """
    for m, at, _, id_, key, start, n, data in rows:
        if at == -2:
            yield m, at, False, id_, key, start, n, data
            continue
        if at >= 0:
            yield from ((h, -2, False, id_, key, start + a, k, data[a : a + k + WIDTH - 1]) for h, a, k, _ in finer(data, n, at, SPAN))
            continue
        grams = rolling.windows(rolling.prefix(np.frombuffer(data, np.uint8)), GRAM)
        # A window's gram is the first in it with the least hash; from one gram to the next the windows form a string.
        begin = 0
        for p in np.flatnonzero(grams.view(np.int64) == m).tolist():
            if begin < n and p >= begin:
                some = min(n, p + 1) - begin
                for h, a, k, place in finer(data[begin : begin + some + WIDTH - 1], some, p - begin, FEW):
                    yield h, place, False, id_, key, start + begin + a, k, data[begin + a : begin + a + k + WIDTH - 1]
                begin += some


class Kept:
    """The distinct strings of a batch or a shard, each with the row that starts earliest; the others' windows are removed."""

    def __init__(self) -> None:
        self.rows: dict[bytes, tuple] = {}
        self.bytes = 0

    def add(self, row: tuple) -> tuple | None:
        """The row whose windows go, if there is one.  Rows that are the same in id, key and start count once."""
        data = row[7]
        old = self.rows.get(data)
        if old is None:
            self.rows[data] = row
            self.bytes += len(data) + 1
            return None
        if old[3:6] > row[3:6]:
            self.rows[data], row, old = row, old, row
        return row if old[3:6] != row[3:6] else None


COLUMNS = "m long, at int, near boolean, id long, key long, start int, n int, data binary"


def columns(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 8


def gone(removed: list[tuple]) -> list[tuple]:
    """Rows without bytes for the windows that are removed, neighbours as one; they are dealt out by their place."""
    by_key: dict[tuple, list] = {}
    for r in removed:
        by_key.setdefault((r[3], r[4]), []).append((r[5], r[5] + r[6]))
    out = []
    for (id_, key), ranges in by_key.items():
        ranges = np.array(sorted(ranges), np.int64)
        for a, b in zip(*(x.tolist() for x in merged(ranges[:, 0], ranges[:, 1])), strict=True):
            out.append((((key * 31 + a) & 0x7FFFFFFFFFFFFFFF), -1, False, id_, key, a, b - a, None))
    return out


def _strings(crowded: np.ndarray):
    """Rows of COLUMNS: the runs with a repeated least hash, those of a crowded one in pieces.

    Of equal strings in a batch only the earliest is sent with its bytes; the windows of the others are removed, whatever comes.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        strings = Strings()
        for keys, ids, texts, found in batches:
            for i, j in slices([len(t) for t in texts], 4_000_000):
                kept, removed = Kept(), []
                data = [t.encode("utf-8", "replace") for t in texts[i:j]]
                wanted = found[i:j]
                sizes = np.array([len(t) + 1 for t in data], np.int64)
                ahead = np.cumsum(sizes) - sizes
                places = np.concatenate([np.array(w, np.int64) + a for w, a in zip(wanted, ahead.tolist(), strict=True)])
                for own, m, start, n, near in strings.runs(data):
                    good = np.isin(ahead[own] + start, places)
                    m = m.view(np.int64)
                    split = np.isin(m, crowded)
                    values = (x[good].tolist() for x in (own, m, start, n, near, split))
                    for k, h, s, size, again, many in zip(*values, strict=True):
                        id_ = _LAST if ids[i + k] is None else ids[i + k]
                        key, text = keys[i + k], data[k]
                        for a in range(s, s + size, LONGEST):
                            w = min(LONGEST, s + size - a)
                            row = (h, -1, again, id_, key, a, w, text[a : a + w + WIDTH - 1])
                            for own_row in cut([row], strings.rolling) if many else (row,):
                                if (less := kept.add(own_row)) is not None:
                                    removed.append(less)
                yield columns([*kept.rows.values(), *gone(removed)])

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, by prefix doubling that only sorts what is still tied."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(SEED, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # symbols have up to nine bits, so seven fit
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 7
    while width < depth:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            break
        own = order[tied]
        after = rank[np.minimum(own + width, n)]
        by = np.argsort(rank[own] * (n + 1) + after + 1)
        own, after = own[by], after[by]
        order[tied] = own
        head = rank[own]
        split = np.concatenate([[True], (head[1:] != head[:-1]) | (after[1:] != after[:-1])])
        new[tied] = split
        rank[own] = tied[np.flatnonzero(split)][np.cumsum(split) - 1]
        width *= 2
    return order


def unequal_neighbours(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """mark[i]: suffixes order[i - 1] and order[i] share fewer than ``width`` symbols.  0 is the separator.

    Level by level: the queue holds intervals of strings of length l whose right end was first marked at l.  Within an interval, the
    last row of each symbol of the transform gives the right end of that symbol's extension and the first row its left end.
    """
    n = len(text)
    bwt = text[order - 1]
    rows = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[rows] = np.arange(n)
    again = bwt[rows][1:] == bwt[rows][:-1]
    following, previous = np.full(n, n), np.full(n, -1)
    following[rows[:-1][again]] = rows[1:][again]
    previous[rows[1:][again]] = rows[:-1][again]
    # The first levels at once: neighbours that differ in their first SEED symbols, and the intervals of all strings of that length.
    padded = np.concatenate([text, np.zeros(SEED, text.dtype)])
    mark = np.zeros(n + 1, bool)
    mark[0] = mark[n] = True
    for k in range(SEED):
        column = padded[order + k]
        mark[1:n] |= column[1:] != column[:-1]
    left = np.flatnonzero(mark[:n])
    right = np.append(left[1:], n)
    for _ in range(SEED, width):
        if not len(left):
            break
        found_left, found_right = [], []
        sizes = right - left
        for i, j in [(0, len(sizes))] if sizes.sum() <= 1_000_000 else slices(sizes.tolist(), 1_000_000):
            size = right[i:j] - left[i:j]
            at = np.arange(size.sum()) + np.repeat(left[i:j] - np.cumsum(size) + size, size)
            ok = bwt[at] > 0
            found_left.append(lf[at[ok & (previous[at] < np.repeat(left[i:j], size))]])
            found_right.append(lf[at[ok & (following[at] >= np.repeat(right[i:j], size))]] + 1)
        left, right = np.sort(np.concatenate(found_left)), np.sort(np.concatenate(found_right))
        new = ~mark[right]
        left, right = left[new], right[new]
        mark[right] = True
    return mark


def later_windows(strings: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(key, start, stop) of the windows of ``strings`` (id, key, start, windows, bytes) that also start earlier in one of them."""
    text = np.concatenate([x for *_, data in strings for x in (np.frombuffer(data, np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16))])
    order = suffix_array(text, WIDTH)
    mark = unequal_neighbours(text, order, WIDTH)
    lengths = np.array([len(s[4]) + 1 for s in strings])
    begin = np.cumsum(lengths) - lengths
    which = np.repeat(np.arange(len(strings)), lengths)
    offset = np.arange(len(text)) - begin[which]
    ids, keys, starts, counts = (np.array([s[k] for s in strings], np.int64) for k in range(4))
    group = np.cumsum(mark[: len(text)])
    valid = offset[order] < counts[which[order]]
    at, group = order[valid], group[valid]
    # Only groups of two or more can lose a window.
    alone = np.concatenate([[True], group[1:] != group[:-1]]) & np.concatenate([group[1:] != group[:-1], [True]])
    at, group = at[~alone], group[~alone]
    if not len(at):
        return
    own = which[at]
    where = starts[own] + offset[at]
    by = np.lexsort((where, keys[own], ids[own], group))
    at, own, where, group = at[by], own[by], where[by], group[by]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (ids[own] != ids[own][head]) | (keys[own] != keys[own][head]) | (where != where[head])
    away = np.sort(at[later])
    if len(away):
        cuts = np.flatnonzero((np.diff(away) > 1) | (np.diff(which[away]) > 0))
        heads, ends = away[np.concatenate([[0], cuts + 1])], away[np.concatenate([cuts, [len(away) - 1]])]
        s = which[heads]
        yield from zip(keys[s].tolist(), (starts[s] + offset[heads]).tolist(), (starts[s] + offset[ends] + 1).tolist(), strict=True)


def _resolve(most: int, batches: Iterator[list[list]]) -> Iterator[list]:
    """Rows of COLUMNS: ranges of windows that are removed, without bytes, or the pieces of strings of a shard of over ``most`` bytes."""
    block: list[tuple] = []
    shard, size = Kept(), 0
    pieces, copies = Kept(), []
    out: list[tuple] = []
    rolling = Rolling(_ROLL)
    last, deferred = None, False

    def flush() -> None:
        nonlocal size
        if block:
            out.extend((None, None, None, None, key, a, b - a, None) for key, a, b in later_windows([r[3:] for r in block]))
        block.clear()
        size = 0

    def defer(rows: Iterable[tuple]) -> None:
        """Cuts strings finer; of equal pieces one is sent on."""
        nonlocal pieces
        copies.extend(less for piece in cut(rows, rolling) if (less := pieces.add(piece)) is not None)
        if pieces.bytes > most or len(copies) > 50_000:
            send()

    def send() -> None:
        nonlocal pieces
        out.extend(pieces.rows.values())
        out.extend((None, None, None, None, *r[4:]) for r in gone(copies))
        copies.clear()
        pieces = Kept()

    def close() -> None:
        """The shard is whole and fits into a block.  A single string without a second gram repeats nothing."""
        nonlocal size, shard
        rows = shard.rows.values()
        if len(rows) > 1 or any(r[2] for r in rows):
            if size + shard.bytes > most:
                flush()
            block.extend(rows)
            size += shard.bytes
        shard = Kept()

    for batch in batches:
        for row in zip(*batch, strict=True):
            if row[0] != last:
                close()
                last, deferred = row[0], False
            if row[7] is None:
                out.append((None, None, None, None, *row[4:]))
            elif deferred and row[1] != -2:
                defer([row])
            else:
                if (less := shard.add(row)) is not None:
                    out.append((None, None, None, None, *less[4:7], None))
                if shard.bytes > most and any(r[1] != -2 for r in shard.rows.values()):
                    deferred = True
                    defer(shard.rows.values())
                    shard = Kept()
            if len(out) > 20_000:
                yield columns(out)
                out.clear()
    close()
    flush()
    send()
    yield columns(out)


def _dealt(strings: DataFrame, block: int) -> DataFrame:
    """The shards' strings meet, and what comes of them is written."""
    names = [f.split(" ")[0] for f in COLUMNS.split(", ")]
    ready = strings.repartition("m").sortWithinPartitions("m")
    return table(map_rows(ready, names, COLUMNS, partial(_resolve, block)), "suffixes")


def earlier_repeats(rows: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Ranges (key, start, stop) of the windows of ``keyed`` documents that also start earlier."""
    repeats = anchors(rows, _anchors, "grams", crowd)
    # A bounded number of grams, for speed only: crowded shards that are not among these are cut behind the shuffle.
    many = repeats.filter("pos < 0").orderBy("pos", "key").limit(CROWDS).select("key").collect()
    crowded = np.array([r.key for r in many], np.int64)
    strings = map_rows(rows.join(lists(repeats), "key"), ["key", "id", "text", "at"], COLUMNS, _strings(crowded))
    out, left = [], _dealt(strings, block)
    for _ in range(2):  # uncut, few pieces, single windows
        out.append(left.filter("m is null"))
        left = left.filter("m is not null")
        if left.isEmpty():
            break
        left = _dealt(left, block)
    else:
        out.append(left.filter("m is null"))
    ranges = out[0]
    for more in out[1:]:
        ranges = ranges.unionByName(more)
    return ranges.select("key", "start", (F.col("start") + F.col("n")).alias("stop"))


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of docs.

    Null and empty texts have no bytes.  Documents are ordered by id, nulls last.  Rows that share an id are documents in the order of
    a hash of id and text; rows that share both are one document, so they lose the same bytes and none to one another.  Of equal
    strings the earliest stays.  Windows are judged on the input.  Long texts are walked through in segments; a task holds one batch
    of rows and one block of strings.  An empty table gives an empty result.  Other columns of docs are ignored.  ``crowd`` and ``block``
    (occurrences of a gram, bytes of a transform) say when strings are cut finer; the result is the same.
    """
    rows = keyed(docs, id_col, text_col)
    return finish(rows, earlier_repeats(rows, crowd, block), WIDTH, _bytes, id_col, "bytes")


def _bytes(text: str) -> tuple[int, Callable[[list[tuple[int, int]]], bytes]]:
    data = text.encode("utf-8", "replace")
    return len(data), lambda spans: b"".join([data[a:b] for a, b in spans])
