"""Substring dedup with difference-cover anchors.

Positions modulo PERIOD that lie in a difference cover carry anchors: hashes of the next ANCHOR words.  For any two starts i and j
there is a shift d below PERIOD that brings both to a cover position, and a window of WINDOW words from i still holds the anchor at
i + d.  So equal windows share an aligned anchor.  Windows around anchors that occur once need no second look; the others are
extended to whole windows, whose 128-bit hashes decide: two rolling hashes, each over its own 64-bit hash of the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._repeats import Rolling, anchors, combined, finish, joined, keyed, lists, merged, repeated, slices
from crosspanel.llm._rows import map_rows, table

WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21.
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a text that are words at a time.
BYTES = 1_000_000
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_IS_COVER = np.isin(np.arange(PERIOD), COVER)


def word_hashes(text: str) -> np.ndarray:
    """Two independent 64-bit hashes for each word of a text, which is cut at white space if it is long."""
    from xxhash import xxh3_128_digest

    data, at, out = text.encode("utf-8", "replace"), 0, []
    while at < len(data):
        end = min(len(data), at + BYTES)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(np.frombuffer(b"".join(map(xxh3_128_digest, data[at:end].split())), np.uint64).reshape(-1, 2))
        at = end
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of the words of several texts one after another; text, first word and place of the first word of each part)."""
    words = [word_hashes(t) for t in texts]
    for group in joined([len(w) for w in words], WINDOW):
        own, base, stop = (np.array(x, np.int64) for x in zip(*group, strict=True))
        yield np.concatenate([words[k][a:b] for k, a, b in group]), own, base, np.cumsum(stop - base) - (stop - base)


def _anchors():
    rolling = Rolling(0x9E3779B97F4A7C15)

    def find(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        for words, own, base, begin in parts(texts):
            h = rolling.windows(rolling.prefix(words[:, 0]), ANCHOR)
            at = np.arange(len(h))
            part = np.searchsorted(begin, at, "right") - 1
            length = np.diff(np.append(begin, len(words)))
            place = at - begin[part] + base[part]
            good = _IS_COVER[place % PERIOD] & (at - begin[part] + ANCHOR <= length[part]) & (length[part] >= WINDOW)
            part, at, place = part[good], at[good], place[good]
            # Where a text is cut, the parts overlap by a window less one: each anchor counts once, in the part that holds it first.
            new = (base[part] == 0) | (place - base[part] >= WINDOW - ANCHOR)
            yield own[part][new], h[at][new], place[new], np.zeros(int(new.sum()), bool)

    return find


def _windows(batches: Iterator[list[list]]) -> Iterator[list]:
    """Both hashes of each window that holds a repeated anchor."""
    one, two = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)
    for keys, texts, found in batches:
        for i, j in slices([len(t) for t in texts], 2_000_000):
            out: list[tuple] = []
            near = [np.array(f, np.int64) for f in found[i:j]]
            for words, own, base, begin in parts(texts[i:j]):
                stop = np.append(begin[1:], len(words))
                change = np.zeros(len(words) + 1, np.int64)
                for k, b, at, end in zip(own.tolist(), base.tolist(), begin.tolist(), stop.tolist(), strict=True):
                    last = end - at - WINDOW  # the part's last window
                    place = near[k] - b
                    a, z = np.maximum(place - PERIOD + 1, 0), np.minimum(place, last) + 1
                    some = a < z
                    np.add.at(change, at + a[some], 1)
                    np.add.at(change, at + z[some], -1)
                start = np.flatnonzero(np.cumsum(change) > 0)
                if len(start):
                    part = np.searchsorted(begin, start, "right") - 1
                    h1, h2 = (r.windows(r.prefix(words[:, c]), WINDOW)[start] for c, r in enumerate((one, two)))
                    out.append((h1, h2, own[part], start - begin[part] + base[part]))
            if out:
                h1, h2, own, start = (np.concatenate([x[k] for x in out]) for k in range(4))
                yield combined(h1, h2, np.array(keys[i:j], np.int64)[own], start, np.zeros(len(start), bool))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, n_removed, n_spans, kept_sha256, kept) per row of docs: every word covered by a window whose words also
    start anywhere else is removed; kept holds the other words, joined by one space, as UTF-8.

    Null and empty texts have no words.  Copies, even rows that are the same in id and text, repeat one another: all of them lose
    their windows.  Null ids are as good as others.  Windows are judged on the input.  Long texts are walked through in segments.  An
    empty table gives an empty result.  Other columns of docs are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    found = lists(anchors(rows, _anchors, "anchors"))
    windows = map_rows(rows.join(found, "key"), ["key", "text", "at"], "h1 long, h2 long, key long, pos int, n int", _windows)
    ranges = table(_joined(repeated(windows)), "windows")
    return finish(rows, ranges, WINDOW, _words, id_col, "words")


def _words(text: str) -> tuple[int, Callable[[list[tuple[int, int]]], bytes]]:
    data = text.encode("utf-8", "replace")
    space = _SPACE[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])[: len(data)])
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])[: len(data)]) + 1
    return len(starts), lambda spans: b" ".join([b" ".join(data[starts[a] : ends[b - 1]].split()) for a, b in spans])


def _joined(found: DataFrame) -> DataFrame:
    """Positions (key, pos) as ranges (key, start, stop) of neighbours."""
    own = found.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("at"))

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for keys, lists_ in batches:
            out: tuple[list, list, list] = ([], [], [])
            for key, at in zip(keys, lists_, strict=True):
                at = np.array(at, np.int64)
                starts, stops = merged(at, at + 1)
                out[0].extend([key] * len(starts))
                out[1].extend(starts.tolist())
                out[2].extend(stops.tolist())
            yield list(out)

    return map_rows(own, ["key", "at"], "key long, start int, stop int", run)
