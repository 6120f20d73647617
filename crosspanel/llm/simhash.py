"""SimHash near-duplicates with BK-trees.

Fingerprints that agree in enough blocks meet in a shard; each shard's fingerprints form a BK-tree, whose children are keyed by the
integer Hamming distance to the parent, and a search follows only the edges within the radius.  Trees are built where a shard's rows
meet and not sent to all executors: their size grows with the data, so no bound for a broadcast could be shown.  A shard reports
a link from each fingerprint to the least one of its own component there; links of all shards form the components.

Exact links (64 bits, radius 2): any two fingerprints within the radius agree in two of four blocks of 16 bits, so a shard is a pair
of blocks with its values.  A shard with more than CAP fingerprints is dealt out by three parts of its other 32 bits, of which one
agrees, and if need be once more: then 49 bits are equal and at most 2^15 fingerprints are left, whatever the data.

Similar texts (Jaccard similarity of five-word shingles of at least 0.8): such sets share a shingle among the rarest fifth of either,
so candidates meet at a shingle; longer fingerprints form the tree, and the similarity itself decides about each link.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm._rows import byte_words, map_rows, table
from crosspanel.llm.graph import components

RADIUS, CAP = 2, 4096
#: For similarity: bits, and the greatest Hamming distance that is looked at.  Of 512 bits, sets of shingles with a similarity of 0.8
#: differ in about 78, the smallest sets (four and five shingles) in 96, with a standard deviation of 9; unrelated ones in 256.
LONG, LONG_RADIUS, SEEDS = 512, 130, 42
#: Documents of the sample that finds common shingles, and the most of these.  Both only set the order of shingles.
SAMPLE, COMMON = 5_000, 50_000
#: Partners of one set that a task compares with it, and characters of the texts of a group that meet in a task.
PARTNERS, CHARS = 512, 20_000_000


def hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 with seed 42 of the space-joined shingles; fewer words than ``size``: of the whole sequence; none for no words."""
    from xxhash import xxh64_intdigest

    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    last = max(0, len(words) - size)
    starts = [0, *(e + 1 for e in ends[:last])]
    return [xxh64_intdigest(joined[s:e], SEEDS) for s, e in zip(starts, ends[min(size, len(words)) - 1 :], strict=True)]


def majority(h: np.ndarray) -> np.ndarray:
    """Little-endian bytes of the bits set in over half of the rows of uint64 words."""
    data = h.astype("<u8").view(np.uint8).reshape(len(h), -1)
    if len(h) < 200:
        ones = np.unpackbits(data, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(c, minlength=256) @ bits for c in data.T])
    return np.packbits(2 * ones > len(h), bitorder="little")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint as a signed number; zero without words."""
    h = hashes([w.lower() for w in byte_words(text)], size)
    return int(majority(np.array(h, np.uint64)[:, None]).view("<i8")[0]) if h else 0


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The set of the text's shingles as sorted hashes."""
    return np.unique(np.array(hashes([w.lower() for w in byte_words(text)], size), np.uint64))


def long_fingerprint(grams: np.ndarray, bits: int = LONG) -> bytes:
    """``bits`` bits from each shingle's hash and seeded mixes of it; all zero without shingles."""
    if not len(grams):
        return bytes(bits // 8)
    wide = grams[:, None] + np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        wide = (wide ^ (wide >> np.uint64(shift))) * np.uint64(by)
    return majority(wide ^ (wide >> np.uint64(31))).tobytes()


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                yield own
            if len(children) <= 2 * radius:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]


def stars(values: Iterable[int], radius: int, order=int) -> Iterator[tuple[int, int]]:
    """(value, least value of its component under ``order``) for the values of a shard that have a link there."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for near in tree.within(v, radius):
            a, b = root(v), root(near)
            if a != b:
                a, b = sorted((a, b), key=order)
                parent[b] = a
        tree.add(v)
    for v in parent:
        if (r := root(v)) != v:
            yield v, r


def _shards(batches: Iterator[list[list]]) -> Iterator[tuple[int, list]]:
    """(key, members) of rows that come sorted by key."""
    last, own = None, []
    for keys, *rest in batches:
        for key, row in zip(keys, zip(*rest, strict=True), strict=True):
            if key != last:
                if own:
                    yield last, own
                last, own = key, []
            own.append(row)
    if own:
        yield last, own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(sharded: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of rows (key, fp)."""
    mask = (1 << 64) - 1

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        out: tuple[list, list] = ([], [])
        for _, own in _shards(batches):
            for a, b in stars([x & mask for (x,) in own], radius, _signed):
                out[0].append(_signed(a))
                out[1].append(_signed(b))
            if len(out[0]) > 10_000:
                yield list(out)
                out = ([], [])
        yield list(out)

    return map_rows(sharded.repartition("key").sortWithinPartitions("key"), ["key", "fp"], "a long, b long", run)


def _field(low: int, bits: int):
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def _first_keys():
    """Six keys: the values of two blocks of 16 bits, and which two.  The key with two blocks of the fingerprint is 35 bits long."""
    return [(F.shiftleft(_field(16 * i, 16), 16) + _field(16 * j, 16) + F.lit(n << 32), n) for n, (i, j) in enumerate(combinations(range(4), 2))]


def _rest(pair: int) -> list[tuple[int, int]]:
    """Three parts (low bit, bits) of the bits outside a pair of blocks."""
    a, b = [16 * i for i in range(4) if i not in list(combinations(range(4), 2))[pair]]
    return [(a, 11), (b, 11), (a + 11, 5), (b + 11, 5)]


def close_links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` that differ in at most two bits."""

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of shards with 2 to cap members, and of larger ones."""
        n = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = table(rows.join(n, "key"), "simhash-shards")  # once, for both parts and the next level
        return rows.filter(F.col("n") <= cap).select("key", "fp"), rows.filter(F.col("n") > cap).drop("n")

    level = fps.select("fp", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(n).alias("pair")) for k, n in _first_keys()])).alias("s")).select("s.*", "fp")
    out, large = split(level)
    # The other 32 bits in three parts: two of 11 bits, and the 10 that are left.  Two fingerprints that differ in two of them agree in one.
    parts = F.lit(None)
    for pair in range(6):
        (a, n), (b, m), (c, k), (d, j) = _rest(pair)
        fields = [_field(a, n), _field(b, m), F.shiftleft(_field(c, k), j) + _field(d, j)]
        parts = F.when(F.col("pair") == pair, F.array(*fields)).otherwise(parts)
    deeper = large.select("key", "pair", "fp", F.posexplode(parts).alias("part", "value"))
    deeper = deeper.select(F.xxhash64("key", "part", "value").alias("key"), "pair", "part", "fp")
    small, large = split(deeper)
    out = out.unionByName(small)
    # What is left, 21 or 22 bits, in three parts again: the low and the middle 7 bits of the other two parts together, and the rest.
    rest = F.lit(None)
    for pair in range(6):
        (a, n), (b, m), (c, k), (d, j) = _rest(pair)
        fields = [_field(a, n), _field(b, m), F.shiftleft(_field(c, k), j) + _field(d, j)]
        sizes = [11, 11, 10]
        for part in range(3):
            x, y = [i for i in range(3) if i != part]
            left = F.shiftleft(fields[x], sizes[y]) + fields[y]
            three = F.array(left.bitwiseAND(F.lit(127)), F.shiftrightunsigned(left, 7).bitwiseAND(F.lit(127)), F.shiftrightunsigned(left, 14))
            rest = F.when((F.col("pair") == pair) & (F.col("part") == part), three).otherwise(rest)
    deepest = large.select("key", "fp", F.posexplode(rest).alias("p", "value")).select(F.xxhash64("key", "p", "value").alias("key"), "fp")
    return _links(out.unionByName(deepest), RADIUS).distinct()


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp long) per row of docs."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            yield [ids, [fingerprint(t, size) for t in texts]]

    return map_rows(docs, [id_col, text_col], f"{id_col} long, fp long", run)


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fingerprint, component_id) per row of docs; component_id is the least id of the component.

    Texts without words share the fingerprint zero and so a component.  Null ids are kept but never a component's id: a component
    without other ids has null.  Repeated rows and copies share a fingerprint, which is looked at once.  A long text is one row's
    memory.  An empty table gives an empty result.
    """
    prints = table(fingerprints(docs, size, id_col, text_col), "simhash")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    linked = components(close_links(least.select("fp"))).select(F.col("node").alias("fp"), "root")
    classes = least.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles (sorted, without repeats) have a Jaccard similarity of at least 0.8."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def prefix(grams: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first fifth and one more of a set's shingles, the rare before the ``common`` (sorted, with their counts ``often``).

    Sets with a similarity of 0.8 or more share four fifths of either, so whatever the order, they share a shingle of their prefixes.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        grams = grams[np.lexsort((grams, np.where(common[at] == grams, often[at], 0)))]
    return grams[: len(grams) // 5 + 1]


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of ``texts``, sorted, and how often they are there."""

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for (some,) in batches:
            yield [np.concatenate([shingles(t, size) for t in some]).view(np.int64)]

    every = max(1, texts.count() // SAMPLE)
    found = map_rows(texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0), ["text"], "gram long", run)
    top = found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 4").orderBy(F.desc("n"), "gram").limit(COMMON)
    top = table(top, "common").collect()
    common = np.array([r.gram for r in top], np.int64).view(np.uint64)
    by = np.argsort(common)
    return common[by], np.array([r.n for r in top], np.int64)[by]


def prefixes(texts: DataFrame, size: int) -> DataFrame:
    """One row (node, print, prefix array of shingles) per row of ``texts`` with a word."""
    common, often = common_shingles(texts, size)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for nodes, some in batches:
            sets = [(node, g) for node, t in zip(nodes, some, strict=True) if len(g := shingles(t, size))]
            yield [[n for n, _ in sets], [long_fingerprint(g) for _, g in sets], [prefix(g, common, often).view(np.int64) for _, g in sets]]

    return map_rows(texts, ["node", "text"], "node long, print binary, prefix array<long>", run)


def shared_shingles(sets: DataFrame) -> DataFrame:
    """Rows (key, node, n, least) of the shingles ``key`` in the prefixes of two or more sets: how many these are, and their least."""
    rows = sets.select(F.explode("prefix").alias("key"), "node")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    return rows.join(groups, "key")


def partners(rows: DataFrame, cap: int) -> DataFrame:
    """Pairs (a, b) of ``shared_shingles``: each set with the least of the shingle and with the one before it, in two orders.

    The orders are the same for all shingles, so most pairs of a group come up again and again and count once.  A shingle of more than
    ``cap`` sets is dealt into parts; the least set links them.
    """
    part = F.when(F.col("n") > cap, F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / cap))).otherwise(0)
    rows = rows.withColumn("part", part)
    before = [F.lag("node").over(Window.partitionBy("key", "part").orderBy(o)) for o in (F.col("node"), F.xxhash64("node"))]
    rows = rows.select("least", before[0].alias("one"), before[1].alias("two"), F.col("node").alias("b"))
    pairs = rows.select(F.explode(F.array("least", "one", "two")).alias("a"), "b").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nearest(pairs: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """For each b of pairs (a, b), the nearest a whose fingerprint lies within the radius."""
    both = pairs.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b")

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for a, b, x, y in batches:
            far = [(int.from_bytes(v) ^ int.from_bytes(w)).bit_count() for v, w in zip(x, y, strict=True)]
            ok = [i for i, d in enumerate(far) if d <= radius]
            yield [[c[i] for i in ok] for c in (a, b, far)]

    near = map_rows(both, ["a", "b", "x", "y"], "a long, b long, d long", run)
    return near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b")


def similar_pairs(pairs: DataFrame, texts: DataFrame, size: int, most: int = PARTNERS) -> DataFrame:
    """Those of pairs (a, b) whose similarity is at least 0.8.  The partners of one set are dealt to tasks of ``most`` each."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    ready = pairs.join(counts, "a").withColumn("shard", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / most))))
    hubs = ready.select("shard", F.lit(0).alias("role"), F.col("a").alias("node")).distinct()
    rows = hubs.union(ready.select("shard", F.lit(1).alias("role"), F.col("b").alias("node"))).join(texts, "node")

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        hub, own = None, np.zeros(0, np.uint64)
        for roles, nodes, some in batches:
            out: tuple[list, list] = ([], [])
            for role, node, text in zip(roles, nodes, some, strict=True):
                grams = shingles(text, size)
                if role == 0:
                    hub, own = node, grams
                elif similar(own, grams):
                    out[0].append(hub)
                    out[1].append(node)
            yield list(out)

    ready = rows.repartition("shard").sortWithinPartitions("shard", "role", "node")
    return map_rows(ready, ["role", "node", "text"], "a long, b long", run)


def dealt(rows: DataFrame, cap: int) -> DataFrame:
    """Rows (key, node, root, weight) with a ``shard`` of a weight of at most about ``cap``, so that any two rows of a key with
    different roots meet, and whether the row is outside the key's heaviest root (``minor``).

    A key that weighs more is cut into parts.  Rows of its heaviest root need not meet one another: each of their parts meets the parts
    of all other rows, and the latter's parts meet in pairs.  So what is sent grows with the rows outside the heaviest root.
    """
    counts = rows.groupBy("key", "root").agg(F.sum("weight").alias("c"))
    keys = counts.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("top")).filter(F.col("size") > F.col("top.c"))
    half = max(1, cap // 2)
    few, many = F.ceil((F.col("size") - F.col("top.c")) / half), F.ceil(F.col("top.c") / half)
    parts = keys.select("key", F.col("top.root").alias("top"), (F.col("size") <= cap).alias("whole"), few.alias("few"), many.alias("many"))
    rows = rows.join(parts, "key").withColumn("minor", F.col("root") != F.col("top"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many")))
    rows = rows.withColumn("part", part)

    def with_each(n: str, shard: Callable):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), shard)

    among = with_each("few", lambda i: F.xxhash64("key", F.lit("minor"), F.least("part", i), F.greatest("part", i)))
    across = with_each("many", lambda i: F.xxhash64("key", F.lit("major"), "part", i))
    back = with_each("few", lambda i: F.xxhash64("key", F.lit("major"), i, "part"))
    shards = F.when(F.col("whole"), F.array(F.xxhash64("key"))).when(F.col("minor"), F.concat(among, across)).otherwise(back)
    return rows.withColumn("shard", F.explode(shards)).drop("key", "top", "whole", "few", "many", "part", "weight")


def shard_links(rows: DataFrame, radius: int, cap: int, size: int | None) -> DataFrame:
    """Links (a, b) of rows (key, node, root, weight, print), and text if ``size`` is given.

    Roots are joined by all pairs of a key within the radius, whose similarity is at least 0.8 where size is given.  A pair whose roots
    are joined already is not looked at, and rows of a key's heaviest root only wait in the tree for the others.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for _, own in _shards(batches):
            tree, at, parent = BKTree(), defaultdict(list), {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            out: tuple[list, list] = ([], [])
            for minor, node, root, data, *text in own:
                v, grams = int.from_bytes(data, "little"), shingles(text[0], size) if text else None
                for near in tree.within(v, radius) if minor else ():
                    for other, its, its_grams in at[near]:
                        if (x := find(root)) != (y := find(its)) and (grams is None or similar(grams, its_grams)):
                            parent[max(x, y)] = min(x, y)
                            out[0].append(node)
                            out[1].append(other)
                tree.add(v)
                at[v].append((node, root, grams))
            yield list(out)

    names = ["shard", "minor", "node", "root", "print", *(["text"] if size is not None else [])]
    ready = dealt(rows, cap).repartition("shard").sortWithinPartitions("shard", "minor")
    return map_rows(ready, names, "a long, b long", run).distinct()


def similar_links(texts: DataFrame, size: int = 5, radius: int = LONG_RADIUS, cap: int = CAP, most: int = CHARS) -> DataFrame:
    """Links (a, b) of ``texts`` (node, text) whose components are those of all pairs with a similarity of at least 0.8.

    First each set's nearest partner at a shared shingle: where the similarity itself is 0.8 or more, they are linked.  That joins most
    groups in one step for each set.  Shingles whose sets are not in one group of candidates yet then get a tree, and the groups
    of candidates in which sets are still apart are compared, set by set.
    """
    sets = table(prefixes(texts, size), "prefixes")
    rows = table(shared_shingles(sets), "shingles")
    prints = sets.select("node", "print").join(rows.select("node").distinct(), "node", "left_semi")
    close = table(nearest(partners(rows, cap), prints, radius), "nearest")
    linked = table(similar_pairs(close, texts, size), "verified")
    # Candidates: what lies within the radius at a shared shingle.
    rooted = _rooted(rows.select("key", "node"), components(close)).withColumn("weight", F.lit(1))
    trees = table(shard_links(rooted.join(prints, "node"), radius, cap, None), "candidates")
    groups = components(close.union(trees)).withColumnRenamed("root", "key")
    left = _rooted(groups, components(linked)).join(prints, "node").join(texts, "node").withColumn("weight", F.length("text"))
    return linked.union(table(shard_links(left, radius, most, size), "verified"))


def _rooted(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (key, node, root) from rows (key, node): sets of keys with two roots or more in ``components``.

    The new key is the commonest root of the old one, so a group whose sets share many shingles comes up once and not for each.
    """
    rows = rows.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    apart = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    return rows.join(apart.select("key", F.col("top.root").alias("top")), "key").select(F.col("top").alias("key"), "node", "root").distinct()


def similar_groups(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, most: int = CHARS) -> DataFrame:
    """One row (id, group_id) per row of docs with an id: texts whose sets of shingles have a Jaccard similarity of at least 0.8 are
    linked, and group_id is the least id that can be reached.

    Texts without words, null ones too, form one group.  Rows with a null id are left out; rows that share an id are linked by it only
    if their texts are.  Copies of a text are looked at once.  A long text is one row's memory.  An empty table gives an empty result.
    ``cap`` and ``most`` (sets of a tree, characters of texts compared in a task) bound tasks; the result is the same.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    empty = text.rlike(r"^[\x20\x09-\x0D]*$")
    node = F.when(empty, F.xxhash64(F.lit(""))).otherwise(F.xxhash64(text))
    rows = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), node.alias("node"), F.when(~empty, text).alias("text"))
    texts = table(rows.select("node", "text").filter("text is not null").dropDuplicates(["node"]), "texts")
    linked = components(similar_links(texts, size, LONG_RADIUS, cap, most))
    classes = rows.groupBy("node").agg(F.min("id").alias("least")).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    found = rows.select("id", "node").join(classes.join(ids, "root").select("node", "group_id"), "node")
    return found.select(F.col("id").alias(id_col), "group_id")
