"""Phrase mining against counting every phrase."""

import collections
import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, n long, f long, rank long, block long"


def texts():
    rng = random.Random(11)
    made = []
    for _ in range(120):
        words = [rng.choice(["new", "York", "CITY", "hall", "a", "b", "é", "x y z", "to be or not"]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";;", "\xa0"]) for _ in range(rng.randint(0, 60))]
        made.append(("".join(words), rng.choice(["en", "de", None])))
    return [*made, (None, "en"), ("", None), ("  \n", "fr"), ("a " * 20_000, "en"), ("new york " * 40, "fr"), ("...", "en"), made[0], made[0]]


def plain(rows, least, top, share):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        gone = {p[i : i + k] for p, c in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= share * count[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("block", "least", "top"), [(1, 3, 50), (700, 2, 2_000), (10_000_000, 30, 2_000)])
def test_against_counting_every_phrase(spark, monkeypatch, block, least, top):
    from crosspanel.llm import phrases
    from crosspanel.llm.phrases import collocations

    if block == 700:
        monkeypatch.setattr(phrases, "SMALL", 0)  # too many to broadcast
    rows = texts()
    docs = spark.createDataFrame([(i, t, g, 1, 1, 1, 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, least, top, block=block).collect())
    want = plain(rows, least, top, 80)
    assert got == want and want


def test_empty_table(spark):
    from crosspanel.llm.phrases import collocations

    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, 1, 1, 1, 1)], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    """The score of counts whose product with 2,000,000 passes 64 bits."""
    big = 9 * 10**15
    row = spark.sql(f"SELECT (CAST(2000000 AS DECIMAL(7, 0)) * CAST({big}L AS DECIMAL(20, 0))) div (CAST({2 * big}L AS DECIMAL(20, 0)) + {big}L) AS s").first()
    assert row.s == 2_000_000 * big // (3 * big)


def test_a_written_table_leaves_no_shuffle(spark):
    """The shuffles behind a table of Scratch go with the query that wrote it, whoever still holds the frames it was made of."""
    from crosspanel.llm._rows import CLEANUP, Scratch

    dropped = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    made = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count().repartition(3, "count")
    before = dropped().shuffleStatuses().size()
    written = Scratch(spark, "test").write(made, "made")
    assert dropped().shuffleStatuses().size() <= before
    assert sorted(r["count"] for r in written.collect()) == [142, 143, 143, 143, 143, 143, 143] and spark.conf.get(CLEANUP, "false") == "false"


def test_a_block_sends_a_row_for_each_part(spark):
    """No table and no join has a row for each block and phrase: a block sends its phrases of a part as one row, and gets one back."""
    from crosspanel.llm._rows import Scratch
    from crosspanel.llm.phrases import frequent_phrases

    sizes = {}

    class Counted(Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            if "block" in out.columns:
                sizes[name] = out.filter("block is not null").count()
            return out

    rng = random.Random(5)
    docs = spark.createDataFrame([(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4_000)), "en") for _ in range(8)], "text string, lang string").repartition(4)
    _, words, phrases = frequent_phrases(docs, Counted(spark, "test"), 2, block=10_000_000)
    assert phrases[1].count() > 5_000 and words.count() == 26
    assert sizes and max(sizes.values()) <= 4 * 13  # four blocks; twelve parts and the lists


def test_numbers_are_spread_one_to_one():
    import numpy as np

    from crosspanel.llm.phrases import Numbers

    for n in (1, 2, 3, 70, 1000, 40_000, 3_000_000_001, 2**32):
        numbers = Numbers(n, 37)
        first, last = (np.random.default_rng(k).integers(0, n, 5_000) for k in (1, 2))
        first[:2], last[:2] = (0, n - 1), (0, n - 1)
        made = numbers.of(first, last)
        back = numbers.pairs(made)
        assert (back[0] == first).all() and (back[1] == last).all()
        part = numbers.part(np.sort(made)).astype(int)
        assert (np.diff(part) >= 0).all() and 0 <= part[0] and part[-1] < 37
        if n >= 1000:
            assert np.bincount(part, minlength=37).max() < 300  # 135 each
    with pytest.raises(ValueError, match="pass 64 bits"):
        Numbers(2**32 + 1, 37)


def test_columns_and_lists_survive_packing():
    import numpy as np

    from crosspanel.llm.phrases import packed, packed_lists, unpacked, unpacked_lists

    columns = [np.array([], np.int64), np.array([0, 255, 256]), np.array([2**64 - 1, 0], np.uint64), np.array([1], np.uint8)]
    assert [c.tolist() for c in unpacked(packed(*columns))] == [c.tolist() for c in columns]
    lists = np.array([3, 2**31, 2**32 - 1]), np.array([2, 1, 3]), np.array([7, 2**31 - 1, 0, 1, 5, 6])
    assert [c.tolist() for c in unpacked_lists(packed_lists(*lists))] == [c.tolist() for c in lists]


@pytest.mark.parametrize("top", [1, 7, 40])
def test_ties_at_the_end_go_by_phrase(spark, top):
    """More phrases of one score and count than are kept, over all shares, and piece ends without words between words."""
    from crosspanel.llm.phrases import collocations

    rows = [(" ".join(f"w{i}a w{i}b....... " for i in range(90)), "en")] * 4 + [("x y,,; z. x y z\x00 x y z\x00", "de\nx")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, 3, top, block=1).collect())
    assert got == plain(rows, 3, top, 80) and len(got) > top
