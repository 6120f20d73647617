"""The operators for training data against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, n int, fp string, record string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = [*base, None, "", "  \n\t ", base[3], base[3], "x" * 50_000, "ab " * 20_000, "é" * 300 + " " + base[5], "Und " * 400]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(8)]
    texts += [base[7] + " tail", "HEAD\n" + base[7], base[8].replace("w1 ", "changed ")]
    texts += ["mail a.b@c.example.com or +1 (521) 555-6210 from 10.0.0.300 and 10.0.0.3, card 4111 1111 1111 1111!"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "k", "i", 1, "f", "r") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, nulls everywhere."""
    text = prose(random.Random(1), 200)
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (3, "other " + text)]
    return spark.createDataFrame([(*r, None, None, None, None, None, None, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_substring_dedup(docs, odd, empty):
    from crosspanel.llm.substring import COVER, PERIOD, WINDOW, remove_repeats

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    got = rows(remove_repeats(docs))
    words = [[w.encode() for w in WORDS.findall(t or "")] for t in corpus()]
    count = collections.Counter(tuple(w[i : i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if count[tuple(w[k : k + WINDOW])] > 1:
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, bytes(got[i].kept)) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept), i
    out = remove_repeats(odd).collect()
    assert len(out) == 7 and sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 0, 0), (0, 200, 200), (1, 200, 200), (1, 200, 200), (2, 0, 0), (3, 0, 0), (3, 201, 200)]
    assert remove_repeats(empty).count() == 0


def test_suffix_array_dedup(docs, odd, empty):
    from crosspanel.llm.suffixes import WIDTH, remove_earlier

    got, seen = rows(remove_earlier(docs)), set()
    for i, t in enumerate(corpus()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - WIDTH + 1):
            s = data[k : k + WIDTH]
            if s in seen:
                gone[k : k + WIDTH] = b"\1" * WIDTH
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    out = remove_earlier(odd).collect()
    assert sorted((r.doc_id or 0, r.n_removed == 0) for r in out) == [(0, False), (0, True), (1, True), (1, True), (2, True), (3, False), (3, True)]
    assert remove_earlier(empty).count() == 0


def plain_removed(rows_):
    """Removed positions of each of (id, text bytes), which come in the order of documents."""
    seen, out = set(), []
    for _, data in rows_:
        away, own = set(), []
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                away.update(range(i, i + 100))
            seen.add(data[i : i + 100])
        out.append((len(away), hashlib.sha256(bytes(c for i, c in enumerate(data) if i not in away)).hexdigest()))
    return out


def test_suffix_periodic_texts(spark):
    from crosspanel.llm.suffixes import remove_earlier

    rng = random.Random(13)
    texts = ["".join(rng.choices("abcdefghijklmnop", k=period)) * (1 + 300 // period) for period in range(1, 261)]
    texts += [(part := "".join(rng.choices("abcdef", k=100 + k))) + "-" * k + part[k:] + part for k in range(90)]
    texts = [t * 3 if 100 < k < 261 else t for k, t in enumerate(texts)]
    want = plain_removed([(i, t.encode()) for i, t in enumerate(texts)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for crowd, block in ((20_000, 1_500_000), (3, 700)):
        got = rows(remove_earlier(df, crowd=crowd, block=block))
        assert [(got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == want, (crowd, block)


def test_suffix_fuzz_and_crowds(spark):
    """2,000 texts of shared passages, copies and noise; many share one passage with different surroundings."""
    from crosspanel.llm.suffixes import remove_earlier

    rng = random.Random(21)
    passages = ["".join(rng.choices("abcd é\n", k=rng.randint(60, 400))) for _ in range(25)]
    texts = []
    for _ in range(2000):
        parts = [rng.choice([passages[0], passages[0], *passages]) for _ in range(rng.randint(0, 2))]
        parts = [p[rng.randint(0, 8) : len(p) - rng.randint(0, 8)] for p in parts]
        texts.append("".join(x for p in parts for x in (p, "".join(rng.choices("abcd", k=rng.randint(0, 40))))) + "".join(rng.choices("ab", k=rng.randint(0, 30))))
    want = plain_removed([(i, t.encode()) for i, t in enumerate(texts)])
    assert sum(n > 0 for n, _ in want) > 1000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for crowd, block in ((20_000, 1_500_000), (50, 3_000), (10**9, 2_000)):
        got = rows(remove_earlier(df, crowd=crowd, block=block))
        assert [(got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == want, (crowd, block)


def test_suffix_rows_that_share_an_id(spark):
    """They are documents one after another, in an order by hash: one of two loses the whole head that they share."""
    from crosspanel.llm.suffixes import remove_earlier

    head = prose(random.Random(3), 700)
    df = spark.createDataFrame([(5, head + " tail one"), (5, head + " and another"), (None, head), (None, head + " x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_earlier(df).collect())
    assert [n for i, n in got if i] in ([0, len(head) + 1], [0, len(head) + 2]) and [n for i, n in got if not i][0] == len(head)


def test_long_texts_are_cut_into_segments(spark):
    """Texts of several segments give the removals that their parts have in brute force; 5 MB of one byte repeats itself."""
    from crosspanel.llm.substring import remove_repeats
    from crosspanel.llm.suffixes import remove_earlier

    rng = random.Random(4)
    passage = prose(rng, 60, 100_000)
    long = " ".join(f"{rng.getrandbits(48):x}" for _ in range(280_000))
    cut = [long[:262_000], long[262_000:700_000], long[700_000:]]
    text = f" {passage} ".join(cut)
    df = spark.createDataFrame([(0, text), (1, "y" * 5_000_000), (2, passage + " end")], "doc_id long, text string")
    got = rows(remove_earlier(df))
    assert len(text) > 3_000_000 and got[0].n_removed in range(len(passage), len(passage) + 20) and got[0].n_spans == 1
    assert got[1].n_removed == 4_999_999 and got[2].n_removed in (len(passage), len(passage) + 1, len(passage) + 2)
    got = rows(remove_repeats(df))
    assert (got[0].n_removed, got[0].n_spans, got[1].n_removed, got[2].n_removed) == (120, 2, 0, 60)


def test_warc_round_trip(spark, tmp_path):
    from crosspanel.llm import warc

    big = "payload \r\n\r\nWARC/1.1\r\n" * 20_000
    pages = [(1, "a" * 1000), (2, "a" * 1000), (3, "b"), (4, "b"), (5, None), (6, ""), (7, big), (8, big), (None, big), (9, big[:-1]), (9, "c" * 2000), (9, "c" * 2000)]
    df = spark.createDataFrame([(p, "u", h, "x") for p, h in pages], "page_id long, url string, html string, payload string")
    got = warc.archive(df).collect()
    top: dict = {}
    for p, h in pages:
        if len(h or "") >= 1000 and p is not None:
            top[h] = max(p, top.get(h, 0))
    want = []
    for p, h in pages:
        t = top.get(h)
        revisit = t is not None and (p is None or p < t) and sum(x == h for _, x in pages) > 1
        data = (h or "").encode()
        want.append((p or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", t if revisit else None))
    assert sorted(map(repr, ((r.page_id or 0, *tuple(r)[1:]) for r in got))) == sorted(map(repr, want))
    assert warc.archive(df.limit(0)).count() == 0


def test_chunks_carry_digests_across_files(spark, tmp_path):
    from crosspanel.llm import warc

    df = spark.createDataFrame([(1, "é" * 5000), (2, "z" * 3001)], "page_id long, html string")
    rows_ = warc.chunks(warc.roles(df), 1000)
    assert rows_.filter("length(data) > 1000").count() == 0 and rows_.count() == 14
    warc.lines(rows_).write.option("lineSep", "\r\n").option("maxRecordsPerFile", 3).text(f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert got[1].payload_digest == hashlib.sha1(("é" * 5000).encode()).hexdigest() and got[1].payload_bytes == 10_000
    assert got[2].payload_digest == hashlib.sha1(b"z" * 3001).hexdigest()


def test_long_payload_and_broken_archives(spark, tmp_path):
    """A payload of many files, and archives that are cut off or changed."""
    import gzip
    from pathlib import Path

    from crosspanel.llm import warc

    big = "0123456789abcde\n" * (40 * 65_536)  # 40 MiB: 640 chunks, three files
    got = warc.archive(spark.createDataFrame([(1, big), (2, "x"), (3, big)], "page_id long, html string")).collect()
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == [(1, len(big), sha, "revisit", 3), (2, 1, hashlib.sha1(b"x").hexdigest(), "response", None), (3, len(big), sha, "response", None)]
    warc.write(spark.createDataFrame([(5, "y" * 3000)], "page_id long, html string"), f"file://{tmp_path}/w")
    data = gzip.decompress(b"".join(p.read_bytes() for p in sorted(Path(f"{tmp_path}/w").glob("*.gz"))))
    assert [len(b) for _, b in warc.records(data)] == [3000]
    for broken in (data[:-200], data.replace(b"yyyz", b"yyyy", 1)[:200], data.replace(b"yyyy", b"yyyz", 1), gzip.compress(data)[:-40]):
        with pytest.raises(ValueError):
            list(warc.records(broken))


def test_repeated_digests_beyond_the_broadcast(spark):
    from crosspanel.llm import warc

    pages = [(i, f"{i % 40:04d}" * 300) for i in range(160)] + [(500, "a" * 5)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    few, many = (sorted((r.id, r.refers_to or 0) for r in warc.roles(df, most=n).collect()) for n in (7, 1000))
    assert few == many and sum(1 for _, r in many if r) == 120


def levenshtein_within(item, text):
    d = list(range(len(item) + 1))
    best = d[-1]
    for c in text:
        e = [0]
        for i, x in enumerate(item):
            e.append(min(e[-1] + 1, d[i + 1] + 1, d[i] + (x != c)))
        d, best = e, min(best, e[-1])
    return best


def test_decontamination(spark, empty):
    from crosspanel.llm import decontaminate as D

    rng = random.Random(2)
    item = prose(rng, 40)
    chars = list(item)
    for k in range(4):
        chars[k * 20 + 3] = "#"
    texts = ["lead " + item + " end", "lead " + "".join(chars).upper() + "  end", "lead " + "".join(chars[:60]), None, "", item[: len(item) // 2] + item[len(item) // 2 + 6 :], prose(rng, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "w1")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(docs, items).collect()}
    for i, t in enumerate(texts):
        d = levenshtein_within(D.normal(item), D.normal(t))
        assert got.get((i, 0)) == (d if d <= D.budget(D.normal(item)) and t else None), i
    assert {i for i, n in got if n == 3} == {i for i, t in enumerate(texts) if "w1" in D.normal(t).split()}
    assert D.contaminated(empty, items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in D.clean(docs, items.filter("item_id = 0")).collect()} == {2, 3, 4, 6}


def test_myers_against_dynamic_programming():
    from crosspanel.llm.decontaminate import Pattern

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert Pattern(a).nearest(b)[0] == levenshtein_within(a, b)


def test_bpe_against_tiktoken(docs, odd, empty):
    import public_tokenizers as P
    import tiktoken

    from crosspanel.llm import bpe

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, ranks, P.PATTERN)
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    for i, t in enumerate(corpus()):
        assert ids[i] == own.encode_ordinary(t or ""), i
    back = rows(bpe.decode_documents(encoded, ranks))
    both = rows(bpe.round_trip(docs, ranks, P.PATTERN))
    for i, t in enumerate(corpus()):
        data = (t or "").encode()
        assert (both[i].n_tokens, both[i].ids_sha256) == (back[i].n_tokens, back[i].ids_sha256) == (len(ids[i]), hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest())
        assert both[i].decoded_sha256 == hashlib.sha256(data).hexdigest() and both[i].ids_text_equal
    assert all(bytes(back[i].decoded) == (t or "").encode() and back[i].n_tokens == len(ids[i]) for i, t in enumerate(corpus()))
    assert bpe.encode_documents(odd, ranks, P.PATTERN).count() == 7 and bpe.encode_documents(empty, ranks, P.PATTERN).count() == 0


def test_bpe_pieces_share_queues_by_their_bytes(monkeypatch):
    """Many short pieces meet in one queue, which is what their merging costs; queues are bounded in bytes, a longer piece has its own."""
    import public_tokenizers as P

    from crosspanel.llm import bpe

    rng, calls = random.Random(5), []
    words = list({" " + "".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(60_000)})
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = bpe.Encoder.encode_packed
    monkeypatch.setattr(bpe.Encoder, "encode_packed", lambda self, pieces: calls.append(sum(map(len, pieces))) or plain(self, pieces))
    got = bpe.Chunks(ranks, P.PATTERN, bpe.CHUNK).packed([words])
    assert len(calls) == 1
    assert got == [b"".join(plain(bpe.Encoder(ranks), [w.encode() for w in words]))]
    sizes = np.array([3, 4, 4, 25, 1, 9, 1])
    assert list(bpe.runs(sizes, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)] and not list(bpe.runs(sizes[:0], 10))


def test_bpe_with_ranks_in_any_order():
    import tiktoken

    from crosspanel.llm import bpe

    for seed in range(60):
        rng = random.Random(seed)
        tokens = {bytes([c]) for c in b"abc"}
        while len(tokens) < 40:
            both = rng.choice(sorted(tokens)) + rng.choice(sorted(tokens))
            if len(both) < 9:
                tokens.add(both)
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        for c in range(256):
            ranks.setdefault(bytes([c]), len(ranks))
        encoder = bpe.Encoder(ranks)
        encoder.LARGE = 2
        core = tiktoken.Encoding("x", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(60)]
        assert encoder.encode(pieces) == [[ranks[x]] if x in ranks else core.encode_single_piece(x) for x in pieces]


def test_chunks_never_change_the_ids():
    import public_tokenizers as P
    import regex

    from crosspanel.llm.bpe import CHUNK

    rng, find = random.Random(1), regex.compile(P.PATTERN).findall
    for _ in range(3000):
        s = "".join(rng.choice("ab é\n\t\r  \x85\xa0\x1c\x1f ,.!'s've12²٣ñ中　") for _ in range(rng.randint(0, 30)))
        assert [p for c in CHUNK.findall(s) for p in find(c)] == find(s)


def test_quality_rules(docs, odd, empty):
    from crosspanel.llm import rules

    got = rows(rules.quality_rules(docs))
    for i, t in enumerate(corpus()):
        t = t or ""
        w = WORDS.findall(t)
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            dup += line in lines
            if WORDS.search(line):
                lines.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert rules.quality_rules(odd).count() == 7 and rules.quality_rules(empty).count() == 0


def test_compression_bands(spark):
    """The verdict against one computed row by row, with fixed limits and with limits fitted on labels."""
    from crosspanel.llm import rules

    c, rng = rules.Compression(), random.Random(0)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9F00)) + chr(rng.randrange(33, 126)) for _ in range(4000))
    texts = [prose(rng, 2000, 20_000), "again and again " * 500, " ".join(noise[i : i + 9] for i in range(0, len(noise), 9)), None, "", "short"]
    texts += [prose(rng, rng.randint(25, 3000), 20_000) for _ in range(400)]
    texts += [" | ".join(prose(rng, 300, 30).split()) for _ in range(20)]
    labels = [(i, 1) for i in range(6, 406)] + [(i, 0) for i in range(406, 426)] + [(None, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, quality int")

    def plain(limits, text):
        n, _, _, _, repeat = rules.base_features(text)
        size, whole, chunks = c.measure(text)
        bad = [not (lo := limits.of(4096 if k < len(chunks) - 1 else size - 4096 * k))[0] <= r <= lo[1] for k, r in enumerate(chunks)]
        low, high = limits.of(size)
        return n >= 20 and 100 * repeat <= 30 * n and size > 0 and low <= whole <= high and sum(bad) / len(bad) <= 0.25

    fitted = rules.fit_limits(rules.measure(docs), given)
    for limits, got in ((rules.fixed_limits(), rows(rules.quality_rules(docs))), (fitted, rows(rules.quality_rules(docs, given)))):
        assert [got[i].kept for i in range(len(texts))] == [plain(limits, t) for t in texts]
        assert got[0].kept and not any(got[i].kept for i in range(1, 6))
    assert len(c.measure("x" * 12_288)[2]) == 3 and len(c.measure("x" * 12_287)[2]) == 2 and len(c.measure("x" * 8191)[2]) == 1
    assert sum(got[i].kept for i in range(6, 406)) >= 390 and not any(got[i].kept for i in range(406, 426))
    assert rules.fit_limits(rules.measure(docs), given.limit(5)) == rules.fixed_limits()
    assert rules.quality_rules(docs.limit(0), given).count() == 0


def test_quality_classifier(spark, odd, empty):
    from crosspanel.llm import gbdt

    rng = random.Random(0)
    texts = [(i, prose(rng, rng.randint(5, 200)) + ("!! $$ ## | " * 20 if i % 4 == 0 else ".")) for i in range(1200)]
    docs = spark.createDataFrame([*texts, (5000, None), (5001, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in texts] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    trees = gbdt.fit_quality(docs, labels)
    got = rows(gbdt.score_quality(docs, trees))
    assert len(got) == 1202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [r.doc_id for r in docs.select("doc_id").filter(gbdt.held_out("doc_id", 4, 2)).collect() if r.doc_id < 5000]
    assert len(held) > 200 and np.mean([got[i].predicted == int(i % 4 != 0) for i in held]) > 0.97
    none = gbdt.fit_quality(docs, labels.limit(0))
    assert {r.score for r in gbdt.score_quality(odd, none).collect()} == {0.5} and gbdt.score_quality(empty, trees).count() == 0


def test_flat_trees_against_a_walk():
    """Each tree walked node by node gives the score of the flattened arrays."""
    from crosspanel.llm.gbdt import fit

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 5))
    x[:50] = x[0]  # ties
    trees = fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), trees=15)
    for row, score in zip(x[:200], trees.score(x[:200]), strict=True):
        total = trees.base
        for split, limit, leaf in zip(trees.split, trees.limit, trees.leaf, strict=True):
            node = 0
            while node < len(split):
                node = 2 * node + (2 if row[split[node]] > limit[node] else 1)
            total += leaf[node - len(split)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12


def test_decoding_against_all_codewords():
    """Every codeword's weighted loss, one bit after another."""
    from crosspanel.llm.langid import Codes, codewords

    rng = np.random.default_rng(5)
    for n in (2, 4, 12):
        code = codewords(n)
        bits = code.shape[1]
        codes = Codes([str(i) for i in range(n)], code, rng.normal(size=(7, bits)), rng.normal(size=bits), rng.uniform(0.1, 1, bits))
        x = rng.normal(size=(50, 7))
        best, share = codes.decode(x)
        for k in range(50):
            z = x[k] @ codes.weights + codes.bias
            losses = [sum(codes.trust[b] * np.log(1 + np.exp(-code[i, b] * z[b])) for b in range(bits)) for i in range(n)]
            weights = np.exp(-np.array(losses))
            assert best[k] == int(np.argmin(losses)) and abs(share[k] - weights.max() / weights.sum()) < 1e-9


def test_trees_learn_an_interaction():
    from crosspanel.llm.gbdt import fit

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((fit(x[:2000], y[:2000]).score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_language_id(spark, empty):
    from crosspanel.llm import gbdt, langid

    rng = random.Random(0)
    parts = {"xx": "la le on er".split(), "yy": "ung sch ein der".split(), "zz": "ció os que ndo".split()}
    rows_ = [(i, " ".join("".join(rng.choice(parts[v]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), v) for i, v in enumerate(rng.choice("xx yy zz".split()) for _ in range(900))]
    docs = spark.createDataFrame([*rows_, (9000, None, "xx"), (9001, "12 34", "yy"), (9002, "", None), (9003, "la le", None)], "doc_id long, text string, lang string").repartition(3)
    got = rows(langid.predict_languages(docs, langid.fit_languages(docs)))
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    held = {r.doc_id for r in docs.filter(gbdt.held_out("doc_id", 3, 1)).collect()}
    assert np.mean([got[i].lang_pred == v for i, _, v in rows_ if i in held]) > 0.97
    assert {r.lang_pred for r in langid.predict_languages(docs, langid.fit_languages(empty)).collect()} == {"und"}


def test_codewords_are_apart():
    from crosspanel.llm.langid import codewords

    for n in (2, 3, 4, 5, 12, 40):
        c = codewords(n)
        assert len(c) == n and all((c[i] != c[j]).any() for i in range(n) for j in range(i))


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    from crosspanel.llm.pii import base_spans

    rng = random.Random(2)
    for _ in range(10_000):
        s = "".join(rng.choice("ab1234567890..--  ++@@()é\n") for _ in range(rng.randint(0, 60)))
        assert base_spans(s) == plain_spans(s), s


def test_private_spans(spark, docs, odd, empty):
    from crosspanel.llm import pii

    rng = random.Random(6)
    known = [f"his badge number {''.join(rng.choice('0123456789abcdef') for _ in range(40))} lies here" for _ in range(12)]
    texts = [*known, "his badge number QX-77120 lies here", "no badge here QX-77121 either", None, ""]
    df = spark.createDataFrame([(i, t, "k", "m") for i, t in enumerate(texts)], "doc_id long, text string, pii_key string, PII_More string")
    got = rows(pii.private_spans(df))
    assert got[12].spans == "id:17:25" and got[13].spans == got[14].spans == got[15].spans == ""
    clean = rows(pii.redact_documents(df))
    assert clean[12].text == "his badge number [ID] lies here" and clean[14].text is None and (clean[12].pii_key, clean[12].PII_More) == ("k", "m")
    found = rows(pii.private_spans(docs))
    for i, t in enumerate(corpus()):
        assert found[i].base == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t or "")), i
    assert pii.private_spans(odd).count() == 7 and pii.private_spans(empty).count() == 0


def test_op7_counts_each_kind(spark, tmp_path):
    from crosspanel.llm.queries import QUERIES

    texts = ["a@b.co c@d.org 1.2.3.4", "4111 1111 1111 1111 and +49 170 1234567", "1.2.3.4 5.6.7.8 9.9.9.9", "nothing", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in QUERIES["op7_pii"](spark, str(tmp_path)).collect()}
    kinds = [[k for k, _, _ in plain_spans(t or "")] for t in texts]
    assert got == {i: tuple(k.count(x) for x in ("email", "ip", "card", "phone")) for i, k in enumerate(kinds)}
    assert got[0] == (2, 1, 0, 0) and got[1][2:] == (1, 1) and got[5] == (0, 0, 0, 0)


def test_private_spans_find_unseen_identifiers(spark):
    """Identifiers of unknown forms in three contexts: one that seeds know, one that is known only by what the first finds, and one
    without a space.  Numbers elsewhere are no identifiers."""
    from crosspanel.llm import pii

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    prose_ = lambda n: " ".join(word() for _ in range(n))
    code = lambda: f"{rng.choice('QXZ')}{rng.choice('ABC')}-{rng.randint(10_000, 99_999)}"
    hexa = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts, want = [], []

    def add(lead, ident, tail, planted):
        text = f"{prose_(rng.randint(2, 30))} {lead}{ident}{tail} {prose_(rng.randint(2, 30))}"
        at = text.index(lead + ident) + len(lead)
        texts.append(text)
        want.append({(at, at + len(ident))} if planted else set())

    for _ in range(60):
        add("badge number ", hexa(), " belongs", True)
        add("badge number ", code(), " belongs", True)
    twice = [code() for _ in range(40)]
    for c in twice:
        add("badge number ", c, " belongs", True)
        add("signed off by agent ", c, ".", True)
    for _ in range(40):
        add("signed off by agent ", code(), ".", True)
        add('secret_key="', code(), '"', True)
        add('secret_key="', hexa(), '"', True)
        add(f"{word()} {word()} ", str(rng.randint(10_000, 99_999)), f" {word()}", False)
        add("in the year ", str(rng.randint(10_000, 19_999)), " after", False)
    texts.append(prose_(5) + " badge number QX-00001 belongs " + "x" * 5_000_000)
    want.append({(texts[-1].index("QX-00001"), texts[-1].index("QX-00001") + 8)})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x} for r in pii.private_spans(df).collect()}
    hit = sum(len(got[i] & w) for i, w in enumerate(want))
    assert hit >= 0.95 * sum(map(len, want)), (hit, sum(map(len, want)))
    assert hit >= 0.95 * sum(map(len, got.values())), (hit, sum(map(len, got.values())))


def test_long_texts_of_private_data_stay_linear(spark):
    from crosspanel.llm import pii

    text = " ".join(f"mail a{i}@b.example.com and {i}{i}{i}999" for i in range(20_000))
    got = pii.private_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.base == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text)) and got.base.count("email") == 20_000


def plain_fingerprint(t, size=3):
    import xxhash

    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def plain_components(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash(docs, odd, empty):
    from crosspanel.llm.simhash import near_duplicates

    got = rows(near_duplicates(docs))
    prints = [plain_fingerprint(t) for t in corpus()]
    want = plain_components(prints, 2)
    assert all((got[i].fingerprint, got[i].component_id) == (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, want, strict=True)))
    out = near_duplicates(odd).collect()
    assert len(out) == 7 and {r.component_id for r in out if r.fingerprint == "0" * 16} == {2}
    assert near_duplicates(empty).count() == 0


def test_links_of_crowded_fingerprints(spark):
    """Families that share most blocks, with so small a cap that both finer levels are used."""
    from crosspanel.llm.graph import components
    from crosspanel.llm.simhash import close_links

    rng = random.Random(9)
    values = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            v = center
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = plain_components(values, 2)
    for cap in (4096, 8, 3):
        root = {r.node: r.root for r in components(close_links(df, cap)).collect()}
        groups, expected = collections.defaultdict(set), collections.defaultdict(set)
        for v, s, w in zip(values, signed, want, strict=True):
            groups[root.get(s, s)].add(v)
            expected[w].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), cap


def test_bk_tree():
    from crosspanel.llm.simhash import BKTree

    rng, tree = random.Random(1), BKTree()
    values = {rng.getrandbits(16) for _ in range(500)}
    for v in values:
        tree.add(v)
    for _ in range(100):
        q = rng.getrandbits(16)
        assert set(tree.within(q, 3)) == {v for v in values if (v ^ q).bit_count() <= 3}


def test_similar_groups(spark, odd, empty):
    from crosspanel.llm.simhash import similar_groups

    rng = random.Random(8)
    base = [prose(rng, 150, 5000).split() for _ in range(20)]
    rows_ = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        copy = list(w)
        copy[rng.randrange(150)] = "changed"
        rows_.append((100 + i, " ".join(copy)))
    got = {r.doc_id: r.group_id for r in similar_groups(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert np.mean([got[100 + i] == i for i in range(20)]) >= 0.95 and all(got[i] == i for i in range(20))
    assert similar_groups(empty).count() == 0 and similar_groups(odd).count() == 5


def test_components_of_paths_and_stars(spark):
    from crosspanel.llm.graph import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(30)) and got[301] == got[300] == 300 and 200 not in got


def test_similar_groups_at_the_threshold(spark):
    from crosspanel.llm.simhash import similar_groups

    rng = random.Random(12)
    texts = [prose(rng, 4, 6) for _ in range(40)] + [prose(rng, 8, 2) for _ in range(30)]
    for changes in (*[2, 3, 4, 5, 6, 7, 8] * 8, *[1] * 10):  # similarities around 0.8
        words = prose(rng, 180 if changes > 1 else 50, 10_000).split()
        near = list(words)
        for k in rng.sample(range(len(words)), changes):
            near[k] = "changed"
        texts += [" ".join(words), " ".join(near)]
    common = prose(rng, 30)
    texts += [common + " " + prose(rng, n, 10_000) for n in (2, 5, 60, 60, 60)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    group = list(range(len(texts)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.group_id for r in similar_groups(docs).collect()} == dict(enumerate(group))
    assert {r.doc_id: r.group_id for r in similar_groups(docs, cap=4, most=3000).collect()} == dict(enumerate(group))
    assert 20 < len(near) < 60
