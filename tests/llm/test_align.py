"""Alignment against tokenising whole texts and comparing every pair of tokens."""

import collections
import hashlib
import json
import random

import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block long, segment string, kind int, id string, pair long"


def texts():
    rng = random.Random(3)
    words = "the Straße naïve 東京 foo_bar don't we'll 12,345 ... <s> <|endoftext|> <0x0A>  x Привет 🙂🙂 ﬁne ####".split(" ")
    spaces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n ", "\r\n", "　", "\x1c", "\x85", " ", "  ", "  ", "     "]
    made = ["".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "  ", "\n", "\t", "a", " a", "a ", "a  ", "mark ▁ here", "nul\x00 in", "x" * 3_000, "ab " * 4_000, *made, made[0], made[0], "a\n", "\na", "\x0b \x0c"]


def plain(rows):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, from tokens of whole texts and all pairs."""
    import sentencepiece
    import tokenizers

    from crosspanel.llm.align import byte_alphabet

    a, b, alphabet = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    found = []
    for t in rows:
        x, y = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(bytes_a) != f" {t}".encode() or b"".join(bytes_b) != f" {t}".encode():
            found.append(None)
            continue
        spans = []
        for ids, data in ((x, bytes_a), (y, bytes_b)):
            at, own = 0, []
            for i, d in zip(ids, data, strict=True):
                own.append((i, at, at + len(d)))
                at += len(d)
            spans.append(own)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        links, groups, left, right = [], [], 0, 0
        for end in ends:
            sides = [[], []]
            while left < len(spans[0]) and spans[0][left][2] <= end:
                sides[0].append(spans[0][left])
                left += 1
            while right < len(spans[1]) and spans[1][right][2] <= end:
                sides[1].append(spans[1][right])
                right += 1
            links += [(i, j) for i, s, e in sides[0] for j, u, v in sides[1] if s < v and u < e]
            groups.append("|".join(",".join(str(i) for i, _, _ in side) for side in sides))
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    top = collections.defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None
        else (f[0], f[1], f[2], len(f[3]), sum(count[p] == top[p[0]] for p in f[3]), sum(count[p] for p in f[3]), f[4])
        for f in found
    ]


@pytest.mark.parametrize("block", [1, 5_000, 24_000_000])
def test_against_whole_texts(spark, block):
    from crosspanel.llm.align import align_tokens

    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "s", 2, "x", 3) for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align_tokens(docs, A, B, block=block).collect()}
    want = plain(rows)
    assert [got[i] for i in range(len(rows))] == want


def test_documents(spark):
    from crosspanel.llm.queries import op11_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in op11_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert [got[r.doc_id] for r in docs] == plain([r.text for r in docs])


def test_odd_rows(spark):
    from crosspanel.llm.align import align_tokens

    docs = spark.createDataFrame([(None, "a b", *[None] * 5), (1, "a b", *[None] * 5), (1, "a b", *[None] * 5), (2, None, *[None] * 5)], SCHEMA)
    out = sorted(((r.doc_id, r.n_links, r.count_sum) for r in align_tokens(docs, A, B).collect()), key=str)
    assert out == [(1, 2, 6), (1, 2, 6), (2, 0, 0), (None, 2, 6)]
    assert align_tokens(docs.limit(0), A, B).count() == 0


def test_cuts_only_where_no_piece_merges():
    from crosspanel.llm.align import cutter

    with open(A, encoding="utf-8") as f:
        spec = json.load(f)
    cut, odd, alone = cutter(spec, ["a", "▁b", ".▁", "x\ty"])
    assert cut.split("a b. c x\ty\nz d\n e") == ["a", " b. c", " x\ty", "\nz", " d", "\n e"] and alone == "\n"
    assert [bool(odd.search(t)) for t in ("a b\n", ".", "x", "\r", "\u3000", "▁", "\x1c")] == [False, *[True] * 6]
    assert cutter(spec, ["a", "▁\t"])[1] is None
    assert cutter(spec | {"normalizer": {"type": "NFC"}}, ["a"]) == (None, None, "")
    assert cutter(spec, ["\n\x01\x02"]) == (None, None, "")


def test_a_block_sorts_no_array_of_all_links():
    """A block's links are held as numbers of pairs; the room for composing it is bounded per link (before: 66 bytes)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from crosspanel.llm import align

    rng, found, texts = np.random.default_rng(1), [], []
    for part in range(40):
        segments = [f" {part}.{i}" for i in range(200)]
        codes = rng.integers(0, 500, (200, 250)) * 1000 + rng.integers(0, 500, (200, 250))
        steps, sizes = np.zeros(codes.size, np.int8), np.full(200, 250)
        n_a, n_groups, groups = align.spelt(codes.ravel(), steps, sizes, 1000)
        counts = [np.array(list(map(len, segments)), np.int32), *(x.astype(np.int32) for x in (sizes, n_a, n_groups))]
        found.append(align._pack(*counts, steps, "".join(segments), " ".join(groups)))
        texts.append(align._pack(np.array([part], np.int64), np.ones(1, bool), np.array([len("".join(segments)[1:])], np.int32), "".join(segments)[1:]))
    run = align._composed(align.Cuts(None, None), 1000)
    table = lambda data: pa.table({"block": pa.array([0] * len(data)), "data": pa.array(data, pa.binary())})
    known, asked = table(found), table(texts[:0])
    tracemalloc.start()
    try:
        out = run(asked, known)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out["kind"] == [1] and peak < 40 * 40 * 200 * 250
