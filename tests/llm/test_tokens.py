import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from leafmill.llm import bpe, packing

ODD = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　​'sdtrelv abcXYZ019.,!?éß中文字😀👍🏽\0\x01~|<>", "'ll", "  ", "<|endoftext|>", "́", " ", "na", " the"]


@pytest.fixture(scope="module")
def library(vocabulary):
    t = Tokenizer.from_file(vocabulary)
    return lambda x: np.array(t.encode(x, add_special_tokens=False).ids, "<u4")


def texts(n=3000):
    rng = random.Random(1)
    made = ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(n)]
    return [*made, "a" * 20_000, "ab" * 9000, " " * 3000, "\n" * 3000, "<|endoftext|>" * 3]


def test_ids_are_the_library_s(vocabulary, library):
    own, fast = bpe.tokenizer(vocabulary), packing._fast_encoder(vocabulary)
    for x in texts():
        want = library(x)
        assert own.encode(x) == want.tobytes(), repr(x)
        assert own.decode(want.tobytes()) == x
        assert fast.encode_to_numpy(x, allowed_special="all").tolist() == want.tolist(), repr(x)


def test_very_long_runs(spark, vocabulary, library):
    """Two million of one character, alone and between words: the fast encoder's own pattern fails on such white space."""
    runs = [x * 2_000_000 for x in (" ", "\n", "\xa0", " \n", "a", "👍")]
    some = [*runs, f"word{runs[0]}word{runs[1]}", f"{runs[0]}<|endoftext|>{runs[1]}'s", f"{runs[2]}\x1c"]
    fast = packing.encoder(vocabulary)
    for x in some:
        assert fast(x).tolist() == library(x).tolist(), (x[:5], x[-5:])
    docs = spark.createDataFrame([(0, runs[0]), (1, f"word{runs[0]}word"), (2, runs[1][:300_000])], "doc_id long, text string")
    pieces = packing.pack(packing.pieces(docs, vocabulary)).groupBy("doc_id").sum("length").collect()
    tokens = {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, vocabulary).collect()}
    assert {r[0]: r[1] - 1 for r in pieces} == tokens == {0: 2_000_000, 1: 2_000_002, 2: 150_000}


def test_decoding_parts_of_characters(vocabulary):
    t, own = Tokenizer.from_file(vocabulary), bpe.tokenizer(vocabulary)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(len(own.bytes_of)) for _ in range(6)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)


def test_merging_is_leftmost_lowest():
    rng = random.Random(3)
    for _ in range(500):
        pair_of, new = {}, 10
        for rank in range(12):
            pair = rng.randrange(new), rng.randrange(new)
            if pair[0] << 32 | pair[1] not in pair_of:
                pair_of[pair[0] << 32 | pair[1]] = rank << 20 | new
                new += 1
        symbols = [rng.randrange(5) for _ in range(rng.randint(0, 40))]
        want = list(symbols)
        while True:
            best = min(((pair_of.get(a << 32 | b, 1 << 60) >> 20, i) for i, (a, b) in enumerate(zip(want, want[1:]))), default=(1 << 40, 0))
            if best[0] >= 1 << 40:
                break
            i = best[1]
            want[i : i + 2] = [pair_of[want[i] << 32 | want[i + 1]] & 0xFFFFF]
        assert bpe.merge_pairs(list(symbols), pair_of) == want


def test_caches_stay_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    own = bpe.ByteBpe(vocabulary)
    x = " ".join(f"word{i}" for i in range(200))
    assert own.encode(x) == bpe.tokenizer(vocabulary).encode(x) and len(own._chunk) <= 10 and len(own._piece) <= 10


def test_round_trip(spark, edge, vocabulary, library):
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(edge, vocabulary).collect())
    want = []
    for r in edge.collect():
        ids = library(r.text or "")
        want.append((r.doc_id if r.doc_id is not None else -99, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(edge.limit(0), vocabulary).count() == 0
    back = bpe.decode(bpe.encode(edge, vocabulary), vocabulary)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in edge.collect())


def brute_pack(lengths, size):
    """The rule by the sum of squares itself."""
    gaps, out = [], []
    for s in lengths:
        counts = {}
        for g in gaps:
            counts[g] = counts.get(g, 0) + (0 < g < size)
        options = []
        for g in sorted({g for g in gaps if g >= s}):
            after = dict(counts)
            after[g] -= 1
            if g > s:
                after[g - s] = after.get(g - s, 0) + 1
            options.append((sum(v * v for v in after.values()), g))
        if options:
            g = min(options)[1]
            b = max(i for i, x in enumerate(gaps) if x == g)
            out.append(g)
            gaps[b] -= s
        else:
            out.append(size)
            gaps.append(size - s)
    return out, len(gaps)


def test_sum_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(40):
        size = int(rng.integers(4, 40))
        lengths = rng.integers(1, size, int(rng.integers(0, 60)))
        where, offset, bins = packing.sum_of_squares(lengths, size)
        gaps, n = brute_pack(lengths.tolist(), size)
        assert (size - offset).tolist() == gaps and bins == n
        assert not len(lengths) or np.bincount(where, lengths).max() <= size


def test_packing(spark, edge, vocabulary, library, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_IN_TASK", 4)
    got = packing.pack(packing.pieces(edge, vocabulary)).collect()
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    want = {}
    for r in edge.collect():
        ids = np.append(library(r.text or ""), 2).astype("<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.setdefault(r.doc_id, []).extend((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(packing.pieces(edge.limit(0), vocabulary)).count() == 0


def test_few_sequences(spark, vocabulary):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(400)], "doc_id long, text string")
    got = packing.pack(packing.pieces(docs, vocabulary))
    total, n = got.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert n <= -(-total // 1024) * 1.02 + 1
