"""Ids equal to the library's own, packing against its rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilewright.llm import mixing, packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\n  a\tb \n", "It's we'll I'd ''s 'S", "Word, word... wOrd!? x.y,z", "ÉÀ éà ß Σ ς İ ı K ﬁ", "á éx ́",
    "x<|endoftext|>y <|startoftext|> z", "a\x1cb \x1f c", "a b c　d​e", "日本語 テキスト 123 ١٢٣ ²³", "😀😀 👩‍👩‍👧", "$$$ de,&&& ci%%% x###",
    "  leading", "trailing  ", "A" * 3000, "tab\t\ttab", "\r\n\r\nline", "!!! ... ,a", ". .. , ,, ab.", "l'été n't 'twas", "ʰa ꭓb Ǆ ǅ", "..a", "a-b_c/d", "12,345.67 12a a12",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    own = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = list("abcXYZ ,.!?\n\t'0é ß") + ["the", " of", "́", "ü", "Ü", " ", " ", "İ", "<|endoftext|>", "日"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    enc = tokens.Encoder(path)
    for _ in range(2):  # the second time from memory
        got = list(enc.encode([*texts, None]))
        assert len(got) == len(texts) + 1 and not len(got[-1])
        for t, ids in zip(texts, got, strict=False):
            assert ids.tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 10)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 20)
    own, enc = Tokenizer.from_file(WORD), tokens.Encoder(WORD)
    texts = [f"word{chr(97 + i % 26)} and x{i}" for i in range(200)]
    assert [x.tolist() for x in enc.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.memo) < 40


def check_bins(lengths, bins, limit):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[b]) <= limit for b in bins)


def test_best_two_fit_small():
    # 6 and 3 leave 1: the 3 goes back for 2 and 2.
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 2, 2]), 10))) == [[0, 2, 3], [1]]
    assert packing.best_two_fit(np.array([], dtype=int), 10) == []


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_is_tight(seed):
    rng = np.random.default_rng(seed)
    limit = 64
    lengths = rng.integers(1, [10, 64, 40, 30, 64, 20][seed] + 1, 3000)
    bins = packing.best_two_fit(lengths, limit)
    check_bins(lengths, bins, limit)
    first_fit = []
    for n in sorted(lengths, reverse=True):
        for i, room in enumerate(first_fit):
            if n <= room:
                first_fit[i] -= n
                break
        else:
            first_fit.append(limit - n)
    assert len(bins) <= len(first_fit) * 1.01 + 1


def test_best_pair_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 12))])
        room, above = rng.randint(2, 30), rng.randint(0, 12)
        pair = packing.Pool(lengths).best_pair(room, above)
        sums = [int(lengths[i] + lengths[j]) for i in range(len(lengths)) for j in range(i) if above < lengths[i] + lengths[j] <= room]
        assert (sum(pair) if pair else None) == max(sums, default=None)


def test_pack_documents(spark):
    own = Tokenizer.from_file(WORD)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma,", "Delta."], k=rng.choice([0, 3, 40, 90, 700])))) for i in range(300)]
    rows += [(5, None), (None, "null id"), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, offset int")
    got = packing.pack_documents(docs, WORD, limit=256, with_ids=True).collect()
    want = []
    for d, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        for n, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want.append((d, n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids)) for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 256) * 1.05 + 1


def test_pack_empty_and_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, WORD).count() == 0
    parts = spark.createDataFrame([(i, 1 + i % 50) for i in range(1000)], "doc_id long, length long")
    got = packing.pack(parts, limit=50, group_pieces=100).collect()
    assert len(got) == 1000 and len({(r.sequence_id, r.offset) for r in got}) == 1000


def test_sequences_follow_the_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["alpha"] * rng.randint(20, 200)), "aaaabbbccc"[i % 10]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    weights = {"a": 5.0, "b": 3.0, "c": 2.0}
    got = packing.pack_mixed(docs, WORD, limit=256, group_pieces=500, weights=weights, block_chars=5000).collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == list(range(4000))
    order = {r.doc_id: r for r in mixing.report(docs, weights=weights, block_chars=5000).collect()}
    # Groups are contiguous in the mix, and their numbers follow it.
    groups = {}
    for r in got:
        groups.setdefault(r.sequence_id >> 32, []).append((order[r.doc_id].slot, order[r.doc_id]["at"]))
    assert len(groups) == 8 and all(len(groups[g]) == 500 for g in range(7))
    assert all(max(groups[g]) <= min(groups[g + 1]) for g in range(7))
    # While all sources last, every run of sequences has the target shares, not only every group.
    first = min(r.slot for r in order.values() if r.phase > 0)
    tokens = {}
    for r in got:
        if max(s for s, _ in groups[r.sequence_id >> 32]) < first:
            held = tokens.setdefault((r.sequence_id >> 32, (r.sequence_id & 0xFFFFFFFF) // 125), dict.fromkeys("abc", 0))
            held[order[r.doc_id].source] += r.length
    runs = [t for t in tokens.values() if sum(t.values()) > 25_000]
    assert len(runs) > 3
    for held in runs:
        assert all(abs(held[s] / sum(held.values()) - w / 10) < 0.15 for s, w in weights.items())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_thinned_memo_gives_the_same_ids(monkeypatch, name):
    """Also when chunks met once are forgotten again and again, and when all are."""
    rng = np.random.default_rng(7)
    texts = ["".join(f"{'Ab' * int(k % 3)}w{'xyzé'[int(k) % 4] * int(k % 7)}{m}" for k, m in zip(rng.zipf(1.3, 60) % 400, rng.choice(np.array([" ", ", ", "!!\n", "*** ", "'s ", "  "]), 60))) for _ in range(80)]
    for most, slice_chars in ((50, 400), (3, 300), (10_000, 10**6)):
        monkeypatch.setattr(tokens, "MEMO_CHUNKS", most)
        monkeypatch.setattr(tokens, "SLICE_CHARS", slice_chars)
        enc = tokens.Encoder(public_tokenizers.path(name))
        got = [list(x) for x in enc.encode(texts)]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
