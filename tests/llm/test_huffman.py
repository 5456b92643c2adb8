"""Block files: exact round trips, optimal lengths, ids and places equal to the library's."""

from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilewright.llm import huffman
from tilewright.llm.common import shared_folder

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(5))
def test_lengths_are_optimal_without_a_limit(seed):
    counts = np.random.default_rng(seed).integers(0, 50, 40)
    lengths = huffman.code_lengths(counts, 30).astype(int)
    assert (lengths * counts).sum() == huffman_cost(counts)
    assert ((lengths > 0) == (counts > 0)).all()


def test_limit_holds_and_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    lengths = huffman.code_lengths(counts, 4).astype(int)
    assert lengths.max() == 4 and (2.0 ** -lengths).sum() <= 1
    best = min(
        sum(c * n for c, n in zip(counts, ns, strict=True))
        for ns in __import__("itertools").product(range(1, 5), repeat=8)
        if sum(2.0**-n for n in ns) <= 1
    )
    assert (lengths * counts).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)


def test_canonical_codes():
    codes = huffman.canonical_codes(np.array([2, 0, 1, 3, 3], np.uint8))
    assert codes.tolist() == [0b10, 0, 0b0, 0b110, 0b111]


@pytest.mark.parametrize(("n", "vocab"), [(1, 1), (5, 1), (513, 3), (70_000, 300), (200_001, 50_000), (65_536, 2)])
def test_file_round_trip(n, vocab):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, vocab - 1)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=vocab))
    sizes = np.array([n // 3, 0, n - n // 3])
    content = b"".join(huffman.encode_file([7, None, -3], sizes, ids, lengths))
    docs, counts, back = huffman.decode_file(content)
    assert docs == [7, None, -3] and counts.tolist() == sizes.tolist() and (back == ids).all()


def test_round_trip_of_documents(spark):
    own = Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["Alpha", "beta,", "é", "12"], k=rng.choice([0, 1, 50, 400])))) for i in range(200)]
    rows += [(50, None), (50, ""), (-4, "x<|endoftext|>y"), (None, "no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    folder = shared_folder(spark, "test-huffman")
    got = huffman.round_trip(docs, BYTE, folder, segment_ids=3000).collect()
    ids = [(d, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    want = sorted(str((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))) for d, x in ids)
    assert want == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id) for r in got] == sorted((r.doc_id is not None, r.doc_id) for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    whole = huffman.read_tokens(spark, folder, with_ids=True).filter("doc_id = -4").first()
    assert whole.ids == next(x for d, x in ids if d == -4)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert huffman.round_trip(docs, BYTE, shared_folder(spark, "test-huffman")).count() == 0
