"""SimHash components against brute force."""

from __future__ import annotations

import random

import pytest
import xxhash

from tilewright.llm import simhash
from tilewright.llm.simhash import fingerprint


def plain_fingerprint(text):
    words = []
    word = b""
    for byte in (text or "").encode():
        if byte == 0x20 or 9 <= byte <= 13:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    words += [word] if word else []
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


@pytest.mark.parametrize("text", [None, "", " \t\n\v\f\r ", "A", "A b", "A B c", "É x y Z\x1cq", "x " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def make_rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "only null id here"), (7, "One\tTWO")]
    for i in range(20):
        base = rng.choices(vocab, k=300)
        rows.append((100 * (i + 1), " ".join(base)))
        for j in range(8):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(300)] = rng.choice(vocab)
            rows.append((100 * (i + 1) + j + 1, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_links_at_exactly_three_bits(spark):
    """Fingerprints made by hand: every pair within three bits is connected, no other."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), n)))
    # A chain in one bucket and a ball of near copies.
    fps |= {base[0] ^ ((1 << k) - 1) for k in range(40)} | {base[1] ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [tuple(r) for r in simhash.links(df).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in edges)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = {f: f for f in signed}

    def find2(x):
        while want[x] != x:
            want[x] = want[want[x]]
            x = want[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                want[find2(a)] = find2(b)
    assert {frozenset(y for y in signed if find(y) == find(x)) for x in signed[:50]} == {
        frozenset(y for y in signed if find2(y) == find2(x)) for x in signed[:50]
    }


def test_empty_and_keep_first(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0
    docs = spark.createDataFrame(
        [(5, "a b c d", "x"), (2, "A b c d", "y"), (2, "A b c d", "y"), (None, "a b c d", "z"), (9, "q r s t u v", None)],
        "doc_id long, text string, lang string",
    )
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(
        map(str, docs.filter("doc_id is null or doc_id = 9").union(docs.filter("doc_id = 2").limit(1)).collect())
    )
