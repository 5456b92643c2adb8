"""Pfair mixing: windows kept, less than one block of deviation, rows whole."""

from __future__ import annotations

import random

import pytest

from tilewright.llm import mixing

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(40))
def test_every_block_is_in_its_window(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    shares = mixing.parts([rng.choice([0.01, 1, 5, 40]) * rng.random() + 1e-6 for _ in range(n)], rng.choice([12, 50, 100, 1000]))
    period = sum(shares)
    out = mixing.schedule(shares)
    assert [s.slot for s in out] == list(range(period))
    done = [0] * n
    for s in out:
        assert s.release <= s.slot < s.deadline
        done[s.source] += 1
        assert s.block == done[s.source]
        for i in range(n):
            assert abs(done[i] - shares[i] * (s.slot + 1) / period) < 1
    assert done == shares


def test_parts():
    assert mixing.parts([1, 1, 1], 10) == [4, 3, 3] and mixing.parts([1e9, 1, 1], 10) == [8, 1, 1] and mixing.parts([5], 7) == [7]


@pytest.mark.parametrize("seed", range(20))
def test_phases_place_all_blocks(seed):
    rng = random.Random(seed)
    blocks = [rng.choice([0, 1, 3, 50, 400]) for _ in range(rng.randint(1, 8))]
    weights = [rng.random() + 0.01 for _ in blocks]
    found = mixing.phases(blocks, weights, 50)
    done = [0] * len(blocks)
    for p in found:
        assert p.first_slot == sum(done)
        at = dict.fromkeys(p.shares, 0)
        for t in range(p.slots):
            s = p.order[t % len(p.order)]
            done[s.source] += 1
            at[s.source] += 1
            assert all(abs(at[i] - p.shares[i] * (t + 1) / len(p.order)) < 1 for i in at)
    assert done == blocks


@pytest.mark.parametrize("weights", [[0.5, 0.4999, 0.0001], [1 / 3, 2 / 3], [0.70035, 0.2, 0.09965], [0.99995, 0.00005]])
def test_deviation_from_the_given_weights(weights):
    p = mixing.phases([int(w * 20_000) + 1 for w in weights], weights)[0]
    assert p.slots > 10_000
    done = [0] * len(weights)
    for s in p.order:
        done[s.source] += 1
        assert all(abs(done[i] - w * (s.slot + 1)) <= 1 + mixing.ROUNDING for i, w in enumerate(weights))


def test_documents_follow_the_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = mixing.report(docs, block_chars=5000, period=100).collect()
    assert len(rows) == docs.count() == len({r.doc_id for r in rows})
    text = {r.doc_id: max(1, len(r.text)) for r in docs.collect()}
    names, found = mixing.plan(docs, weights=None, block_chars=5000, period=100)
    # Brute force: walk all slots in order and hand out each source's blocks one by one.
    where, done = {}, dict.fromkeys(names, 0)
    for p in found:
        for t in range(p.slots):
            name = names[p.order[t % len(p.order)].source]
            where[name, done[name]] = p.first_slot + t
            done[name] += 1
    by_source = {}
    for r in rows:
        assert r.slot == where[r.source, r.block] and r.block == r.at // 5000
        first = found[r.phase].first_slot
        assert r.release <= r.slot - first < r.deadline
        by_source.setdefault(r.source, []).append((r.at, text[r.doc_id]))
    for held in by_source.values():
        at = 0
        for start, size in sorted(held):
            assert start == at
            at += size
    ordered = [r.doc_id for r in mixing.mixed_order(docs, block_chars=5000, period=100).collect()]
    assert ordered == [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.at))]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 1), (1, None, None, 1), (None, "x" * 50_000, "a", 2), (3, "", "b", 3), (4, "y", "a", 4)], "doc_id long, text string, source string, slot int"
    )
    got = mixing.mix(docs, block_chars=1000)
    assert got.count() == 5 and got.filter("source is null").count() == 2
    assert mixing.mixed_order(docs, block_chars=1000, weights={"a": 3, "b": 1, None: 1}).columns == docs.columns
    with pytest.raises(ValueError, match="weight"):
        mixing.mix(docs, weights={"a": 1})
    assert mixing.mix(docs.limit(0)).count() == 0
