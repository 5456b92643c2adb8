"""The additive quality model: by hand, by brute force, and on held-out labels."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from tilewright.llm import additive
from tilewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string"


def named(text):
    return dict(zip(additive.FEATURES, additive.features(text), strict=True))


def test_features_by_hand():
    f = named("Ab ab é1 $x!\nAb ab é1 $x!\nq.\n \n")
    assert f["log_words"] == pytest.approx(math.log1p(9))
    assert f["word_length"] == pytest.approx((2 + 2 + 2 + 3) * 2 / 9 + 2 / 9)
    assert f["upper"] == pytest.approx(2 / 11)
    assert f["symbols"] == pytest.approx(2 / 9) and f["loud"] == pytest.approx(2 / 9) and f["stops"] == pytest.approx(1 / 9)
    assert f["distinct_words"] == pytest.approx(5 / 9) and f["top_word"] == pytest.approx(2 / 9)
    assert f["repeated_lines"] == pytest.approx(1 / 3) and f["short_lines"] == 1.0
    assert f["repeated_triples"] == pytest.approx(1 - 5 / 7)
    assert f["marked_words"] == pytest.approx(3 / 9)
    assert set(additive.features(None)) == set(additive.features(" \n\t")) == {0.0}


def brute_cut(g, h, n):
    """Best two-part cut by trying all."""
    worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + additive.LAMBDA)
    best, place = 1e-9, 0
    for k in range(1, len(g)):
        a, b = np.s_[:k], np.s_[k:]
        if n[a].sum() >= additive.MIN_LEAF and n[b].sum() >= additive.MIN_LEAF and worth(a) + worth(b) - worth(np.s_[:]) > best:
            best, place = worth(a) + worth(b) - worth(np.s_[:]), k
    return place


def test_trees_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 12))
        n = rng.integers(0, 30, size).astype(float)
        g, h = rng.normal(0, 1, size) * n, n * 0.2
        k = brute_cut(g, h, n)
        assert additive._cut(g, h, n)[1] == k
        borders = sorted({0, k, size} | {s + brute_cut(g[s:e], h[s:e], n[s:e]) for s, e in ((0, k), (k, size)) if k and s < e})
        got = additive.step_of(g, h, n)
        for s, e in zip(borders, borders[1:]):
            assert got[s:e] == pytest.approx(g[s:e].sum() / (h[s:e].sum() + additive.LAMBDA))


def test_pair_trees_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        shape = tuple(rng.integers(1, 6, 2))
        n = rng.integers(0, 40, shape).astype(float)
        g, h = rng.normal(0, 1, shape) * n, n * 0.2
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + additive.LAMBDA) if n[m].sum() >= additive.MIN_LEAF else -math.inf
        best = 0.0
        for flip in (0, 1):
            size, other = shape[flip], shape[1 - flip]
            at = lambda s, t: (s, t) if not flip else (t, s)  # noqa: E731, B023
            for r in range(1, size):
                gain = 0.0
                for side in (np.s_[:r], np.s_[r:]):
                    gain += max([worth(at(side, np.s_[:])), *(worth(at(side, np.s_[:k])) + worth(at(side, np.s_[k:])) for k in range(1, other))])
                best = max(best, gain - g.sum() ** 2 / (h.sum() + additive.LAMBDA))
        assert additive.pair_step(g, h, n)[0] == pytest.approx(best)


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (800, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(800) < 0.05)).astype(float)  # only a pair tells
    model = additive.fit(x, y)
    assert (0, 1) in model.pairs
    fresh = rng.normal(0, 1, (400, 4))
    p = additive.score(model, fresh)
    assert ((p > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.85
    for row, got in zip(fresh[:40], p):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        z = model.base + sum(t[b] for t, b in zip(model.tables, at))
        z += sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op11_additive_model"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 500
    assert sum(p == q for p, q in held) / len(held) > 0.98
    good, bad = [p for p, q in held if q == 1], [p for p, q in held if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "good words here. " * 9 if i % 2 else "bad### $$$ &&& " * 9) for i in range(200)], DOCS)
    made = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in made]
    schema = "doc_id long, quality int"
    one, two = (sorted(tuple(r) for r in additive.classify(docs, spark.createDataFrame(rows, schema)).collect()) for rows in (made, turned))
    assert one == two
    assert all(r[3] == r[0] % 2 for r in one)


def test_odd_rows(spark):
    long = "one two three four. " * 50_000
    rows = [(1, "a b c. " * 30), (1, "a b c. " * 30), (2, None), (3, ""), (None, "a b"), (4, long), (5, "#$% " * 40), (6, "x" * 1_000_000)]
    docs = spark.createDataFrame([(*r, 0.5, True, 1) for r in rows], DOCS + ", score double, held_out boolean, y int")
    labels = spark.createDataFrame(
        [(1, 1, 9), (1, 1, 9), (4, 1, 9), (5, 0, 9), (5, None, 9), (2, 7, 9), (None, 1, 9), (99, 0, 9)], "doc_id long, quality int, x int"
    )
    got = additive.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = additive.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert additive.classify(docs.limit(0), labels).count() == 0


def test_training_rows_are_a_bound(spark):
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(50)], DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert additive.training_table(docs, labels, "quality", 7).count() == 7
