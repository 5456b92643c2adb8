"""Hard negatives against SQL and brute force."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from tilewright.llm import negatives
from tilewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor_every, positives=5, count=10):
    """By the definition, on ``(vec_id, whole numbers, label)``."""
    out = []
    for a, v, label in rows:
        if a % anchor_every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, c) for b, w, c in rows if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(t, b) for t, b, c in scored if c != label and -30 * s <= -100 * t <= -90 * s][:count]
            out += [(a, p, n + 1, b, -s, -t) for n, (t, b) in enumerate(fits)]
    return sorted(out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op12_l2ap_negatives"](spark, SF).collect())
    assert got == sorted(con.execute(negatives.ORACLE).fetchall()) and got


@pytest.mark.parametrize("low", [-math.inf, -50.0, 0.0, 300.0, 2000.0])
def test_matches_find_every_pair(low):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 30, (200, 21)) * np.linspace(2, 0.1, 21)) * rng.integers(0, 2, (200, 1))
    q = np.round(rng.normal(0, 30, (17, 21)) * np.linspace(2, 0.1, 21))
    least = np.where(rng.random(17) < 0.5, low, low + 500)
    full = x @ q.T
    i, j, value = negatives.matches(x, q, least)
    expected = [(a, b, full[a, b]) for a, b in zip(*np.nonzero(full >= least[None, :]))]
    assert sorted(zip(i.tolist(), j.tolist(), value.tolist())) == sorted(expected)
    a, b, c = negatives.exact_matches(x.astype(np.int64), q, least)
    assert sorted(zip(a.tolist(), b.tolist(), c.tolist())) == sorted(expected)


def test_clusters_ties_and_copies(spark):
    """Many equal vectors, few rows of a label, negative scores, and windows that fill late."""
    rng = np.random.default_rng(5)
    rows = []
    for n in range(400):
        v = [0.5, 0.5, 0.0] if n % 3 == 0 else [round(float(x), 1) for x in rng.normal(0.1, 0.4, 3)]
        rows.append((n, v, 8 if n in (20, 40) else n % 4))
    rows.append((400, [-1.0, 0.0, 0.0], 3))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in negatives.mine(df, anchor_every=20, lot_size=6).collect())
    plain = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows
    ]
    assert got == brute(plain, 20)


def test_nulls_and_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (2, None, 2), (3, [float("nan"), 1.0], 2), (4, [None, 1.0], 2), (5, [float("inf"), 0.0], 2),
        (6, [0.5, 0.0], None), (None, [0.5, 0.0], 2), (8, [0.5, 0.2], 3), (9, [0.4], 2), (10, [], 2), (11, [0.7, 0.1, 9.0], 2),
    ]
    df = spark.createDataFrame([(*r, i, 1.0) for i, r in enumerate(rows)], SCHEMA + ", window int, score double")
    got = sorted(tuple(r) for r in negatives.mine(df).collect())
    plain = [(0, [256, 0, 0], 2), (1, [230, 25, 0], 2), (8, [128, 51, 0], 3), (9, [102, 0, 0], 2), (10, [0, 0, 0], 2), (11, [179, 25, 2304], 2)]
    assert got == brute(plain, 100) and got
    assert negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.filter("vec_id = 1")).count() == 0


def test_large_numbers(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [2e6, 5.0], 1), (2, [1e6, 7.3], 2), (3, [9e5, -3.0], 2), (100, [2.5e6, 0.7], 2)]
    got = sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    plain = [(i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    assert got == brute(plain, 100)
