"""Collocations against SQL and brute force."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tilewright.llm import phrases
from tilewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=10, top=2000):
    """By the definition, on ``(text, lang)``."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in (1, 2, 3):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in good.items():
            if any(100 * b >= 50 * a for q, b in good.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n + 1, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(con.execute(phrases.ORACLE).fetchall())
    assert rows_of(QUERIES["op13_suffix_phrases"](spark, SF)) == expected and expected


def made(seed, n=60, words=12):
    rng = np.random.default_rng(seed)
    marks = np.array([" ", " ", " ", " ", ", ", "\t", "\n", "  ", ". ", "\r\n", "! "])
    out = []
    for i in range(n):
        size = int(rng.integers(0, 120))
        text = "".join(f"w{int(w)}{m}" for w, m in zip(rng.zipf(1.5, size) % words, rng.choice(marks, size)))
        out.append((text.upper() if i % 7 == 0 else text, ["en", "de", None][i % 3]))
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 500, 60])
def test_equals_brute_force(spark, bucket_bytes):
    """Also with so many buckets that nearly all words and pairs are routed by more words."""
    rows = made(4)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    assert rows_of(phrases.mine(docs, bucket_bytes=bucket_bytes)) == brute(rows)


def test_hot_pair_and_ranks(spark):
    """One pair before ever new words; ties by phrase; a lower limit of ranks."""
    rows = [(" ".join(f"the of x{i * 40 + k} é{k % 3} ß zz." for k in range(40)), "en") for i in range(10)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    for top in (3, 2000):
        assert rows_of(phrases.mine(docs, bucket_bytes=300, top=top)) == brute(rows, top=top)


def test_sort_equals_counting():
    rng = np.random.default_rng(8)
    for longest in (1, 2, 3):
        keys = rng.integers(0, 6, (3000, longest)).astype(np.int32)
        keys[:, 0] += 1
        for d in range(1, longest):
            keys[keys[:, d - 1] == 0, d] = 0
        weights = rng.integers(1, 4, len(keys)).astype(float)
        got = {}
        for rows, deep, n in phrases.multikey(keys, weights, [5.0] * longest):
            for r, d, c in zip(rows, deep, n):
                prefix = tuple(keys[r][:d].tolist())
                assert prefix not in got
                got[prefix] = c
        expected = Counter()
        for k, w in zip(keys.tolist(), weights):
            for d in range(1, longest + 1):
                if k[d - 1]:
                    expected[tuple(k[:d])] += int(w)
        assert got == {k: v for k, v in expected.items() if v >= 5}
    assert not list(phrases.multikey(np.zeros((0, 3), np.int32), np.zeros(0), [1.0] * 3))


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 7)
    rows = made(6, 20) + [("a b c d e f g h i j k l m", "en"), ("x" * 50, "en"), ("y", "de"), (" ", "fr")]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t, _ in rows]), pa.array([x or "und" for _, x in rows])], names=["text", "lang"])
    found = Counter()
    for size in (9, 1 << 20):
        monkeypatch.setattr(phrases.slices, "__defaults__", (size,))
        got = Counter()
        for chunk, keys in phrases.chunks(iter([batch]), 3):
            for k in keys:
                got[chunk.langs[k[0]], *(chunk.words[w].decode() for w in k)] += 1
        assert not found or got == found
        found = got
    expected = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece) + ["", ""]
            for i in range(len(words) - 2):
                expected[lang or "und", *words[i : i + 3]] += 1
    assert found == expected


def test_scores_pass_64_bits(spark):
    big = 10**12
    found = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 7 * big), ("en", "a b", 2, 2 * big + 1)], "lang string, phrase string, m int, f long")
    r = phrases.scored(found).first()
    assert r.score == 1_000_000 * (2 * big + 1) ** 2 // (3 * big * 7 * big)


def test_odd_rows(spark):
    long = "one two three " * 200_000
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("A B " * 12, None), ("a b " * 12, "und"), (long, "en"), ("x" * 3_000_000, "de"), ("\x00 é. " * 11, "fr")]
    docs = spark.createDataFrame([(i, *r, 7, "n") for i, r in enumerate(rows)], SCHEMA + ", n long, phrase string")
    assert rows_of(phrases.mine(docs)) == brute(rows)
    assert phrases.mine(docs.limit(0)).count() == 0
    assert phrases.mine(docs.filter("doc_id < 3")).count() == 0
    assert phrases.mine(docs.filter("doc_id = 6")).count() == 0
