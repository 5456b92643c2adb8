"""Language profiles against brute-force vectors, and held-out accuracy."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest

from tilewright.llm import hyperdim

SF = "/root/testdata/sf0.01"


def plain_bundle(text, d):
    words = re.findall(r"[^\W\d_]+", text.lower())
    out = np.zeros(d)
    if words:
        line = " " + " ".join(words) + " "
        for i in range(len(line) - 2):
            v = np.ones(d)
            for j in range(3):
                v = v * np.roll(hyperdim.letter_vector(line[i + j], d), 2 - j)
            out += v
    return out


def test_bundles_equal_brute_force():
    texts = ["", None, "12 34 !", "The cat, the CAT.", "Éa ß 日本語", "x " * 3000]
    got = hyperdim.bundles(texts, 64)
    for t, row in zip(texts, got, strict=True):
        assert (row == plain_bundle(t or "", 64)).all()


def test_vectors_are_nearly_orthogonal():
    a, b = hyperdim.letter_vector("a", 2048).astype(int), hyperdim.letter_vector("b", 2048).astype(int)
    assert abs(a @ b) < 250 and set(np.unique(a)) == {-1, 1}
    assert abs(hyperdim.gram_vector("abc", 2048).astype(int) @ hyperdim.gram_vector("cba", 2048)) < 250


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = hyperdim.predict_documents(docs).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "aaa bbb", "x", 1.0), (2, None, "x", 2.0), (3, "123 ...", "y", 3.0), (None, "ccc ddd", None, 4.0), (5, "ccc ddd", "y", 5.0), (5, "ccc ddd", "y", 5.0)],
        "doc_id long, text string, lang string, score double",
    )
    got = {(r.doc_id, r.lang_pred) for r in hyperdim.predict_documents(docs).collect()}
    assert (2, "und") in got and (3, "und") in got
    kept = hyperdim.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.score for r in kept.collect()} <= {1.0, 4.0, 5.0}
    empty = docs.limit(0)
    assert hyperdim.predict_documents(empty).count() == 0 and hyperdim.keep_identified(empty).count() == 0


def test_only_the_text_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    prototypes = hyperdim.learn(docs)
    a = hyperdim.identify(docs, prototypes).collect()
    b = hyperdim.identify(docs.selectExpr("-doc_id as doc_id", "text", "'zz' as lang"), prototypes).collect()
    assert [(r.lang_pred, r.score) for r in a] == [(r.lang_pred, r.score) for r in b]


@pytest.mark.parametrize("text", ["", "a", "ab"])
def test_short(text):
    assert hyperdim.bundles([text], 32).shape == (1, 32)


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the house", "en"), (2, "² ½ Ⅷ ① 12", None), (3, "a½b", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in hyperdim.predict_documents(docs).collect()}
    assert got[2].lang_pred == "und" and got[2].score == 0
    assert hyperdim.letter_runs("a½b ²c Ⅷ") == ["a", "b", "c"]


def test_letter_runs_are_as_quick_as_a_plain_pattern():
    text = "wörter und buchstaben, 12 stück " * 30_000
    start = time.process_time()
    hyperdim.letter_runs(text)
    assert time.process_time() - start < 2


def test_a_worker_keeps_one_large_table():
    """What one stage remembers goes when the next one in the same worker begins."""
    import gc
    import weakref

    import public_tokenizers

    from tilewright.llm import tokens

    known = weakref.ref(hyperdim.grams(64))
    assert hyperdim.grams(64) is known()
    memo = weakref.ref(tokens.encoder(public_tokenizers.path("word_bpe_49k.json")))
    gc.collect()
    assert known() is None and memo() is not None
    hyperdim.grams(64)
    gc.collect()
    assert memo() is None
