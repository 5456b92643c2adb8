"""Quality rules against SQL and by hand."""

from __future__ import annotations

import math

import duckdb
import pytest

from tilewright.llm import divergence
from tilewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def by_sql(con):
    cursor = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.ORACLE})")
    return sorted(map(str, cursor.fetchall()))


def by_spark(df):
    return sorted(map(str, (tuple(r) for r in df.select(COLUMNS).collect())))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = by_spark(QUERIES["op2_divergence"](spark, SF))
    assert got == by_sql(con)


def test_odd_texts_equal_sql(spark):
    long = " ".join(f"w{i % 7}x{i}" for i in range(60))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n\v\f\r", "en"), (4, long, None), (5, long + "\na b c\na b c\n \n \na b c", "en"),
        (6, "a b c " * 40, "en"), (7, "é x\xa0y ☃#*$%&|<> \x1c \x85 z", "de"), (8, "ab", "xx"), (9, "日本 語 " * 30, "de"),
        (10, "a a a a a", "en"), (11, "a b a b a b", "fr"), (12, "x\n\n\nx\n y", "fr"), (13, "the of and " + long, "en"),
    ]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, n_words int")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert by_spark(divergence.judge(docs)) == by_sql(con)
    null = divergence.judge(spark.createDataFrame([(None, "a b", "en"), (None, "a b", "en")], "doc_id long, text string, lang string"))
    assert null.count() == 2 and not null.filter("doc_id is not null").count()


def test_distances_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa aa bb 1", "x"), (2, "CC", "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}

    def js(p, q):
        half = [(a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)]
        return math.sqrt(sum(half) / 2)

    q = [6 / 12, 2 / 12, 1 / 12, 3 / 12]
    assert got[1].char_distance == pytest.approx(js([0.6, 0, 0.1, 0.3], q))
    assert got[2].char_distance == pytest.approx(js([0, 1, 0, 0], q))
    assert got[1].word_distance == pytest.approx(js([0.5, 0.25, 0.25, 0], [0.4, 0.2, 0.2, 0.2]))


def test_junk_goes_and_good_texts_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = divergence.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    assert len(good) > 100 and sum(good) / len(good) > 0.99
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(bad) / len(bad) < 0.5


def test_plan_has_no_python(spark, capsys):
    df = QUERIES["op2_divergence"](spark, SF)
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_empty(spark):
    assert divergence.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
