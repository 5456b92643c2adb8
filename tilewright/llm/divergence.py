"""Quality rules from distribution divergence: a document against its language.

Two histograms are compared by Jensen-Shannon distance (base 2, from 0 to 1): character classes,
and the language's most common words with everything else as one class. References are
counted over all documents of the language. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
#: Character classes, taken out of the text in this order; the rest is a class of its own.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": SPACE, "beyond": r"[^\x00-\x7F]+"}
SYMBOLS = r"[#*$%&|<>]+"
COMMON_WORDS = 50
#: Common words are looked up by their hash in a table of so many slots.
SLOTS = 4096
SLOT = f"cast(pmod(xxhash64(w), {SLOTS}) as int)"
MIN_WORDS = 50
MIN_CHARS = 200
#: References are joined as a broadcast, one row per language; more languages are an error.
MAX_LANGUAGES = 1024
#: A document farther from its language than this is rejected.
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.46


def counted(docs: DataFrame) -> DataFrame:
    """Adds ``_words`` and one count per character class to ``docs``."""
    out = docs.withColumn("_rest", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_words", F.array_remove(F.split("_rest", SPACE, -1), ""))
    out = out.withColumn("n_chars_all", F.length("_rest").cast("long")).withColumn(
        "_lines", F.filter(F.split("_rest", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    for name, pattern in CLASSES.items():
        out = out.withColumn("_left", F.regexp_replace("_rest", pattern, ""))
        out = out.withColumn(f"n_{name}", (F.length("_rest") - F.length("_left")).cast("long"))
        out = out.withColumn("_rest", F.col("_left"))
    return out.withColumn("n_other", F.length("_rest").cast("long"))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, the class
    counts and ``_words``."""
    out = counted(docs).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.col("n_chars_all") - F.col("n_space"),
            "n_symbols": (F.length("_rest") - F.length(F.regexp_replace("_rest", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    # One hash per window of three words. Arrays are arguments here, never captured by a lambda, so a
    # filter that is pushed down cannot make this quadratic.
    out = out.withColumn(
        "_hashes",
        F.expr(
            "slice(zip_with(zip_with(_words, slice(_words, 2, greatest(size(_words) - 1, 0)), (a, b) -> xxhash64(a, b)), "
            "slice(_words, 3, greatest(size(_words) - 2, 0)), (h, c) -> xxhash64(h, c)), 1, greatest(size(_words) - 2, 0))"
        ),
    )
    # Most texts repeat nothing. In the others, windows are sorted so that equal ones are neighbours.
    windows = "sort_array(transform(_hashes, (h, i) -> struct(h, i)))"
    out = out.withColumn("_windows", F.expr(f"if(size(array_distinct(_hashes)) = size(_hashes), array(), {windows})"))
    out = out.withColumn(
        "_found",
        F.expr(
            "sort_array(array_distinct(flatten(filter(zip_with(_windows, slice(_windows, 2, greatest(size(_windows) - 1, 0)), "
            "(a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))))"
        ),
    )
    out = out.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(_found, struct(-3 as last, 0L as n), "
            "(a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
        ),
    )
    return out.drop("_lines", "_left", "_rest", "_hashes", "_windows", "_found")


def references(docs: DataFrame) -> DataFrame:
    """One row per language of ``docs(text, lang)``: ``class_shares``, the common ``words`` and
    their ``word_shares``, the last of which is the share of all other words."""
    classes = [*(f"n_{c}" for c in CLASSES), "n_other"]
    known = docs.filter("lang is not null and text is not null").select("lang", "text")
    chars = counted(known).groupBy("lang").agg(
        F.sum(F.size("_words")).alias("all_words"), *[F.sum(c).alias(c) for c in classes]
    )
    total = sum((F.col(c) for c in classes), F.lit(0.0))
    chars = chars.filter(total > 0).select("lang", "all_words", F.array(*[F.col(c) / F.greatest(total, F.lit(1.0)) for c in classes]).alias("class_shares"))
    counts = (
        known.select("lang", F.explode(F.split("text", SPACE, -1)).alias("word"))
        .filter("word <> ''")
        .groupBy("lang", "word").count()
    )
    best = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= COMMON_WORDS)
    words = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_rn", "word", "count"))).alias("w"))
    return chars.join(words, "lang", "left").select(
        "lang", "class_shares",
        F.coalesce(F.col("w.word"), F.array().cast("array<string>")).alias("words"),
        F.expr(
            "if(w is null, array(1.0D), concat(transform(w, x -> x.count / greatest(all_words, 1L)), "
            "array((all_words - aggregate(w, 0L, (s, x) -> s + x.count)) / greatest(all_words, 1L))))"
        ).alias("word_shares"),
    )


def _half(p: str, q: str) -> str:
    """One class's part of the divergence."""
    return f"(if({p} > 0, {p} * log2(2 * {p} / ({p} + {q})), 0D) + if({q} > 0, {q} * log2(2 * {q} / ({p} + {q})), 0D)) / 2"


def distances(docs: DataFrame, reference: DataFrame) -> DataFrame:
    """``docs`` (with base counts) and ``char_distance`` and ``word_distance``; null if the language
    has no reference or the text is empty."""
    if reference.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    named = reference.select(
        F.col("lang").alias("_lang"), F.col("class_shares").alias("_q"), F.col("words").alias("_common"), F.col("word_shares").alias("_shares"),
        F.expr(f"transform(words, w -> {SLOT})").alias("_at"),
    )
    # A table from a word's slot to its place, and the words whose slot another one has.
    named = named.withColumns({
        "_slots": F.expr(f"transform(sequence(0, {SLOTS - 1}), s -> cast(array_position(_at, s) as int))"),
        "_others": F.expr("filter(_common, (w, i) -> array_position(_at, _at[i]) <> i + 1)"),
    }).drop("_at")
    out = docs.join(F.broadcast(named), F.col("lang") == F.col("_lang"), "left")
    counts = F.array(*[F.col(f"n_{c}") for c in [*CLASSES, "other"]])
    out = out.withColumn("_p", F.transform(counts, lambda n: n / F.greatest("n_chars_all", F.lit(1))))
    # Places of the document's words among the common ones, in runs after sorting.
    out = out.withColumn(
        "_hits",
        F.expr(
            f"sort_array(filter(transform(_words, w -> if(_slots[{SLOT}] = 0, 0, if(_common[_slots[{SLOT}] - 1] = w, _slots[{SLOT}], "
            "if(array_contains(_others, w), cast(array_position(_common, w) as int), 0)))), i -> i > 0))"
        ),
    )
    # The last place of each run, then how many hits each run has. A common word that is absent
    # adds half of its share, so only present ones are gone through.
    out = out.withColumn(
        "_ends",
        F.expr(
            "filter(zip_with(transform(_hits, (h, k) -> struct(h, k + 1 as k)), slice(_hits, 2, greatest(size(_hits) - 1, 0)), "
            "(x, h) -> if(h is null or h <> x.h, x, null)), x -> x is not null)"
        ),
    )
    out = out.withColumn(
        "_present",
        F.expr(
            "zip_with(_ends, concat(array(0), slice(transform(_ends, x -> x.k), 1, greatest(size(_ends) - 1, 0))), "
            "(x, b) -> struct((x.k - b) / greatest(n_words, 1L) as p, _shares[x.h - 1] as q))"
        ),
    )
    out = out.withColumn("_present", F.expr("filter(_present, x -> x.p is not null)"))
    out = out.withColumns({"_rest_p": F.expr("(n_words - size(_hits)) / greatest(n_words, 1L)"), "_rest_q": F.expr("_shares[size(_shares) - 1]")})
    words = (
        f"aggregate(_present, 0D, (s, x) -> s + {_half('x.p', 'x.q')}) + {_half('_rest_p', '_rest_q')} + "
        "(1 - _rest_q - aggregate(_present, 0D, (s, x) -> s + x.q)) / 2"
    )
    chars = f"aggregate(zip_with(_p, _q, (p, q) -> {_half('p', 'q')}), 0D, (s, x) -> s + x)"
    return out.withColumns(
        {
            "char_distance": F.expr(f"if(_q is null or n_chars_all = 0, null, sqrt(greatest(0D, {chars})))"),
            "word_distance": F.expr(f"if(_shares is null or n_words = 0, null, sqrt(greatest(0D, {words})))"),
        }
    ).drop("_lang", "_q", "_common", "_slots", "_others", "_shares", "_p", "_hits", "_ends", "_present", "_rest_p", "_rest_q", "_words")


def far_off() -> Column:
    """True if a distance is too large and the text long enough to tell."""
    chars = (F.col("n_chars_all") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return F.coalesce(chars, F.lit(False)) | F.coalesce(words, F.lit(False))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, both distances and ``kept`` per row of
    ``docs(doc_id, text, lang)``.

    Nulls: a null text has no words and fails the base rule; without a language, or in one with
    no text at all, nothing is compared and the base rule decides. Repeated rows: one result each.
    Ties among common words: the smaller word first. Empty table: empty result. Other columns are
    not read.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    reference = cut(references(narrow))
    out = distances(base_counts(narrow), reference)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "char_distance", "word_distance", (~F.col("base_failed") & ~far_off()).alias("kept"),
    )


_HALF = "(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END) / 2"
_LEFT = ["text"]
for _p in CLASSES.values():
    _LEFT.append(f"regexp_replace({_LEFT[-1]}, '{_p}', '', 'g')")
_COUNTS = ", ".join(
    [f"length({a}) - length({b}) AS n_{c}" for c, a, b in zip(CLASSES, _LEFT, _LEFT[1:], strict=False)]
    + [f"length({_LEFT[-1]}) AS n_other", f"length({_LEFT[-1]}) - length(regexp_replace({_LEFT[-1]}, '{SYMBOLS}', '', 'g')) AS n_symbols"]
)
_NAMES = [*CLASSES, "other"]
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, lang, length(text) AS n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, {_COUNTS} FROM d),
w AS (SELECT doc_id, lang, i, ws[i] AS word, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM c)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w WHERE g IS NOT NULL) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words FROM twice, range(3) AS r(s) GROUP BY doc_id),
ref AS (SELECT lang, sum(len(ws)) AS all_words, {", ".join(f"sum(n_{c}) / sum(n) AS q_{c}" for c in _NAMES)}
        FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n) > 0),
top AS (SELECT w.lang, word, count(*) AS k, count(*) / any_value(all_words) AS q FROM w JOIN ref USING (lang)
        GROUP BY w.lang, word QUALIFY row_number() OVER (PARTITION BY w.lang ORDER BY k DESC, word) <= {COMMON_WORDS}),
others AS (SELECT lang, all_words, (all_words - coalesce(sum(k), 0)) / all_words AS q FROM ref LEFT JOIN top USING (lang) GROUP BY lang, all_words),
seen AS (SELECT doc_id, w.lang, word, count(*) AS k FROM w SEMI JOIN top ON w.lang = top.lang AND w.word = top.word GROUP BY doc_id, w.lang, word),
parts AS (SELECT seen.doc_id, sum(seen.k) AS k, sum({_HALF.format(p="(seen.k / len(ws))", q="top.q")}) AS s, sum(top.q) AS q
          FROM seen JOIN top ON seen.lang = top.lang AND seen.word = top.word JOIN c ON seen.doc_id = c.doc_id GROUP BY seen.doc_id),
far AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN n > 0 THEN
          sqrt(greatest(0, {" + ".join(_HALF.format(p=f"(n_{c} / n)", q=f"q_{c}") for c in _NAMES)})) END AS cd,
        CASE WHEN len(ws) > 0 THEN sqrt(greatest(0, coalesce(s, 0) + (1 - o.q - coalesce(parts.q, 0)) / 2
          + {_HALF.format(p="((len(ws) - coalesce(k, 0)) / len(ws))", q="o.q")})) END AS wd
        FROM c LEFT JOIN again USING (doc_id) LEFT JOIN ref USING (lang) LEFT JOIN others o USING (lang) LEFT JOIN parts USING (doc_id)),
b AS (SELECT *, len(ws) < 50 OR 100 * n_repeat_words > 50 * len(ws) AS base_failed FROM far)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n - n_space AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(n >= {MIN_CHARS} AND cd > {MAX_CHAR_DISTANCE}, false)
                                OR coalesce(len(ws) >= {MIN_WORDS} AND wd > {MAX_WORD_DISTANCE}, false)) AS kept
FROM b
"""
