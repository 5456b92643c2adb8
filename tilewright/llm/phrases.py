"""Collocations by multikey three-way quicksort of suffixes.

Every word of a piece of text starts a suffix, of which only the first few words matter. Suffixes
are routed by their leading words, so that all with the same beginning meet in one bucket; there
they are sorted by three-way quicksort on one word after the other. The part equal to a pivot word
is the set of suffixes with one beginning, so its size is that phrase's count and it is sorted on by
the next word, down to the longest phrase. Parts with too few suffixes are abandoned unsorted.

A beginning that holds too many suffixes for one bucket is routed by one more word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut, small
from tilewright.operators.skew import salted_join

MIN_COUNT, MIN_WORDS, MAX_WORDS = 10, 2, 3
TOP, SCALE = 2000, 1_000_000
#: A candidate goes if a longer one that holds it has so many hundredths of its count.
COVERED = 50
NO_LANGUAGE = "und"
#: Words (and different ones) that are turned into suffixes at a time, and bytes of text cut into words at a time.
#: Together they stay below the numbers of words that fit into WORD_BITS.
CHUNK_WORDS, CHUNK_BYTES = 1_000_000, 2 << 20
WORD_BITS = 21
#: Bytes of text whose suffixes go to one bucket on average.
BUCKET_BYTES = 12 << 20
#: Ranks per language are first taken in so many parts.
PARTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, ends of pieces to a line end, tabs to spaces.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")
SUFFIXES = "bucket int, lang string, given int, words binary, keys binary, counts binary"
COUNTS = "lang string, phrase string, m int, f long, partial boolean"


def slices(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``raw`` (plain) in parts that end at white space."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(b" ", at, at + size), raw.rfind(b"\n", at, at + size))
        if end < 0:
            ends = [e for e in (raw.find(b" ", at), raw.find(b"\n", at)) if e >= 0]
            end = min(ends, default=len(raw) - 1)
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


class Words(dict):
    """Words of one language in a chunk, numbered on from those of the others."""

    def __init__(self, chunk: Chunk, lang: str) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.chunk, self.lang = chunk, lang

    def __missing__(self, word: bytes) -> int:
        n = len(self.chunk.words)
        self.chunk.words.append(word)
        self.chunk.langs.append(self.lang)
        self[word] = n
        return n


class Chunk:
    """Word numbers of running text; number 0 ends a piece."""

    def __init__(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.known: dict[str, Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, plain: bytes) -> int:
        """Add plain text; returns the number of words and ends of pieces in it."""
        if lang not in self.known:
            self.known[lang] = Words(self, lang)
        tokens = plain.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.known[lang].__getitem__, tokens), np.int32, len(tokens))
        ids = ids[ids >= 0]
        self.parts.append(ids)
        self.size += len(ids)
        return len(ids)

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS or len(self.words) >= CHUNK_WORDS


def chunks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Chunk, np.ndarray]]:
    """Chunks of ``text, lang`` rows, each with the beginnings of its suffixes: one row of ``longest``
    word numbers each, filled up with 0. A text cut between chunks takes its last words along."""

    def done(chunk: Chunk, open_words: int) -> tuple[np.ndarray, list[bytes]]:
        ids = np.concatenate([*chunk.parts, np.zeros(longest, np.int32)])
        n = len(ids) - longest - open_words
        columns, live = [ids[:n]], np.ones(n, bool)
        for d in range(1, longest):
            live = live & (columns[-1] > 0)
            columns.append(np.where(live, ids[d : d + n], 0))
        keys = np.stack(columns, axis=1)
        return keys[keys[:, 0] > 0], [chunk.words[i] or b"\n" for i in ids[n : len(ids) - longest]]

    chunk = Chunk()
    for batch in small(batches):
        for raw, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if not raw:
                continue
            own = 0  # words of this text that are in the chunk
            for part in slices(raw.translate(PLAIN)):
                own += chunk.add(lang, part)
                if chunk.full():
                    keys, rest = done(chunk, min(longest - 1, own))
                    yield chunk, keys
                    chunk = Chunk()
                    own = chunk.add(lang, b" ".join(rest))
            chunk.add(lang, b"\n")
    keys, _ = done(chunk, 0)
    yield chunk, keys


def packed(keys: np.ndarray) -> np.ndarray:
    """Up to three word numbers in one integer."""
    out = keys[:, 0].astype(np.int64)
    for d in range(1, keys.shape[1]):
        out = out << WORD_BITS | keys[:, d]
    return out


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    )


def heavy(docs: DataFrame, share: float, longest: int) -> DataFrame:
    """``lang, phrase, m, n``: beginnings of fewer than ``longest`` words with at least half of ``share``
    of a chunk, and their number there; with an empty phrase, all words of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, keys in chunks(batches, longest):
            out = []
            per_word = np.bincount(keys[:, 0], minlength=len(chunk.words))
            per_lang: dict[str, int] = {}
            for i in np.flatnonzero(per_word):
                per_lang[chunk.langs[i]] = per_lang.get(chunk.langs[i], 0) + int(per_word[i])
            out += [(lang, "", 0, n) for lang, n in per_lang.items()]
            least = max(2.0, share / 2 * len(keys))
            left = keys
            for m in range(1, longest):
                _, first, inverse, n = np.unique(packed(left[:, :m]), return_index=True, return_inverse=True, return_counts=True)
                many = n >= least
                for row, c in zip(left[first[many]], n[many], strict=True):
                    if row[m - 1]:
                        out.append((chunk.langs[row[0]], b" ".join(chunk.words[w] for w in row[:m]).decode("utf-8", "replace"), m, int(c)))
                left = left[many[inverse]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)],
                names=["lang", "phrase", "m", "n"],
            )

    return texts(docs).mapInArrow(run, "lang string, phrase string, m int, n long").groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n"))


def beginnings(packed_keys: np.ndarray, m: int, longest: int) -> np.ndarray:
    """The first ``m`` words of packed suffixes, packed."""
    return packed_keys >> (WORD_BITS * (longest - m))


class Routes(NamedTuple):
    """Number of buckets, and the beginnings that are routed by one more word."""

    buckets: int
    hot: list[tuple[str, list[bytes]]]
    longest: int

    def depth(self, chunk: Chunk, keys: np.ndarray) -> np.ndarray:
        """How many leading words route each of these packed suffixes."""
        here: list[list[int]] = [[] for _ in range(self.longest)]
        for lang, words in self.hot:
            ids = [chunk.known[lang].get(w) for w in words] if lang in chunk.known else [None]
            if None not in ids:
                here[len(words)].append(int(packed(np.array([ids], np.int64))[0]))
        out = np.ones(len(keys), np.int64)
        for m in range(1, self.longest):
            if here[m]:
                out[np.isin(beginnings(keys, m, self.longest), here[m])] = m + 1
        return out


def route(docs: DataFrame, shared, longest: int) -> DataFrame:
    """Suffixes in lots: one row per chunk, bucket, language and number of words that are routed by
    beyond the first. ``keys`` are numbers into ``words``, from 1, one column after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = shared.value
        for chunk, keys in chunks(batches, longest):
            if not len(keys):
                continue
            both = np.sort(packed(keys))
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            counts, both = np.diff(np.r_[first, len(both)]).astype(np.int32), both[first]
            depth = routes.depth(chunk, both)
            columns = [(beginnings(both, d + 1, longest) & ((1 << WORD_BITS) - 1)).astype(np.int32) for d in range(longest)]
            numbers = {lang: i for i, lang in enumerate(chunk.known)}
            lang_of = np.array([numbers.get(x, 0) for x in chunk.langs], np.int64)
            seeds = {x: zlib.crc32(x.encode("utf-8", "replace")) for x in set(chunk.langs)}
            own = np.array([zlib.crc32(w, seeds[x]) for w, x in zip(chunk.words, chunk.langs, strict=True)], np.uint64)
            mixed = np.zeros(len(both), np.uint64)
            for d, column in enumerate(columns):
                mixed = (mixed ^ np.where(depth > d, own[column] + np.uint64(d + 1), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            to = (mixed % np.uint64(routes.buckets)).astype(np.int64)
            place = (to * longest + depth - 1) * len(numbers) + lang_of[columns[0]]
            most = routes.buckets * longest * len(numbers)
            order = np.argsort(place.astype(np.uint16) if most < 1 << 16 else place, kind="stable")  # short numbers are sorted by radix
            place, counts = place[order], counts[order]
            columns = [c[order] for c in columns]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            names = list(numbers)
            used, local = np.zeros(len(chunk.words), bool), np.zeros(len(chunk.words), np.int32)
            for s, e in zip(starts, np.r_[starts[1:], len(order)], strict=True):
                part = [c[s:e] for c in columns]
                for c in part:
                    used[c] = True
                used[0] = False
                held = np.flatnonzero(used)
                used[held] = False
                local[held] = np.arange(1, len(held) + 1)
                at = int(place[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in (
                        (at // len(names) // longest, pa.int32()), (names[at % len(names)], pa.string()), (at // len(names) % longest, pa.int32()),
                        (b"\n".join([chunk.words[i] for i in held]), pa.binary()), (b"".join(local[c].tobytes() for c in part), pa.binary()),
                        (counts[s:e].tobytes(), pa.binary()),
                    )],
                    names=["bucket", "lang", "given", "words", "keys", "counts"],
                )

    return texts(docs).mapInArrow(run, SUFFIXES)


def multikey(keys: np.ndarray, weights: np.ndarray, least: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Three-way quicksort of pointers to the rows of ``keys``, one word after the other.

    Yields, part by part, the pointers, depths and weights of beginnings: ``depth`` leading words of
    that row occur with this summed weight. Parts below ``least[depth]`` are abandoned, and so are
    those that have come to the end of a piece. All parts of a round are split at the same time.
    """
    longest = keys.shape[1]
    pointers = np.arange(len(keys))
    start, size, depth = np.array([0]), np.array([len(keys)]), np.array([0])
    needed = np.array([*least, np.inf])
    if not len(keys):
        return
    while len(size):
        part = np.repeat(np.arange(len(size)), size)
        word = keys[pointers, depth[part]]
        middle = [word[start], word[start + size // 2], word[start + size - 1]]
        pivot = np.maximum(np.minimum(middle[0], middle[1]), np.minimum(np.maximum(middle[0], middle[1]), middle[2]))
        side = np.sign(word - pivot[part]).astype(np.int64) + 1
        code = part * 3 + side
        n = np.bincount(code, minlength=3 * len(size))
        mass = np.bincount(code, weights[pointers], 3 * len(size))
        # Where each pointer goes: its side's place, in the order in which they came.
        first = np.cumsum(n) - n
        moved = np.empty_like(pointers)
        for c in range(3):
            of = np.flatnonzero(side == c)
            before = np.cumsum(n[c::3]) - n[c::3]
            moved[first[code[of]] + np.arange(len(of)) - before[part[of]]] = pointers[of]
        pointers = moved
        sides = np.tile([0, 1, 2], len(size))
        deep = np.repeat(depth, 3) + (sides == 1)
        keep = (n > 0) & (mass >= needed[np.repeat(depth, 3)])
        ended = (sides == 1) & (np.repeat(pivot, 3) == 0)
        found = np.flatnonzero(keep & (sides == 1) & ~ended)
        yield pointers[first[found]], deep[found], mass[found].astype(np.int64)
        keep &= ~ended & (deep < longest)
        held = np.flatnonzero(keep)
        total = n[held]
        ends = np.cumsum(total)
        pointers = pointers[np.repeat(first[held] - (ends - total), total) + np.arange(int(ends[-1]) if len(ends) else 0)]
        start, size, depth = ends - total, total, deep[held]


class Numbers(dict):
    """Numbers from 1 in the order in which they are asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def count_bucket(table: pa.Table, longest: int, least: int) -> pa.Table:
    """Counts of the phrases that begin in one bucket."""
    known = Numbers()
    parts, weights = [], []
    for words, keys, counts in zip(*(table.column(c).to_pylist() for c in ("words", "keys", "counts")), strict=True):
        found = words.split(b"\n")
        own = np.zeros(len(found) + 1, np.int32)
        own[1:] = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
        parts.append(own[np.frombuffer(keys, np.int32).reshape(longest, -1).T])
        weights.append(np.frombuffer(counts, np.int32))
    keys, weight = np.concatenate(parts), np.concatenate(weights).astype(np.float64)
    names = [b"", *known]
    given = table.column("given")[0].as_py()
    # Beginnings that are shared with other buckets are counted in part here, so none is too small.
    limits = [1.0 if d < given else float(least) for d in range(longest)]
    phrases, depths, counts = [], [], []
    for rows, deep, n in multikey(keys, weight, limits):
        for r, d in zip(keys[rows].tolist(), deep.tolist(), strict=True):
            phrases.append(b" ".join([names[w] for w in r[:d]]).decode("utf-8", "replace"))
        depths.append(deep)
        counts.append(n)
    m = np.concatenate([*depths, np.zeros(0, np.int64)])
    lang = table.column("lang")[0].as_py()
    return pa.table(
        [pa.array([lang] * len(m), pa.string()), pa.array(phrases, pa.string()), pa.array(m.astype(np.int32)),
         pa.array(np.concatenate([*counts, np.zeros(0, np.int64)])), pa.array(m <= given)],
        names=["lang", "phrase", "m", "f", "partial"],
    )


def _key(phrase: Column) -> Column:
    """Language and phrase in one; no phrase holds a line end."""
    return F.concat_ws("\n", "lang", phrase)


def scored(found: DataFrame, *, min_words: int = MIN_WORDS, covered: int = COVERED, scale: int = SCALE) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates among ``found(lang, phrase, m, f)`` that no
    longer one covers. Every part of a candidate is in ``found``, as it occurs at least as often."""
    words = found.filter(F.col("m") >= min_words).select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    for side, part in (("l", F.slice("w", F.lit(1), F.col("k"))), ("r", F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")))):
        lookup = found.select(_key(F.col("phrase")).alias("_key"), F.col("f").alias(side))
        cuts = salted_join(cuts.withColumn("_key", _key(F.array_join(part, " "))), lookup, "_key").drop("_key")
    exact = f"cast({scale} * cast(a as decimal(14, 0)) * cast(a as decimal(14, 0)) div (cast(l as decimal(14, 0)) * cast(r as decimal(14, 0))) as long)"
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("c"))
    longer = words.filter(F.col("m") > min_words).select(
        "lang", "a", F.explode(F.sequence(F.lit(min_words), F.col("m") - 1)).alias("n"), "w", "m"
    ).select("lang", "a", F.explode(F.expr("transform(sequence(1, m - n + 1), s -> array_join(slice(w, s, n), ' '))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"coalesce(100 * _longer < {covered} * a, true)"))
    return kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each language and their ``rank``. A language is ranked in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = parted.withColumn("_rn", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rn") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("_rn", "_part")


def mine(
    docs: DataFrame, *, min_count: int = MIN_COUNT, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, top: int = TOP,
    covered: int = COVERED, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of ``min_words`` to ``max_words`` (at
    most 3) words per language of ``docs(text, lang)``.

    ``a`` is a phrase's count, ``l`` and ``r`` those of the two sides of its lowest-scoring cut, ``n``
    the language's words. Counting goes over whole texts and all documents; a text of any length is
    read in parts. A null text is empty, a null lang is ``und``. Repeated rows count each. Ties are
    ordered by phrase, so the result is unique. Empty table, or no phrase often enough: empty
    result. Other columns are not read.

    Each suffix is shuffled once, as numbers in lots that hold equal ones only once. A beginning
    with more than half a bucket's share is routed by one more word, and its own count added up from
    the buckets; there are at most four such beginnings per bucket and number of words, whose list
    goes to all tasks.
    """
    if not 2 <= min_words <= max_words <= 63 // WORD_BITS:
        raise ValueError("phrases of 2 to 3 words are counted")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    share = 1 / (2 * buckets)
    many = cut(heavy(docs, share, max_words))
    totals = many.filter("m = 0").select("lang", "n")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    if not everything:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    hot = many.filter((F.col("m") > 0) & (F.col("n") >= share / 2 * everything)).select("lang", "phrase").collect() if buckets > 1 else []
    routes = spark.sparkContext.broadcast(Routes(buckets, [(r["lang"], r["phrase"].encode().split(b" ")) for r in hot], max_words))
    lots = route(docs, routes, max_words)

    def run(table: pa.Table) -> pa.Table:
        return count_bucket(table, max_words, min_count)

    counted = cut(lots.groupBy("bucket", "lang", "given").applyInArrow(run, COUNTS))
    shared = counted.filter("partial").groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    found = counted.filter("not partial").select("lang", "phrase", "m", "f").unionByName(shared)
    best = best_of(scored(found, min_words=min_words, covered=covered), top)
    # One row per language; a join by language would gather it in one task, but its rows are few by now.
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SCORE = f"CAST((CAST({SCALE} AS HUGEINT) * g.f * g.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT)"
ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
      FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
i AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, {MAX_WORDS + 1}) AS s(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= {MIN_WORDS} AND f >= {MIN_COUNT}),
c AS (SELECT g.lang, g.phrase, g.f AS a, l.f AS l, r.f AS r, {_SCORE} AS score, k
      FROM g JOIN range(1, {MAX_WORDS}) AS s(k) ON k < g.m
      JOIN f l ON l.lang = g.lang AND l.phrase = array_to_string(ws[1:k], ' ')
      JOIN f r ON r.lang = g.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY g.lang, g.phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(f) AS longer
      FROM (SELECT lang, f, array_to_string(ws[s:s + {MIN_WORDS} - 1], ' ') AS phrase FROM (SELECT lang, f, ws, unnest(range(1, m - {MIN_WORDS} + 2)) AS s FROM g WHERE m > {MIN_WORDS}))
      GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM c LEFT JOIN o USING (lang, phrase) JOIN n USING (lang) WHERE coalesce(100 * longer < {COVERED} * a, true)
QUALIFY rank <= {TOP}
"""
