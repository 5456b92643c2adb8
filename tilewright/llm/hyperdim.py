"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is the product of its
letters' vectors, each rotated by its distance from the end (binding); a text is the sum of its
runs (bundling). A language's prototype is the sum of its texts, and a text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import held_alone, small

DIMENSIONS = 2048
GRAM = 3
UNKNOWN = "und"
#: Letter vectors and runs that a worker remembers.
KNOWN_LETTERS = 4096
KNOWN_GRAMS = 16_384
#: Documents compared at a time.
BLOCK_DOCS = 64
#: Documents whose vectors are held at a time.
HELD_DOCS = 256
#: Runs whose vectors are multiplied at a time.
STEP_GRAMS = 2048
#: Prototypes are brought to the driver, one per language value; more values are an error.
MAX_LANGUAGES = 1024
#: Words are runs of letters; what is between them counts as one gap.
#: Numbers that are no decimal digits (fractions, Roman numerals, superscripts) are word characters to
#: regular expressions, but no letters. They are looked for apart, the few beyond 16 bits only in texts
#: with such characters: mixed sets would be tried one by one at every character.
_NUMERALS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()]
NUMERAL = re.compile("[" + "".join(c for c in _NUMERALS if c <= "\uffff") + "]")
FAR_NUMERAL = re.compile("[" + "".join(c for c in _NUMERALS if c > "\uffff") + "]")
FAR = re.compile("[\U00010000-\U0010ffff]")
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters of a text."""
    if not text.isascii():
        text = NUMERAL.sub(" ", text)
        if FAR.search(text):
            text = FAR_NUMERAL.sub(" ", text)
    return LETTERS.findall(text)


@lru_cache(KNOWN_LETTERS)
def letter_vector(letter: str, dimensions: int) -> np.ndarray:
    """+1 and -1 drawn from the letter alone, so every worker has the same ones."""
    seed = int.from_bytes(hashlib.blake2b(letter.encode("utf-8", "replace"), digest_size=8).digest(), "big")
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def gram_vector(gram: str, dimensions: int) -> np.ndarray:
    out = np.ones(dimensions, np.int8)
    for i, letter in enumerate(gram):
        out = out * np.roll(letter_vector(letter, dimensions), len(gram) - 1 - i)
    return out


class Grams:
    """Vectors of the runs met so far, as rows of one matrix."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.row: dict[int, int] = {}
        self.matrix = np.zeros((KNOWN_GRAMS, dimensions), np.int8)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        if len(self.row) + len(keys) > KNOWN_GRAMS:
            self.row.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            at = self.row.get(key)
            if at is None:
                at = self.row[key] = len(self.row)
                self.matrix[at] = gram_vector("".join(chr(key >> s & 0x1FFFFF) for s in (42, 21, 0)), self.dimensions)
            out[i] = at
        return out


def grams(dimensions: int) -> Grams:
    return held_alone(Grams, dimensions)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three code points, packed into integers, and how often each comes. No letter: none."""
    words = letter_runs((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


def bundles(texts: list[str | None], dimensions: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """One bundled vector per text, as exact whole numbers in double precision. ``sizes`` receives
    the number of runs of each text."""
    out = np.zeros((len(texts), dimensions))
    if sizes is not None:
        sizes[:] = 0
    known = grams(dimensions)
    for s in range(0, len(texts), BLOCK_DOCS):
        counted = [gram_counts(t) for t in texts[s : s + BLOCK_DOCS]]
        if sizes is not None:
            sizes[s : s + len(counted)] = [c.sum() for _, c in counted]
        keys, inverse = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        if not len(keys):
            continue
        owner = np.repeat(np.arange(len(counted)), [len(k) for k, _ in counted])
        # In steps, so that neither the counts nor the vectors of many rare runs are all in memory.
        for a in range(0, len(keys), STEP_GRAMS):
            here = (inverse >= a) & (inverse < a + STEP_GRAMS)
            counts = np.zeros((len(counted), min(STEP_GRAMS, len(keys) - a)), np.float32)
            counts[owner[here], inverse[here] - a] = np.concatenate([c for _, c in counted])[here]
            rows = known.rows(keys[a : a + STEP_GRAMS])
            vectors = known.matrix[rows].astype(np.float32)
            # Sums below 2 ** 24 are exact in single precision; longer texts are summed in double.
            exact = counts.sum() < 1 << 24
            out[s : s + len(counted)] += counts @ vectors if exact else counts.astype(np.float64) @ vectors
    return out


def learn(docs: DataFrame, *, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from every row of ``docs(text, lang)`` with a language; rows without are left out.

    Each task adds up its texts first; the sums are added per language and dimension in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = np.array(batch.column("text").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                of = texts[langs == lang]
                for s in range(0, len(of), HELD_DOCS):
                    sums[lang] = sums.get(lang, 0) + bundles(of[s : s + HELD_DOCS].tolist(), dimensions).sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)],
                names=["lang", "at", "total"],
            )

    parts = docs.filter("lang is not null and text is not null").select("lang", "text")
    summed = parts.mapInArrow(run, "lang string, at int, total double").groupBy("lang", "at").agg(F.sum("total").alias("total"))
    whole = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("v"))
    found = whole.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    learned = {r["lang"]: np.array([x["total"] for x in r["v"]]) for r in sorted(found, key=lambda r: r["lang"])}
    return {k: v for k, v in learned.items() if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score``, ``margin`` and ``n_runs`` per row of ``docs``.

    Only the text is looked at. ``score`` is the best cosine, cut at 0; ``margin`` its distance to
    the second best; ``n_runs`` counts the letter runs compared. A null text, one without a letter, or no prototype: ``und`` with score 0.
    Ties go to the first language by name. Empty table: empty result.
    """
    names = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(
        np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), dimensions)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(text).to_pylist()
            pred, score, margin, length = [], [], [], []
            for s in range(0, len(texts), HELD_DOCS):
                runs = np.zeros(len(texts[s : s + HELD_DOCS]), np.int64)
                vectors = bundles(texts[s : s + HELD_DOCS], dimensions, runs)
                length += runs.tolist()
                size = np.linalg.norm(vectors, axis=1)
                if names:
                    near = vectors @ shared.value.T / np.where(size > 0, size, 1)[:, None]
                    best = near.argmax(axis=1)
                    top = near[np.arange(len(near)), best]
                    second = np.partition(near, -2, axis=1)[:, -2] if len(names) > 1 else np.zeros(len(near))
                else:
                    best = top = second = np.zeros(len(vectors))
                ok = (size > 0) & bool(names)
                pred += [names[int(b)] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
                score += np.where(ok, np.clip(top, 0, 1), 0.0).tolist()
                margin += np.where(ok, top - second, 0.0).tolist()
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(length, pa.int64())],
                names=[*keep, "lang_pred", "score", "margin", "n_runs"],
            )

    narrow = docs.select(*dict.fromkeys([*keep, text]))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, margin double, n_runs long")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fixed quarter of documents that is never learned from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin`` per row of ``docs(doc_id, text, lang)``."""
    prototypes = learn(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin")


#: A text is rejected if it is nearly orthogonal to every language, like random letters. Of fewer
#: runs than these, a low cosine says nothing.
LEAST_SCORE = 0.1
LEAST_RUNS = 40


def keep_identified(docs: DataFrame, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language can be told, with all columns: has a letter and, unless it is
    too short to say, a cosine of at least ``least_score`` with some language."""
    prototypes = learn(docs.filter(~held_out()))
    if not prototypes:  # nothing was learned, so nothing can be told apart
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # Plain numbers for names, so that no column of the input can clash with the new ones.
    numbered = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    scored = identify(numbered, prototypes, keep=tuple(numbered.columns), text=f"_{docs.columns.index('text')}")
    good = scored.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= least_score) | (F.col("n_runs") < LEAST_RUNS)))
    return good.select(*numbered.columns).toDF(*docs.columns)
