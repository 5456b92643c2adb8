"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few numbers (``FEATURES``). Each is cut into bins at quantiles of the training
rows. Boosting goes round the features in turn: each time a tree of at most four leaves on that
feature alone is fitted to what is still unexplained, and added, shrunken, to the feature's table
of one value per bin. Then the pairs of features with the most left to explain get tables over
both their (coarser) bins, by trees that cut one feature and then, on each side, the other. A
score is the logistic of the sum of a text's table entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import cut, small

#: Labelled rows that the tables are learned from, those with the smallest hash of their id.
TRAINING_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 64, 12, 10
ROUNDS, PAIR_ROUNDS = 120, 60
RATE, LAMBDA, MIN_LEAF = 0.15, 1.0, 10

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "symbols", "loud", "stops", "other_marks", "beyond_ascii", "distinct_words", "top_word",
    "repeated_lines", "words_per_line", "repeated_triples", "entropy", "marked_words", "short_lines",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars.encode())] = 1
    return out


_LOWER, _UPPER, _DIGITS = (np.array([lo <= b <= hi for b in range(256)], np.float64) for lo, hi in ((97, 122), (65, 90), (48, 57)))
_SYMBOLS, _LOUD, _STOPS, _SPACE = _table("#*$%&|<>"), _table("!?"), _table(".,;:"), _table(" \t\n\v\f\r")
_BEYOND = np.array([b > 127 for b in range(256)], np.float64)
_FIRSTS = np.array([b < 128 or b >= 192 for b in range(256)], np.float64)  # bytes that begin a code point
KINDS = np.stack([_LOWER, _UPPER, _DIGITS, _SYMBOLS, _LOUD, _STOPS, _SPACE, _BEYOND, _FIRSTS], axis=1)


def features(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of ``FEATURES``; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    lower, upper, digits, symbols, loud, stops, space, beyond, firsts = (counts @ KINDS).tolist()
    solid = max(len(raw) - space, 1.0)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    shares = counts[counts > 0] / len(raw)
    return [
        math.log1p(n),
        (firsts - space) / n,
        sum(len(w) > 14 for w in words) / n,
        upper / max(lower + upper, 1.0),
        digits / solid,
        symbols / n,
        loud / n,
        stops / n,
        (solid - lower - upper - digits - symbols - loud - stops - beyond) / n,
        beyond / solid,
        len(seen) / n,
        max(seen.values()) / n,
        1.0 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        1.0 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0,
        float(-(shares * np.log2(shares)).sum()),
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(len(line) < 20 for line in lines) / len(lines),
    ]


class Model(NamedTuple):
    """Bin edges and tables. A value's bin is the number of edges not above it; ``coarse`` takes
    the bins of a feature to its bins in pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]


def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value of ``x`` (rows, features), one row of bins per feature."""
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1: one table entry per feature and pair is added up."""
    total = np.full(len(x), model.base)
    at = bins(x, model.edges)
    for b, t in zip(at, model.tables, strict=True):
        total += t[b]
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        total += t[model.coarse[i][at[i]], model.coarse[j][at[j]]]
    return logistic(total)


def _worth(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a leaf with these sums gains; too small a leaf is ruled out."""
    return np.where(n >= MIN_LEAF, g * g / (h + LAMBDA), -np.inf)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of these bins; place 0 if none helps."""
    if len(g) < 2:
        return 0.0, 0
    a, b, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gains = _worth(a, b, c) + _worth(g.sum() - a, h.sum() - b, n.sum() - c) - g.sum() ** 2 / (h.sum() + LAMBDA)
    k = int(np.argmax(gains))
    return (float(gains[k]), k + 1) if gains[k] > 1e-9 else (0.0, 0)


def step_of(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One tree of at most four leaves over the bins of a feature: a value per bin."""
    _, first = _cut(g, h, n)
    borders = [0, len(g)] if not first else [0, first, len(g)]
    if first:
        for s, e in ((0, first), (first, len(g))):
            _, k = _cut(g[s:e], h[s:e], n[s:e])
            if k:
                borders.append(s + k)
    borders.sort()
    out = np.zeros(len(g))
    for s, e in zip(borders, borders[1:], strict=False):
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + LAMBDA)
    return out


def _halves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every cut of the first axis: sums over its two sides, with running sums along the second."""
    low = np.cumsum(np.cumsum(m, axis=0)[:-1], axis=1)
    return low, np.cumsum(m.sum(axis=0))[None, :] - low


def pair_step(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one axis once and then each side along the other axis."""
    best, out = 0.0, np.full(g.shape, g.sum() / (h.sum() + LAMBDA))
    for flipped in (False, True):
        a, b, c = (m.T if flipped else m for m in (g, h, n))
        if len(a) < 2:
            continue
        sides = list(zip(_halves(a), _halves(b), _halves(c), strict=True))
        gains, cuts = [], []
        for x, y, z in sides:
            whole = _worth(x[:, -1], y[:, -1], z[:, -1])
            parted = _worth(x[:, :-1], y[:, :-1], z[:, :-1]) + _worth(x[:, -1:] - x[:, :-1], y[:, -1:] - y[:, :-1], z[:, -1:] - z[:, :-1])
            parted = np.concatenate([np.full((len(whole), 1), -np.inf), parted], axis=1)
            k = np.argmax(parted, axis=1)
            top = parted[np.arange(len(k)), k]
            gains.append(np.maximum(top, whole))
            cuts.append(np.where(top > whole, k, 0))
        total = gains[0] + gains[1] - g.sum() ** 2 / (h.sum() + LAMBDA)
        r = int(np.argmax(total))
        if total[r] > best:
            best = float(total[r])
            values = np.zeros(a.shape)
            for (s, e), k in zip(((0, r + 1), (r + 1, a.shape[0])), (cuts[0][r], cuts[1][r]), strict=True):
                for u, v in ((0, k), (k, a.shape[1])):
                    if u < v:
                        values[s:e, u:v] = a[s:e, u:v].sum() / (b[s:e, u:v].sum() + LAMBDA)
            out = values.T if flipped else values
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from rows ``x`` and targets ``y`` between 0 and 1. No rows: every score is a half."""
    n_features = x.shape[1]
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    base = math.log(rate / (1 - rate))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) if len(x) else np.zeros(0) for f in range(n_features)]
    at = bins(x, edges)
    sizes = [len(e) + 1 for e in edges]
    tables = [np.zeros(s) for s in sizes]
    coarse = []
    for f, s in enumerate(sizes):
        held = np.cumsum(np.bincount(at[f], minlength=s))
        coarse.append(np.minimum(held * PAIR_BINS // max(len(x) + 1, 1), PAIR_BINS - 1).astype(np.int64) if len(x) else np.zeros(s, np.int64))
    if not len(x):
        return Model(base, edges, tables, coarse, [], [])
    counted = [np.bincount(b, minlength=s).astype(np.float64) for b, s in zip(at, sizes, strict=True)]
    total = np.full(len(x), base)

    def sums(b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = logistic(total)
        return np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size)

    for _ in range(ROUNDS):
        for f in range(n_features):
            step = RATE * step_of(*sums(at[f], sizes[f]), counted[f])
            tables[f] += step
            total += step[at[f]]
    both, shapes, ranked = {}, {}, []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            shape = (int(coarse[i][-1]) + 1, int(coarse[j][-1]) + 1)
            b = coarse[i][at[i]] * shape[1] + coarse[j][at[j]]
            g, h = sums(b, shape[0] * shape[1])
            gain, _ = pair_step(g.reshape(shape), h.reshape(shape), np.bincount(b, minlength=shape[0] * shape[1]).reshape(shape))
            ranked.append((-gain, i, j))
            both[i, j], shapes[i, j] = b, shape
    pairs = [(i, j) for gain, i, j in sorted(ranked)[:PAIRS] if gain < 0]
    pair_tables = [np.zeros(shapes[p]) for p in pairs]
    pair_counts = [np.bincount(both[p], minlength=t.size).reshape(t.shape) for p, t in zip(pairs, pair_tables, strict=True)]
    for _ in range(PAIR_ROUNDS):
        for p, t, n in zip(pairs, pair_tables, pair_counts, strict=True):
            g, h = sums(both[p], t.size)
            step = RATE * pair_step(g.reshape(t.shape), h.reshape(t.shape), n)[1]
            t += step
            total += step.ravel()[both[p]]
    # Tables are centred, so that an entry says how a bin differs from the average.
    for t, n in zip([*tables, *pair_tables], [*counted, *pair_counts], strict=True):
        mean = float((t * n).sum() / n.sum())
        t -= mean
        base += mean
    return Model(base, edges, tables, coarse, pairs, pair_tables)


def held_out(doc_id="doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    """True for rows whose labels are never learned; a null id has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_table(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """``doc_id, y, x`` of at most ``most`` labelled documents outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out())
        .groupBy("doc_id").agg(F.avg("y").alias("y"))
    )
    here = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = cut(here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # At most ``most`` ids, so the broadcast is bounded; texts are not moved.
    texts = docs.filter("doc_id is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, x array<double>")
    return found.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y")


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", training_rows: int = TRAINING_ROWS) -> Model:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, <label_col>)``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = training_table(narrow, labels, label_col, training_rows).orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], np.float64))


def judge(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            p = score(shared.value, x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", training_rows: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from ``labels`` outside the held-out fold and score every row of ``docs(doc_id, text)``.

    Nulls: a null text is an empty one, a null doc_id is never held out nor learned from, labels
    that are null or neither 0 nor 1 are passed over. Empty texts are scored like others, from
    features that are all zero. Texts are read whole, however long. A document with several labels
    counts with their mean, one that occurs several times is learned from once (with the smallest
    features) and scored each time. Without any label to learn from every score is a half. Empty
    table: empty result. Other columns of either table are not read.

    At most ``training_rows`` labelled documents are learned from; each row is scored on its own,
    where it was read.
    """
    return judge(docs, learn(docs, labels, label_col=label_col, training_rows=training_rows), threshold=threshold)
