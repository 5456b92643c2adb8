"""Approximate nearest neighbours by largest inner product: inverted multi-index.

A vector is cut in halves, each half is quantised with its own codebook, and a cell is a pair of
codes. For a query, pairs of centroids are taken from a heap by summed distance until their cells
hold enough candidates, which are then ranked by the exact inner product. The distance of a half
to a centroid is what its inner product lacks of the best one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut

TOP = 20
QUERY_EVERY = 20
#: Vectors that the codebooks are fitted on, and rounds of fitting.
FIT_ROWS, FIT_ROUNDS, SEED = 20_000, 15, 7
#: Sampled queries, on the same sample, that say what share of all vectors must be looked at.
TUNE_QUERIES = 200
TARGET_RECALL = 0.97
#: Centroids per half: about the fourth root of the rows, so cells and rows per cell grow alike.
MIN_CENTROIDS, MAX_CENTROIDS = 4, 256
#: A query's first cells hold this many times the answer; what they give bounds the others.
FIRST_TIMES = 50
#: Vectors, and queries, of a cell that are compared at a time.
BLOCK = 4096


class Index(NamedTuple):
    books: list[np.ndarray]
    share: float


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: rows that take part. Null, zero or non-finite vectors do not."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    )


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty centroid moves to the row farthest from its own."""
    books = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        far = (books**2).sum(axis=1)[None, :] - 2 * x @ books.T
        code = far.argmin(axis=1)
        n = np.bincount(code, minlength=k)
        sums = np.zeros_like(books)
        np.add.at(sums, code, x)
        books = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], books)
        worst = np.argsort(far[np.arange(len(x)), code] + (x**2).sum(axis=1))[::-1]
        for i, empty in enumerate(np.flatnonzero(n == 0)):
            books[empty] = x[worst[i]]
    return books


def halves(x: np.ndarray) -> list[np.ndarray]:
    cut_at = (x.shape[1] + 1) // 2
    return [x[:, :cut_at], x[:, cut_at:]]


def cells(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    codes = [((b**2).sum(axis=1)[None, :] - 2 * h @ b.T).argmin(axis=1) for h, b in zip(halves(x), books, strict=True)]
    return codes[0] * len(books[1]) + codes[1]


def traverse(query: np.ndarray, books: list[np.ndarray], sizes: np.ndarray, enough: float) -> list[int]:
    """Cells by summed distance until they hold ``enough`` vectors; empty ones are passed over."""
    near = [h @ b.T for h, b in zip(halves(query[None, :]), books, strict=True)]
    lack = [n[0].max() - n[0] for n in near]
    order = [np.argsort(d, kind="stable") for d in lack]
    a, b = lack[0][order[0]], lack[1][order[1]]
    heap, seen, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * len(b) + int(order[1][j])
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (a[i2] + b[j2], i2, j2))
    return out


def fit(distinct: DataFrame, rows: int, top: int = TOP) -> Index | None:
    """Codebooks from a sample of at most ``FIT_ROWS`` vectors, those with the smallest hash, and
    the share of vectors that the sample's own neighbours need for ``TARGET_RECALL``."""
    sample = distinct.select("v").orderBy(F.xxhash64(F.lit(SEED), "v"), "v").limit(FIT_ROWS).collect()
    if not sample:
        return None
    x = np.array([r["v"] for r in sample])
    rng = np.random.default_rng(SEED)
    k = min(len(x), MAX_CENTROIDS, max(MIN_CENTROIDS, round(rows**0.25)))
    books = [kmeans(h, min(k, len(h)), rng) if h.shape[1] else np.zeros((1, 0)) for h in halves(x)]
    sizes = np.bincount(cells(x, books), minlength=len(books[0]) * len(books[1]))
    own = cells(x, books)
    needed = []
    for q in x[:TUNE_QUERIES]:
        best = np.argsort(-(x @ q), kind="stable")[: top + 1]
        order = traverse(q, books, sizes, math.inf)
        before = dict(zip(order, np.cumsum(sizes[order]) / len(x), strict=True))
        needed += [before[c] for c in own[best]]
    return Index(books, min(1.0, float(np.quantile(needed, TARGET_RECALL))))


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the ``top`` nearest found of each query, the rows whose
    id is divisible by ``every``; candidates are all rows with another id.

    Vectors that are null, zero or not finite, and rows without an id, take no part. Equal vectors
    are indexed once and carry their smallest ids, of which no more than ``top + 1`` can ever be in
    an answer; so they have equal scores, and ties go to the smaller id. A row repeated with the
    same id and vector counts once. Vectors must have one length; others are an error. Empty table:
    empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    taking = clean(vectors, id_col, vector_col).distinct()
    # Partial limits before the shuffle keep a vector with very many copies small.
    w = Window.partitionBy("v").orderBy("id")
    first = taking.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top + 1)
    distinct = cut(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = taking.filter(F.col("id") % every == 0)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, lengths = distinct.agg(F.count("*"), F.array_sort(F.collect_set(F.size("v")))).first()
    if len(lengths) > 1:
        raise ValueError(f"vectors of lengths {lengths}")
    index = fit(distinct, rows, top)
    if index is None:
        return empty
    books = spark.sparkContext.broadcast(index.books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").to_pylist())
                yield batch.append_column("cell", pa.array(cells(x, books.value).astype(np.int32)))

    indexed = cut(distinct.mapInArrow(assign, "v array<double>, ids array<long>, cell int"))
    # Fixed size: at most MAX_CENTROIDS ** 2 cells.
    counts = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    sizes[list(counts)] = list(counts.values())
    shared = spark.sparkContext.broadcast((index.books, sizes, max(index.share * rows, 4.0 * top)))
    pieces = {c: -(-n // BLOCK) for c, n in counts.items()}
    most = max(pieces.values())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, enough = shared.value
        for batch in batches:
            ids, vs = batch.column("id").to_pylist(), batch.column("v").to_pylist()
            for i, v in zip(ids, vs, strict=True):
                found = traverse(np.array(v), known, n, enough)
                first = 1 + int(np.searchsorted(np.cumsum(n[found]), FIRST_TIMES * top))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([v], pa.list_(pa.float64())), pa.array([found], pa.list_(pa.int32())), pa.array([first], pa.int32())],
                    names=["id", "v", "cells", "n_first"],
                )

    # Cells with many vectors are cut into blocks; queries go to every block of their cells.
    by_cell = spark.createDataFrame([(c, n) for c, n in pieces.items()], "cell int, pieces int")
    asked = cut(queries.mapInArrow(probe, "id long, v array<double>, cells array<int>, n_first int"))
    blocks = indexed.join(F.broadcast(by_cell), "cell").select(
        "v", "ids", "cell", F.when(F.lit(most) == 1, 0).otherwise(F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).alias("piece")
    )
    place = ["cell", "piece"]
    # A block of one cell holds about BLOCK vectors; queries come to it in lots of the same size.
    packed = blocks.groupBy(*place).agg(F.collect_list(F.struct("v", "ids")).alias("held"))
    n_lots = max(1, asked.count() // BLOCK)

    def ranked(asking: DataFrame) -> DataFrame:
        """Candidates of ``asking(id, v, cells, least)`` that score ``least`` or more."""
        probed = asking.select("id", "v", "least", F.explode("cells").alias("cell")).join(F.broadcast(by_cell), "cell")
        probed = probed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        lots = probed.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(n_lots))).groupBy(*place, "lot").agg(
            F.collect_list(F.struct("id", "v", "least")).alias("asking")
        )
        return lots.join(packed, place).select("held", "asking").mapInArrow(rank, "query_id long, vec_id long, score double")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                held, asking = batch.column("held")[r].as_py(), batch.column("asking")[r].as_py()
                x = np.array([h["v"] for h in held])
                q, s, v = [], [], []
                for a in range(0, len(asking), 256):
                    part = asking[a : a + 256]
                    # One plain sum per pair, so that a score does not depend on its block.
                    near = np.einsum("qd,xd->qx", np.array([p["v"] for p in part]), x)
                    keep = min(top + 1, len(x))
                    best_here = np.partition(near, -keep, axis=1)[:, -keep]
                    for i, p in enumerate(part):
                        least = best_here[i] if p["least"] is None else max(best_here[i], p["least"])
                        good = np.flatnonzero(near[i] >= least)
                        rows_ = sorted(((-near[i, j], c) for j in good for c in held[j]["ids"] if c != p["id"]))[:top]
                        q += [p["id"]] * len(rows_)
                        s += [-n for n, _ in rows_]
                        v += [c for _, c in rows_]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # The first cells of each query give a score that others must reach, so few of those come out.
    first = cut(ranked(asked.select("id", "v", F.slice("cells", F.lit(1), F.col("n_first")).alias("cells"), F.lit(None).cast("double").alias("least"))))
    reached = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == top)
    others = asked.filter(F.size("cells") > F.col("n_first")).select(
        "id", "v", F.slice("cells", F.col("n_first") + 1, F.size("cells")).alias("cells")
    )
    bounded = others.join(reached.select(F.col("query_id").alias("id"), F.col("score").alias("least")), "id", "left")
    return (
        first.union(ranked(bounded))
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
