"""Hard-negative mining by threshold joins over an inverted index (after L2AP).

Vectors become integers and lie in blocks. A block's index has one list per dimension; dimensions
come by falling mean square, so that what remains of a vector gets short soon. For a threshold, a
row is in the lists of its leading dimensions only: the rest is left out as soon as its norm times
the largest norm that a query has there is below the threshold, since no score can come from it
alone. Queries go through the lists adding up partial scores; pairs whose partial score plus the
product of the remaining norms is below the query's threshold are dropped, the others are finished
from the rows themselves. Thresholds start where a few results are expected and are lowered for
those queries whose windows have not filled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
#: Negatives score from 30 to 90 hundredths of the positive.
LOW, HIGH = 30, 90
#: Vectors of a block, anchors that are sent to all tasks at a time, and those of them compared with a block at a time.
BLOCK, LOT, ASKING = 4096, 8192, 128
#: Dimensions between two looks at the bounds.
STEP = 8
#: Pairs are finished one by one when fewer than one in so many is left.
SPARSE = 16
#: Results that the first threshold is set for, times the window; then the gap grows by this factor.
AIM, WIDEN = 3.0, 4.0
#: Thresholds lowered so often without filling a window go to its end.
MAX_ROUNDS = 8
#: Doubles hold whole numbers up to here exactly.
EXACT = 2.0**53
BLOCKS = "ids array<array<long>>, labels array<long>, dims int, data binary"


class Lot(NamedTuple):
    """Anchors and, for each, windows of scores (from, to, smallest wanted score)."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    same: bool
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, relabel_every: int, labels: int) -> DataFrame:
    """``id, label, v``: rows with all three, finite numbers only, as whole numbers."""
    raw = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter("id is not null and label is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return raw.filter(finite).select("id", moved.alias("label"), F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``v, label, ids``: equal vectors of one label once, with their ``most`` smallest ids; no
    answer can hold more of them. Partial limits keep a vector with very many copies small."""
    w = Window.partitionBy("v", "label").orderBy("id")
    first = rows.distinct().withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    return first.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def moments(distinct: DataFrame) -> list[tuple[float, float]]:
    """Mean and mean square of every dimension, over rows; one row per dimension reaches the driver."""
    found = (
        distinct.select(F.size("ids").alias("n"), F.posexplode("v").alias("d", "x"))
        .groupBy("d").agg(F.sum(F.col("n") * F.col("x").cast("double")).alias("s"), F.sum(F.col("n") * F.col("x").cast("double") ** 2).alias("q"), F.sum("n").alias("n"))
    )
    return [(r["s"] / r["n"], r["q"] / r["n"]) for r in found.orderBy("d").collect()]


def blocks(distinct: DataFrame, order: np.ndarray) -> DataFrame:
    """Rows in blocks, their dimensions in this order; shorter vectors are filled up with zeros."""
    dims = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                v = part.column("v")
                sizes = np.diff(v.offsets.to_numpy())
                x = np.zeros((part.num_rows, dims), np.int64)
                x[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = v.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([part.column("label").to_pylist()], pa.list_(pa.int64())),
                     pa.array([dims], pa.int32()), pa.array([np.ascontiguousarray(x[:, order]).tobytes()], pa.binary())],
                    names=["ids", "labels", "dims", "data"],
                )

    return distinct.mapInArrow(run, BLOCKS)


def tail_norms(x: np.ndarray) -> np.ndarray:
    """Per row, the norm of what is left from every dimension on; the last column is zero."""
    square = np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([square, np.zeros((len(x), 1))], axis=1))


def matches(x: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (row of ``x``, row of ``q``) whose inner product is at least ``least`` of the
    query, with that product. ``x`` and ``q`` hold whole numbers as doubles; a ``least`` of minus
    infinity takes every pair."""
    dims = x.shape[1]
    rx, rq = tail_norms(x), tail_norms(q)
    slack = 1 + 1e-9
    # How many leading dimensions of each row are in the lists.
    lowest = least.min() if len(least) else math.inf
    may = rx * rq.max(axis=0) * slack >= lowest  # what is left could reach the lowest threshold
    indexed = may[:, :dims].sum(axis=1) if lowest > 0 else np.full(len(x), dims)
    by = np.argsort(-indexed, kind="stable")
    held = x[by]
    filled = np.searchsorted(-indexed[by], -np.arange(dims), side="left")  # list length per dimension
    rows = int(filled[0]) if dims else (len(x) if lowest <= 0 else 0)
    scores = np.zeros((rows, len(q)))
    for d in range(0, dims, STEP):
        n = int(filled[d])
        if n:
            # Rows of shorter lists get their remaining dimensions of this step too; those count as done.
            scores[:n] += held[:n, d : d + STEP] @ q[:, d : d + STEP].T
    done = np.minimum(-(-indexed[by][:rows] // STEP) * STEP, dims)
    left = rx[by[:rows], done]
    alive = scores + left[:, None] * rq[:, done].T * slack >= least[None, :]
    i, j = np.nonzero(alive)
    value = scores[i, j]
    for d in range(0, dims, STEP):
        todo = done[i] <= d
        if not todo.any():
            continue
        e = min(d + STEP, dims)
        if todo.sum() * SPARSE > rows * len(q):
            value = value + np.where(todo, (held[:rows, d:e] @ q[:, d:e].T)[i, j], 0.0)
        else:
            t = np.flatnonzero(todo)
            value[t] += np.einsum("nd,nd->n", held[i[t], d:e], q[j[t], d:e])
        ahead = np.maximum(done[i], e)
        keep = value + rx[by[i], ahead] * rq[j, ahead] * slack >= least[j]
        i, j, value = i[keep], j[keep], value[keep]
    keep = value >= least[j]
    return by[i[keep]], j[keep], value[keep]


def exact_matches(x: np.ndarray, q: np.ndarray, least: np.ndarray):
    """``matches`` for numbers that doubles cannot hold: whole numbers of any size."""
    full = x.astype(object) @ q.astype(np.int64).astype(object).T
    if full.size and max(abs(int(full.max())), abs(int(full.min()))) >= 1 << 63:
        raise OverflowError("a score does not fit into 64 bits")
    i, j = np.nonzero(full >= least[None, :])
    return i, j, full[i, j].astype(np.int64)


def finder(lot: Lot):
    """For ``mapInArrow`` over blocks: the best rows of every window, ``window, id, score``.

    A task keeps at most ``k`` results per window; once a window has as many, only better ones
    are looked for in later blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = len(lot.owner)
        if not windows:
            return
        best: list[list[tuple[int, int]]] = [[] for _ in range(windows)]
        floor = lot.low.copy()
        by_owner = np.argsort(lot.owner, kind="stable")
        starts = np.searchsorted(lot.owner[by_owner], np.arange(len(lot.ids) + 1))
        owned = np.diff(starts)
        most = float(np.abs(lot.q).max(initial=0))
        q = lot.q.astype(np.float64) if most < EXACT else lot.q
        for batch in batches:
            for ids, labels, dims, data in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "dims", "data")), strict=True):
                x, labels = np.frombuffer(data, np.int64).reshape(len(ids), dims), np.array(labels)
                wide = float(dims) * float(np.abs(x).max(initial=0)) * most >= EXACT
                exact = x if wide else x.astype(np.float64)
                for a in range(0, len(lot.ids), ASKING):
                    asking = np.arange(a, min(a + ASKING, len(lot.ids)))
                    # An anchor looks for what its lowest window still needs.
                    least = np.full(len(lot.ids), math.inf)
                    np.minimum.at(least, lot.owner, floor)
                    i, j, score = (exact_matches if wide else matches)(exact, q[asking], least[asking])
                    j, score = asking[j], score.astype(np.int64)
                    fits = (labels[i] == lot.labels[j]) == lot.same
                    i, j, score = i[fits], j[fits], score[fits]
                    # One row per pair and window of its anchor, the best first in each window.
                    n = owned[j]
                    pair = np.repeat(np.arange(len(j)), n)
                    window = by_owner[np.repeat(starts[j] - (np.cumsum(n) - n), n) + np.arange(len(pair))]
                    inside = (score[pair] >= floor[window]) & (score[pair] <= lot.high[window])
                    pair, window = pair[inside], window[inside]
                    sort = np.lexsort((-score[pair], window))
                    pair, window = pair[sort], window[sort]
                    first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
                    for s, e in zip(first, np.r_[first[1:], len(window)], strict=False):
                        w = int(window[s])
                        anchor, found = int(lot.ids[lot.owner[w]]), []
                        for p in pair[s:e]:
                            if len(found) >= lot.k and -int(score[p]) > found[-1][0]:
                                break  # only equal scores could still come before what is held
                            found += [(-int(score[p]), r) for r in ids[i[p]] if not (lot.same and r == anchor)]
                        best[w] = sorted(best[w] + found)[: lot.k]
                        if len(best[w]) == lot.k:
                            floor[w] = max(floor[w], -best[w][-1][0])
        out = [(w, r, -s) for w, held in enumerate(best) for s, r in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["window", "id", "score"])

    return run


def _spread(q: np.ndarray, stats: list[tuple[float, float]]) -> tuple[float, float]:
    """Mean and deviation that scores of this query would have if dimensions were independent."""
    mean = sum(float(a) * m for a, (m, _) in zip(q, stats, strict=True))
    var = sum(float(a) ** 2 * max(s - m * m, 0.0) for a, (m, s) in zip(q, stats, strict=True))
    return mean, math.sqrt(var) or 1.0


def _expected(normal: NormalDist, n: int, above: float) -> float:
    """Score that about ``above`` of ``n`` rows reach."""
    return -math.inf if n <= 2 * above else normal.inv_cdf(1 - above / n)


def mine(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    anchor_every: int = ANCHOR_EVERY, relabel_every: int = RELABEL_EVERY, labels: int = LABELS,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, lot_size: int = LOT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``anchor_every``. A positive is one of an
    anchor's ``positives`` best rows of the same label; its negatives are the best ``negatives``
    rows of other labels that score ``low`` to ``high`` hundredths of it.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no
    part. Ties go to the smaller id. A row repeated with the same id, label and vector counts once;
    rows of one id with different vectors are rows of their own, and none of them is a positive of
    an anchor of that id. Vectors of different lengths are compared as if filled up with zeros.
    Scores beyond 64 bits are an error. Empty table: empty result. Other columns are not read.

    Anchors go to all tasks in lots of ``lot_size``; blocks of vectors are never shuffled, and a
    window's results are few, since its threshold is.
    """
    spark = vectors.sparkSession
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut(taking_part(vectors, id_col, vector_col, label_col, relabel_every, labels))
    distinct = cut(distinct_vectors(rows, max(positives + 1, negatives)))
    stats = moments(distinct)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    anchors = rows.filter(F.col("id") % anchor_every == 0).distinct()
    if not sizes or anchors.isEmpty():
        return spark.createDataFrame([], columns)
    total = sum(sizes.values())
    order = np.argsort([-s for _, s in stats], kind="stable")
    stored = cut(blocks(distinct, order))
    n_lots = max(1, math.ceil(anchors.count() / lot_size))
    out = None
    for lot in range(n_lots):
        asking = anchors.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n_lots)) == lot).orderBy("id", "label", "v").collect()
        found = _mine_lot(stored, asking, stats, order, sizes, total, positives, negatives, low, high)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], columns)


def _search(stored: DataFrame, lot: Lot) -> DataFrame:
    """The ``k`` best of every window over all blocks."""
    best = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return stored.mapInArrow(finder(lot), "window long, id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= lot.k)


def _mine_lot(stored, asking, stats, order, sizes, total, positives, negatives, low, high) -> DataFrame | None:
    if not asking:
        return None
    spark = stored.sparkSession
    dims = len(order)
    plain = np.zeros((len(asking), dims), np.int64)
    for k, r in enumerate(asking):
        plain[k, : len(r["v"])] = r["v"]
    ids, own = np.array([r["id"] for r in asking]), np.array([r["label"] for r in asking])
    normals = [NormalDist(*_spread(q, stats)) for q in plain]
    q = plain[:, order]

    # Positives: everything from a threshold on, which is lowered where too few were found.
    best: dict[int, list[tuple[int, int]]] = {}
    floor = np.array([_expected(d, sizes[c], AIM * positives) for d, c in zip(normals, own.tolist(), strict=True)])
    todo = np.arange(len(ids))
    for turn in range(MAX_ROUNDS + 1):
        if turn == MAX_ROUNDS:
            floor[todo] = -math.inf
        lot = Lot(ids[todo], own[todo], q[todo], True, np.arange(len(todo)), floor[todo], np.full(len(todo), math.inf), positives)
        found: dict[int, list[tuple[int, int]]] = {}
        for r in _search(stored, lot).collect():  # at most ``positives`` rows per anchor of the lot
            found.setdefault(r["window"], []).append((-r["score"], r["id"]))
        short = []
        for w, a in enumerate(todo.tolist()):
            best[a] = sorted(found.get(w, []))
            if len(best[a]) < positives and floor[a] > -math.inf:
                short.append(a)
                floor[a] -= WIDEN**turn * normals[a].stdev / 2
        todo = np.array(short, dtype=np.int64)
        if not len(todo):
            break
    pairs = [(int(ids[a]), p, -s, a) for a, held in best.items() for s, p in held]
    if not pairs:
        return None

    # Negatives: one window per anchor and positive score, filled from its upper end.
    wanted = sorted({(a, s) for _, _, s, a in pairs if -(-low * s // 100) <= high * s // 100})
    if not wanted:
        return None
    owner, score = np.array([a for a, _ in wanted]), [s for _, s in wanted]
    top, end = np.array([high * s // 100 for s in score]), np.array([-(-low * s // 100) for s in score])
    gap = []
    for a, h in zip(owner.tolist(), top.tolist(), strict=True):
        density = total * normals[a].pdf(h)
        gap.append(AIM * negatives / density if density > 1e-12 else math.inf)
    least = np.maximum(end, top - np.ceil(np.minimum(gap, top - end + 1))).astype(np.float64)
    windows = np.arange(len(wanted))
    keys = spark.createDataFrame(
        [(p, s, anchor, at) for anchor, p, s, a in pairs for at in [a]], "positive_id long, positive_score long, anchor_id long, at long"
    )
    kept = None
    for turn in range(MAX_ROUNDS + 1):
        if turn == MAX_ROUNDS:
            least[windows] = end[windows]
        live, place = np.unique(owner[windows], return_inverse=True)
        lot = Lot(ids[live], own[live], q[live], False, place, least[windows], top[windows].astype(np.float64), negatives)
        found = cut(_search(stored, lot))
        filled = {r["window"]: r["count"] for r in found.groupBy("window").count().collect()}
        full = [k for k, w in enumerate(windows.tolist()) if filled.get(k, 0) >= negatives or least[w] <= end[w]]
        names = spark.createDataFrame([(k, int(owner[windows[k]]), score[windows[k]]) for k in full], "window long, at long, positive_score long")
        part = found.join(names, "window").select("at", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        kept = part if kept is None else kept.unionByName(part)
        done = set(full)
        rest = [w for k, w in enumerate(windows.tolist()) if k not in done]
        windows = np.array(rest, dtype=np.int64)
        if not len(windows):
            break
        least[windows] = np.maximum(end[windows], top[windows] - (top[windows] - least[windows]) * WIDEN)
    return keys.join(kept, ["at", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
