"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of equal size. Block k of a source with weight w is released at
slot floor((k - 1) / w) and due at slot ceil(k / w); each slot goes to the released block that is
due first. Weights are whole parts of a period that grows with the number of slots, so that
rounding adds less than ``ROUNDING`` blocks in a phase. When a source runs out, a new phase begins
with the weights of the others. In each phase no source is off its target by more than one block
and that rounding at any time.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut

#: Characters in a block; a longer document fills several.
BLOCK_CHARS = 100_000
#: Weights are whole parts of this many slots at least.
PERIOD = 1000
#: Blocks that rounding of weights to whole parts may add to a source's deviation in a phase.
ROUNDING = 1e-3
#: Weights by default: shares of characters to this power, so that large sources are held back.
POWER = 0.5
#: One row per source comes to the driver; more sources are an error.
MAX_SOURCES = 500
#: A source is ordered in chunks, so that a large one is never sorted in one task.
CHUNKS = 256
ADDED = ("phase", "block", "release", "deadline", "slot", "at")


class Slot(NamedTuple):
    slot: int
    source: int
    block: int  # from 1
    release: int
    deadline: int


def parts(weights: list[float], period: int) -> list[int]:
    """Whole parts of ``period`` by largest remainder, at least one each."""
    total = sum(weights)
    exact = [w * period / total for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    by_rest = sorted(range(len(out)), key=lambda i: (math.floor(exact[i]) - exact[i], i))
    for i in by_rest[: max(0, period - sum(out))]:
        out[i] += 1
    while sum(out) > period:
        i = max(range(len(out)), key=lambda i: (out[i] / max(exact[i], 1e-300) if out[i] > 1 else -1, -i))
        out[i] -= 1
    return out


def schedule(shares: list[int], blocks: list[int] | None = None) -> list[Slot]:
    """Slots for ``shares[i]`` blocks of each source in a period, earliest deadline first.

    The shares add up to the period, so every slot is filled and every deadline kept. Ties are
    broken as Pfair needs it: a block whose window overlaps the next one first, then the one
    whose run of such windows ends later, then the smaller number. With ``blocks`` the schedule
    ends when one source has placed that many, else after the period.
    """
    period = sum(shares)

    def window(i: int, k: int) -> tuple[int, int]:
        return (k - 1) * period // shares[i], -(-k * period // shares[i])

    def entry(i: int, k: int) -> tuple:
        release, due = window(i, k)
        overlap = k * period % shares[i] != 0
        # The group deadline: where a run of tight windows of a heavy source ends.
        rest = period - shares[i]
        group = -(-(-(-due * rest // period)) * period // rest) if rest and rest <= shares[i] else 0
        return due, 0 if overlap else 1, -group, i, k, release

    waiting: defaultdict[int, list[tuple]] = defaultdict(list)
    for i, n in enumerate(shares):
        if n:
            waiting[0].append(entry(i, 1))
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        for e in waiting.pop(slot, ()):
            heapq.heappush(ready, e)
        due, _, _, i, k, release = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append(Slot(slot, i, k, release, due))
        if blocks and k == blocks[i]:
            break
        if k < shares[i]:
            following = entry(i, k + 1)
            waiting[max(slot + 1, following[-1])].append(following)
    return out


class Phase(NamedTuple):
    number: int
    first_slot: int
    slots: int
    used: dict[int, int]  # blocks of each source taken before it
    shares: dict[int, Fraction]  # of its slots
    order: list[Slot]


def phases(blocks: list[int], weights: list[float], period: int = PERIOD) -> list[Phase]:
    """Phases until all ``blocks`` of every source are placed. One per source at most."""
    used = dict.fromkeys(range(len(blocks)), 0)
    out, first = [], 0
    live = [i for i, n in enumerate(blocks) if n]
    while live:
        left = [blocks[i] - used[i] for i in live]
        # A source gets a part more or less than its weight, or as many less as others were raised to one.
        fine = max(period, math.ceil(sum(left) * len(live) / ROUNDING))
        shares = parts([weights[i] for i in live], fine)
        order = [s._replace(source=live[s.source]) for s in schedule(shares, left)]
        share = {i: Fraction(n * len(order), fine) for i, n in zip(live, shares, strict=True)}
        out.append(Phase(len(out), first, len(order), {i: used[i] for i in live}, share, order))
        for s in order:
            used[s.source] += 1
        first += len(order)
        live = [i for i in live if used[i] < blocks[i]]
    return out


def _key(docs: DataFrame) -> Column:
    """Order inside a source: a shuffle that depends on the row alone."""
    return F.xxhash64(F.lit(29), "doc_id", "text")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` and what the mix takes from a text: ``_key`` and ``_size``."""
    return docs.withColumns({"_key": _key(docs), "_size": F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")})


def numbered(docs: DataFrame, block_chars: int) -> DataFrame:
    """Measured ``docs`` and ``_name`` (source, null as its own), ``_block`` from 0 and ``_at`` within the source.

    Running sums go chunk by chunk: only chunk totals of a source come together.
    """
    keyed = docs.withColumn("_name", F.struct(F.col("source").cast("string").alias("source"))).withColumn("_chunk", F.pmod(F.shiftright("_key", 40), F.lit(CHUNKS)))
    totals = keyed.groupBy("_name", "_chunk").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_name").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_name", "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_name", "_chunk").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = summed.join(starts, ["_name", "_chunk"]).withColumn("_at", F.col("_before") + F.col("_inside"))
    return placed.withColumn("_block", F.expr(f"_at div {block_chars}")).drop("_chunk", "_before", "_inside")


def plan(docs: DataFrame, *, weights: dict[str | None, float] | None, block_chars: int, period: int) -> tuple[list[str | None], list[Phase]]:
    sizes = (docs if "_size" in docs.columns else measured(docs)).groupBy("source").agg(F.sum("_size").alias("n"))
    found = sizes.select(F.col("source").cast("string"), "n").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    names = [r["source"] for r in found]
    given = weights or {r["source"]: r["n"] ** POWER for r in found}
    missing = [n for n in names if not given.get(n, 0) > 0]
    if missing:
        raise ValueError(f"no positive weight for sources {missing}")
    # The last block may be part-filled. Empty ones, inside a longer document, keep their slots.
    blocks = [-(-r["n"] // block_chars) for r in found]
    return names, phases(blocks, [given[n] for n in names], period)


def mix(
    docs: DataFrame, *, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD
) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, source)`` with ``phase, block, release, deadline,
    slot, at``: rows are to be read by ``slot``, then ``at``.

    ``weights``: target shares per source, by characters; all sources need one. By default shares
    follow size to the power ``POWER``. ``release`` and ``deadline`` count slots in the phase. A
    block is all documents that begin in it. Nulls: a null source is a source of its own, a null or
    empty text counts one character. Ties and repeated rows: ordered by hash, then id. Empty table:
    empty result. Columns of the same names are replaced.
    """
    docs = docs.drop(*ADDED)
    return place(measured(docs), weights=weights, block_chars=block_chars, period=period).select(*docs.columns, *ADDED)


def place(
    docs: DataFrame, *, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD
) -> DataFrame:
    """``mix`` of measured rows, which need ``doc_id`` and ``source`` but no text."""
    spark = docs.sparkSession
    names, found = plan(docs, weights=weights, block_chars=block_chars, period=period)
    # One row per source and phase, and one per slot: a slot stands for ``block_chars`` characters.
    starts = [(p.number, names[i], p.used[i], p.first_slot) for p in found for i in p.shares]
    table = [(p.number, names[s.source], s.block - 1, s.slot, s.release, s.deadline) for p in found for s in p.order]
    start = spark.createDataFrame(starts, "phase int, _source string, _used long, _first long")
    slots = spark.createDataFrame(table, "_phase int, _source2 string, _k long, _slot long, _release long, _due long")
    rows = numbered(docs, block_chars)
    # The phase of a block is the last one of its source that begins at or before it.
    ends = Window.partitionBy("_source").orderBy("phase")
    start = start.withColumn("_until", F.lead("_used").over(ends))
    start = start.filter(F.col("_until").isNull() | (F.col("_until") > F.col("_used")))
    placed = rows.join(
        F.broadcast(start),
        F.col("_name.source").eqNullSafe(F.col("_source")) & (F.col("_block") >= F.col("_used")) & (F.col("_until").isNull() | (F.col("_block") < F.col("_until"))),
    )
    placed = placed.join(
        F.broadcast(slots),
        (F.col("phase") == F.col("_phase")) & F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_block") - F.col("_used") == F.col("_k")),
    )
    return placed.select(
        *docs.columns, "phase", F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_due").alias("deadline"),
        (F.col("_first") + F.col("_slot")).alias("slot"), F.col("_at").alias("at"),
    )


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as it is, its rows in the order of the mix: files and rows in them follow the slots.

    All columns pass, whatever their names; otherwise as ``mix``.
    """
    needed = ("doc_id", "source", "text")
    # Plain numbers for the other names, so that no column of the input can clash with the new ones.
    numbered = docs.toDF(*[c if c in needed else f"c{i}" for i, c in enumerate(docs.columns)])
    mixed = mix(numbered, **options).repartitionByRange("slot", "at").sortWithinPartitions("slot", "at")
    return mixed.select(*numbered.columns).toDF(*docs.columns)


def report(docs: DataFrame, **options) -> DataFrame:
    """The schedule per document, without the texts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return mix(narrow, **options).drop("text")
