"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import mixing
from tilewright.llm.common import cut, small
from tilewright.llm.tokens import encoder

LIMIT = 2048
END_ID = 0
#: Pieces packed together in one group. A group leaves at most a few sequences part-filled.
GROUP_PIECES = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Slots whose pieces are counted together before running sums are taken.
SLOT_CHUNK = 1024


def pieces(docs: DataFrame, path: str, *, end_id: int = END_ID, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: whole documents, cut only if longer than ``limit``.

    ``with_ids`` adds ``ids``, the tokens themselves. A null text gives the end token alone.
    """
    columns = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in small(batches):
            out: list[list] = [[] for _ in columns.split(", ")]
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                tokens = np.append(ids, end_id).astype("<u4")
                for n, s in enumerate(range(0, len(tokens), limit)):
                    part = tokens[s : s + limit]
                    row = (doc_id, n, s, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names[: len(out)]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, columns)


def held_pieces(docs: DataFrame, path: str, *, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` but ``text``, and the ``pieces`` of a document in one array."""
    kept = [f for f in docs.schema if f.name != "text"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in small(batches):
            ends, out = [0], [[] for _ in names]
            for ids in encode(batch.column("text").to_pylist()):
                tokens = np.append(ids, end_id).astype("<u4")
                for n, s in enumerate(range(0, len(tokens), limit)):
                    part = tokens[s : s + limit]
                    for column, value in zip(out, (n, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                ends.append(len(out[0]))
            held = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), held], names=[*columns, "pieces"])

    columns = [f.name for f in kept]
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{declared}, pieces array<struct<piece: int, start: long, length: long, ids_crc32: long>>")


def measured_pieces(docs: DataFrame, path: str, *, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """One row per document of ``docs(doc_id, text, source)``: ``doc_id``, what ``mixing.place`` needs, and its ``pieces``."""
    narrow = mixing.measured(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "_key", "_size", F.col("text").cast("string").alias("text")
    )
    return held_pieces(narrow, path, end_id=end_id, limit=limit)


class Pool:
    """Unpacked items by length; a bit per length that still has items."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.items: dict[int, list[int]] = {}
        self.mask = 0
        for i in range(len(lengths) - 1, -1, -1):
            self.put(int(lengths[i]), i)

    def put(self, length: int, item: int) -> None:
        self.items.setdefault(length, []).append(item)
        self.mask |= 1 << length

    def take(self, length: int) -> int:
        of = self.items[length]
        item = of.pop()
        if not of:
            self.mask ^= 1 << length
        return item

    def largest(self, at_most: int) -> int:
        """Largest length that fits, 0 if none."""
        return max(0, (self.mask & ((2 << at_most) - 1)).bit_length() - 1)

    def best_pair(self, room: int, above: int) -> tuple[int, int] | None:
        """Two items whose sum is the largest one in ``(above, room]``."""
        best, pair = above, None
        a = self.largest(room - 1)
        while 2 * a > best and best < room:
            b = self.largest(min(a, room - a))
            if b == a and len(self.items[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
            a = self.largest(a - 1)
        return pair


def best_two_fit(lengths: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Bins of item numbers. ``lengths`` are from 1 to ``limit``.

    A bin takes the largest item that fits, again and again. When nothing fits, its smallest
    item is given back for two unpacked ones that fill the widened gap better, while that helps.
    """
    pool, bins = Pool(lengths), []
    while pool.mask:
        held: list[tuple[int, int]] = []
        room = limit
        while True:
            while room and (n := pool.largest(room)):
                held.append((n, pool.take(n)))
                room -= n
            if not room or not pool.mask:
                break
            small = min(held)
            pair = pool.best_pair(room + small[0], small[0])
            if not pair:
                break
            held.remove(small)
            for n in pair:
                held.append((n, pool.take(n)))
            pool.put(*small)
            room += small[0] - sum(pair)
        bins.append([i for _, i in held])
    return bins


def positions(parts: DataFrame) -> DataFrame:
    """``parts(slot, at, doc_id, piece)`` and ``_at``, their number in that order from 0.

    Rows of a slot are few (about a block of characters); before them only counts per slot and
    per ``SLOT_CHUNK`` slots are added up.
    """
    counts = parts.groupBy("slot").agg(F.count("*").alias("_n")).withColumn("_chunk", F.expr(f"slot div {SLOT_CHUNK}"))
    totals = counts.groupBy("_chunk").agg(F.sum("_n").alias("_sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_chunk", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_chunk"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("_chunk").orderBy("slot"))), F.lit(0))
    first = counts.withColumn("_inside", inside).join(starts, "_chunk").select("slot", (F.col("_before") + F.col("_inside")).alias("_first"))
    own = Window.partitionBy("slot").orderBy("at", "doc_id", "piece", "ids_crc32")
    return parts.withColumn("_own", F.row_number().over(own) - 1).join(first, "slot").withColumn("_at", F.col("_first") + F.col("_own")).drop("_own", "_first")


def pack(parts: DataFrame, *, limit: int = LIMIT, group_pieces: int = GROUP_PIECES, in_order: bool = False) -> DataFrame:
    """``parts`` (with ``length``) and their ``sequence_id`` and gapless ``offset``.

    Rows are dealt by number to groups of about ``group_pieces``, whatever they hold, and each
    group is packed on its own; its rows are lengths, not tokens. Repeated rows are packed each.
    Nulls: ``length`` must not be null; other columns may be. Empty table: empty result. Columns
    of the names ``sequence_id`` and ``offset`` are replaced.

    ``in_order``: parts have ``slot`` and ``at`` of a mix, which go. Groups are then contiguous
    ranges of that order, of exactly ``group_pieces`` but for the last, and ``sequence_id`` follows
    it: by group, and inside a group by the place of the longest piece of each sequence.
    """
    parts = cut(parts.drop("sequence_id", "offset"))
    if in_order:
        dealt = positions(parts).withColumn("_group", F.expr(f"_at div {group_pieces}"))
    else:
        groups = max(1, math.ceil(parts.count() / group_pieces))
        # The stored table has one fixed order, so the numbers are the same when a task runs again.
        dealt = parts.withColumn("_at", F.monotonically_increasing_id()).withColumn(
            "_group", F.pmod(F.xxhash64("_at"), F.lit(groups))
        )
    kept = [f for f in parts.schema if not (in_order and f.name in ("slot", "at"))]
    names = [f.name for f in kept]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_at", "ascending")])
        lengths = table.column("length").to_numpy()
        group = table.column("_group")[0].as_py()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins = best_two_fit(lengths, limit)
        if in_order:
            at = table.column("_at").to_numpy()
            # Items are numbered by falling length, so the first number is the longest piece.
            bins.sort(key=lambda held: at[min(held)])
        for n, held in enumerate(bins):
            sequence[held] = (group << 32) + n
            offset[held] = np.cumsum(lengths[held]) - lengths[held]
        return table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return dealt.groupBy("_group").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, *, end_id: int = END_ID, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Documents tokenised, cut where longer than ``limit``, and packed."""
    return pack(pieces(docs, path, end_id=end_id, limit=limit, with_ids=with_ids), limit=limit)


def pack_mixed(
    docs: DataFrame, path: str, *, end_id: int = END_ID, limit: int = LIMIT, group_pieces: int = GROUP_PIECES, **options
) -> DataFrame:
    """``docs(doc_id, text, source)`` tokenised and packed so that ``sequence_id`` follows their mix.

    The mix depends on the rows alone, so it is derived again here; texts are not moved for it.
    ``options`` are those of ``mixing.mix``.
    """
    placed = mixing.place(cut(measured_pieces(docs, path, end_id=end_id, limit=limit)), **options)
    parts = placed.select("doc_id", F.explode("pieces").alias("p"), "slot", "at").select("doc_id", "p.*", "slot", "at")
    return pack(parts, limit=limit, group_pieces=group_pieces, in_order=True)


#: Rows of a file whose pieces are counted together.
ROWS_SLOT = 1024


def stored_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, slot, at``: the order of the rows in their files, and of the files by name.

    Rows that come from no file keep the order of partitions.
    """
    narrow = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select(*narrow, place["file_path"].alias("_file"), place["row_index"].alias("at"))
    except AnalysisException:
        rows = cut(docs.select(*narrow)).withColumn("_at", F.monotonically_increasing_id())
        return rows.select("doc_id", "text", F.expr(f"_at div {ROWS_SLOT}").alias("slot"), F.col("_at").alias("at"))
    files = rows.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")))
    # A file has less than 2 ** 34 rows. Positions count slots, so gaps between their numbers do no harm.
    slot = F.shiftleft(F.col("_number").cast("long"), 24) + F.expr(f"at div {ROWS_SLOT}")
    return rows.join(F.broadcast(files), "_file").select("doc_id", "text", slot.alias("slot"), "at")


def pack_stored(docs: DataFrame, path: str, *, end_id: int = END_ID, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``docs(doc_id, text)`` tokenised and packed so that ``sequence_id`` follows their order in storage."""
    held = cut(held_pieces(stored_order(docs), path, end_id=end_id, limit=limit))
    parts = held.select("doc_id", F.explode("pieces").alias("p"), "slot", "at").select("doc_id", "p.*", "slot", "at")
    return pack(parts, limit=limit, group_pieces=group_pieces, in_order=True)
