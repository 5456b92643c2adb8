"""SimHash near-duplicates: deletion-variant signatures, equality join, verification.

A fingerprint has 64 bits and is cut into two segments of 32. Two fingerprints that differ in at
most three bits differ in at most one bit of one segment. So each segment is indexed once as it
is and once per bit position with that bit deleted: fingerprints that meet under a key are
compared bit by bit, and only links are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import components, cut, small
from tilewright.operators.skew import salted_join

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT = 32
#: Shingles whose bits are expanded at a time.
CHUNK = 1 << 15
FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and exactly the separators asked for.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:], strict=False)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype=">u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], schema=FP_SCHEMA
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` per row of ``docs(doc_id, text)``. A null or wordless text has fingerprint 0."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """``key, bit, fp``: per segment the segment itself (``bit`` null) and one key per deleted bit.

    Under a deletion key only fingerprints with different values of the deleted bit matter; those
    with equal ones share the whole segment and meet under its own key.
    """
    spots = F.explode(F.sequence(F.lit(0), F.lit(2 * (SEGMENT + 1) - 1)))
    low = F.lit((1 << SEGMENT) - 1)
    v = distinct.select("fp", spots.alias("spot"))
    side = F.expr(f"spot div {SEGMENT + 1}")
    at = F.expr(f"cast(spot % {SEGMENT + 1} as int)")
    v = v.select("fp", side.alias("side"), at.alias("at"))
    value = F.when(F.col("side") == 0, F.col("fp")).otherwise(F.expr(f"shiftrightunsigned(fp, {SEGMENT})")).bitwiseAND(low)
    v = v.withColumn("value", value)
    mask = F.expr(f"if(at = {SEGMENT}, 0L, shiftleft(1L, at))")
    return v.select(
        F.expr("value").bitwiseAND(F.bitwise_not(mask))
        .bitwiseOR(F.expr("shiftleft(cast(side * 64 + at as bigint), 40)")).alias("key"),
        F.expr(f"if(at = {SEGMENT}, null, cast(shiftrightunsigned(value, at) & 1 as int))").alias("bit"),
        "fp",
    )


def _forest(fps: np.ndarray, bits: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect whatever is linked inside one bucket: at most one per fingerprint.

    A reached fingerprint is compared with those not reached yet, which are soon few in a bucket
    of near copies. ``bits``: only pairs that differ there are looked at.
    """
    found = []
    left = np.arange(len(fps))
    raw = fps.view(np.uint64)
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            near = np.bitwise_count(raw[left] ^ raw[u]) <= DISTANCE
            if bits is not None:
                near &= bits[left] != bits[u]
            if near.any():
                hit = left[near]
                found += [(int(fps[u]), int(fps[v])) for v in hit]
                stack += hit.tolist()
                left = left[~near]
    return found


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may run over several batches."""

    def emit(keys, bits, fps):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out = []
        for s, e in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            b = bits[s:e]
            out += _forest(np.ascontiguousarray(fps[s:e]), None if b[0] < 0 else b)
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE_SCHEMA)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "bit", "fp"))
        last = part[0][-1]
        if held and held[0][0][0] == last:
            held.append(part)
            continue
        joined = tuple(np.concatenate(x) for x in zip(*held, part, strict=True)) if held else part
        at = int(np.flatnonzero(joined[0] != last)[-1]) + 1 if (joined[0] != last).any() else 0
        if at:
            yield from emit(*(x[:at] for x in joined))
        held = [tuple(x[at:] for x in joined)]
    if held:
        yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: verified links that connect the same fingerprints as all links of at most 3 bits."""
    by_key = Window.partitionBy("key")
    meeting = (
        variants(distinct)
        .withColumns({"_n": F.count(F.lit(1)).over(by_key), "_lo": F.min("bit").over(by_key), "_hi": F.max("bit").over(by_key)})
        .filter("_n > 1 and (bit is null or _lo <> _hi)")
        .select("key", F.coalesce("bit", F.lit(-1)).alias("bit"), "fp")
    )
    return meeting.mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs(doc_id, text)``.

    Nulls: a null text has fingerprint zero like any wordless one; a null doc_id keeps its row and
    is never a component's name unless all its ids are null. Empty table: empty result. Repeated
    rows: each gives a row. Copies share a fingerprint and are represented by it once, so no pair
    of copies is formed. Columns other than ``doc_id`` and ``text`` are not read.
    """
    marked = cut(fingerprints(docs))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return salted_join(marked, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all columns of ``docs``.

    Rows that repeat a doc_id that stays are reduced to one. Rows without a doc_id stay: nothing
    names them, so none can be told to be the copy. All columns pass, whatever their names and types;
    texts are read whole. Empty table: empty result.
    """
    # Plain numbers for names, so that no column of the input can clash with the new ones.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = F.col(numbered.columns[docs.columns.index("doc_id")])
    ids = near_duplicates(docs).groupBy("doc_id").agg(
        F.min("component_id").alias("_component"), F.count(F.lit(1)).alias("_times")
    )
    ids = cut(ids.filter("doc_id = _component").select(F.col("doc_id").alias("_kept"), "_times"))
    once = ids.filter("_times = 1").select("_kept")
    more = ids.filter("_times > 1").select("_kept")
    single = numbered.join(once, own == F.col("_kept"), "left_semi")
    repeated = numbered.join(more, own == F.col("_kept"), "left_semi")
    # Any column can be part of the JSON form, also those that have no order.
    form = F.to_json(F.struct(*numbered.columns))
    w = Window.partitionBy(own).orderBy(F.xxhash64("_form"), "_form")
    repeated = repeated.withColumn("_form", form).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_form")
    return single.unionByName(repeated).unionByName(numbered.filter(own.isNull())).toDF(*docs.columns)
