"""Token ids as canonical length-limited Huffman codes in block files.

A file holds one run of documents, is self-contained and is laid out like this (little-endian):

    8 bytes    magic ``HUFIDS01``
    8 x u32    documents, ids per block, ids per checkpoint, blocks, vocabulary size, bytes of the
               packed code lengths, 1 if a document has no id, 0
    u64        ids
    bytes      zlib-packed code lengths, one byte per vocabulary entry (0: not used)
    i64 each   doc_id per document; then, if flagged, one byte each: 1 for a null doc_id
    u32 each   ids per document
    u64 each   first byte of each block, counted from the payload
    u32 each   bit offset of every checkpoint in its block
    bytes      payload; each block starts on a byte and is decoded without any other

Codes follow from the lengths alone: shorter first, then smaller ids first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut, drop_folder, read_files, shared_folder, small, write_shared
from tilewright.llm.tokens import encoder

MAGIC = b"HUFIDS01"
HEAD = struct.Struct("<8s8IQ")
MAX_BITS = 16
BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 1 << 9
#: Ids of one file; a longer document has a file to itself.
SEGMENT_IDS = 2_000_000
#: Ids whose bits are placed at a time.
STEP_IDS = 1 << 20
SEGMENT = "shard int, segment int, doc_ids array<long>, lengths array<long>, ids binary, counted array<struct<id:int, n:long>>"
SUFFIX = ".huf"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code length per symbol with none above ``limit`` (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        is_leaf.append(by_weight < len(leaves))
    taken = 2 * len(leaves) - 2
    for leaf in reversed(is_leaf):
        n = int(leaf[:taken].sum())
        lengths[order[:n]] += 1
        taken = 2 * (taken - n)
    lengths[order[:taken]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, as an integer of ``lengths`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=0))
    # In units of the longest code, each code starts where the one before it ends.
    sizes = np.int64(1) << (top - lengths[order].astype(np.int64))
    starts = np.cumsum(sizes) - sizes
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = starts >> (top - lengths[order].astype(np.int64))
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of one block, and the bit offset of each checkpoint."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    # A code of at most 16 bits lies in two neighbouring 32-bit words.
    wide = codes[ids] << (64 - (at & 31) - size)
    wide = wide.view(np.uint64)
    word = at >> 5
    firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    words[word[firsts]] += np.add.reduceat(wide >> np.uint64(32), firsts)
    words[word[firsts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), firsts)
    data = words.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3]
    return data, at[::CHECKPOINT_IDS]


def encode_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
    codes, bits = canonical_codes(lengths), lengths
    blocks, checks = [], []
    for s in range(0, len(ids), BLOCK_IDS):
        data, at = encode_block(ids[s : s + BLOCK_IDS], codes, bits)
        blocks.append(data)
        checks.append(at)
    packed = zlib.compress(lengths.tobytes(), 9)
    null = np.array([d is None for d in doc_ids], np.uint8)
    starts = np.cumsum([0, *map(len, blocks)])[: len(blocks)]
    yield HEAD.pack(MAGIC, len(doc_ids), BLOCK_IDS, CHECKPOINT_IDS, len(blocks), len(lengths), len(packed), int(null.any()), 0, len(ids))
    yield packed
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    if null.any():
        yield null.tobytes()
    yield counts.astype("<u4").tobytes()
    yield starts.astype("<u8").tobytes()
    yield np.concatenate([*checks, np.zeros(0, np.int64)]).astype("<u4").tobytes()
    yield from blocks


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and code length for every value of the next ``top`` bits."""
    top = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = np.int64(1) << (top - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << top, np.int64)
    steps = np.ones(1 << top, np.int64)
    n = int(sizes.sum())
    symbols[:n], steps[:n] = np.repeat(order, sizes), np.repeat(lengths[order], sizes)
    return symbols, steps, top


def decode_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a file.

    All checkpoints advance together, one id at a time, through the table.
    """
    magic, docs, block, check, blocks, vocab, packed, flagged, _, total = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    lengths = np.frombuffer(zlib.decompress(content[at : at + packed]), np.uint8)
    at += packed

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    doc_ids = read("<i8", docs).tolist()
    if flagged:
        doc_ids = [None if f else d for d, f in zip(doc_ids, read("u1", docs), strict=True)]
    counts = read("<u4", docs).astype(np.int64)
    starts = read("<u8", blocks).astype(np.int64)
    if not total:
        return doc_ids, counts, np.zeros(0, np.int64)
    first = np.arange(0, total, block)
    per = -(-np.minimum(block, total - first) // check)
    n_checks = int(per.sum())
    offsets = read("<u4", n_checks).astype(np.int64)
    raw = np.frombuffer(content, np.uint8, offset=at)
    raw = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    symbols, steps, top = decode_table(lengths)
    own = np.repeat(np.arange(blocks), per)
    in_block = np.arange(n_checks) - (np.cumsum(per) - per)[own]
    begin = first[own] + in_block * check
    todo = np.minimum(check, np.minimum(first[own] + block, total) - begin)
    pos = starts[own] * 8 + offsets
    out = np.zeros((int(todo.max()), n_checks), np.int32)
    for step in range(out.shape[0]):
        if step and (done := todo <= step).any():
            live = ~done
            pos = np.where(live, pos, 0)
        key = (windows[pos >> 3] >> (32 - top - (pos & 7)).astype(np.uint32)) & np.uint32((1 << top) - 1)
        out[step] = symbols[key]
        pos = pos + steps[key]
    ids = np.zeros(total, np.int64)
    lanes = out.T
    full = todo == check
    ids_at = begin[:, None] + np.arange(out.shape[0])[None, :]
    if out.shape[0] == check and full.any():
        ids[ids_at[full].ravel()] = lanes[full].ravel()
    for lane in np.flatnonzero(~full):
        ids[begin[lane] : begin[lane] + todo[lane]] = lanes[lane, : todo[lane]]
    return doc_ids, counts, ids


def _tokenise(path: str, end_id: int, kind: str, segment_ids: int):
    """Rows of documents in order to segments of ids, and one row of counts per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        shard = TaskContext.get().partitionId()
        counts = np.zeros(0, np.int64)
        docs, lengths, held, size, n = [], [], [], 0, 0

        def row(doc_ids, sizes, data, counted, number):
            schema = pa.schema([
                ("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
                ("counted", pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))),
            ])
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((shard, number, doc_ids, sizes, data, counted), schema, strict=True)],
                schema=schema,
            )

        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                tokens = np.append(ids, end_id).astype(kind)
                docs.append(doc_id)
                lengths.append(len(tokens))
                held.append(tokens)
                size += len(tokens)
                if size >= segment_ids:
                    joined = np.concatenate(held)
                    found = np.bincount(joined)
                    if len(found) > len(counts):
                        found, counts = counts, found
                    counts[: len(found)] += found
                    yield row(docs, lengths, joined.tobytes(), None, n)
                    docs, lengths, held, size, n = [], [], [], 0, n + 1
        if docs:
            joined = np.concatenate(held)
            found = np.bincount(joined)
            if len(found) > len(counts):
                found, counts = counts, found
            counts[: len(found)] += found
            yield row(docs, lengths, joined.tobytes(), None, n)
        if counts.any():
            yield row(None, None, None, [{"id": int(i), "n": int(counts[i])} for i in np.flatnonzero(counts)], -1)

    return run


def write_tokens(
    docs: DataFrame, path: str, folder: str, *, end_id: int = 2, max_bits: int = MAX_BITS, segment_ids: int = SEGMENT_IDS
) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order as block files in ``folder``.

    Returns ``shard, segment, n_docs, n_ids, start`` per file, in whose order the ids go on;
    ``start`` counts the ids of all files before it. Nulls: a null text is its end token alone, a
    null doc_id comes first. Repeated ids are ordered by text. Empty table: no file.

    Each text is tokenised once. The ids wait in a table in the shared folder until the counts of
    all of them are known; of the counts, only one row per vocabulary entry reaches the driver.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    held = shared_folder(spark, "token-ids")
    vocabulary = encoder(path).tokenizer.get_vocab_size()
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    (
        narrow.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        .mapInArrow(_tokenise(path, end_id, kind, segment_ids), SEGMENT)
        .write.option("compression", "zstd").parquet(held)
    )
    stored = spark.read.parquet(held)
    counted = (
        stored.filter("segment < 0").select(F.explode("counted").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    )
    totals = {r["id"]: r["n"] for r in counted.collect()}
    counts = np.zeros(max(totals, default=0) + 1, np.int64)
    counts[list(totals)] = list(totals.values())
    lengths = spark.sparkContext.broadcast(code_lengths(counts, max_bits))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                ids = np.frombuffer(row["ids"], kind).astype(np.int64)
                name = f"{folder}/shard-{row['shard']:06d}-{row['segment']:06d}{SUFFIX}"
                write_shared(name, encode_file(row["doc_ids"], sizes, ids, lengths.value))
                out.append((row["shard"], row["segment"], len(sizes), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    names=["shard", "segment", "n_docs", "n_ids"],
                )

    written = cut(
        stored.filter("segment >= 0").select("shard", "segment", "doc_ids", "lengths", "ids")
        .mapInArrow(encode, "shard int, segment int, n_docs long, n_ids long")
    )
    drop_folder(spark, held)
    # One row per shard goes through the window over all of them, one per file through the other.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = written.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = written.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return placed.join(shards, "shard").select(
        "shard", "segment", "n_docs", "n_ids", (F.col("_before") + F.col("_inside")).alias("start")
    )


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Documents read back from block files: ``shard, segment, doc_id, in_file, n_tokens, ids_crc32``
    and, if asked for, ``ids``."""
    columns = "shard int, segment int, doc_id long, in_file long, n_tokens long, ids_crc32 long"
    columns += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                shard, segment = map(int, path.removesuffix(SUFFIX).rsplit("-", 2)[1:])
                doc_ids, counts, ids = decode_file(content)
                stops = np.cumsum(counts)
                raw = ids.astype("<u4")
                parts = [raw[e - n : e] for n, e in zip(counts, stops, strict=True)]
                values = [
                    [shard] * len(parts), [segment] * len(parts), doc_ids, stops - counts, counts,
                    [zlib.crc32(p) for p in parts],
                ] + ([[p.astype(np.int32) for p in parts]] if with_ids else [])
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["shard", "segment", "doc_id", "in_file", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds, strict=False)], names=names[: len(values)]
                )

    return read_files(spark, folder, SUFFIX).mapInArrow(run, columns)


def round_trip(docs: DataFrame, path: str, folder: str, *, end_id: int = 2, **options) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files written to ``folder``."""
    spark = docs.sparkSession
    files = cut(write_tokens(docs, path, folder, end_id=end_id, **options))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder).join(files, ["shard", "segment"]).select(
        "doc_id", (F.col("start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
