"""Numpy helpers for rows that carry a rectangle of pixels as bytes.

An *image* row holds a whole picture, a *block* row one rectangle of it. ``data`` is row-major,
channel last, ``dtype`` is ``uint8``, ``uint16`` or ``float32``. The helpers below run inside
``mapInArrow`` tasks; Spark decides which rows meet in which task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

IMAGE_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("tile_y", T.IntegerType()),
        T.StructField("tile_x", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)

# A tile is a block of the padded canvas; the extra fields say how to get back to the image.
TILE_SCHEMA = T.StructType(
    BLOCK_SCHEMA.fields
    + [
        T.StructField(name, T.IntegerType())
        for name in ("image_height", "image_width", "rows", "cols", "tile", "stride", "pad_top", "pad_left")
    ]
)

# Several workers of an executor hold such batches at once, in steps that follow each other.
OUTPUT_BATCH_BYTES = 4 << 20
OUTPUT_BATCH_ROWS = 4096


def pixels(row: dict[str, Any]) -> np.ndarray:
    """The pixels of a row as (height, width) or (height, width, channels)."""
    flat = np.frombuffer(row["data"], dtype=np.dtype(row["dtype"]))
    if row["channels"] == 1:
        return flat.reshape(row["height"], row["width"])
    return flat.reshape(row["height"], row["width"], row["channels"])


_dtype_name = lru_cache(maxsize=None)(lambda dtype: dtype.name)


def packed(array: np.ndarray) -> dict[str, Any]:
    """Row fields describing ``array``."""
    return {
        "height": array.shape[0],
        "width": array.shape[1],
        "channels": 1 if array.ndim == 2 else array.shape[2],
        "dtype": _dtype_name(array.dtype),
        "data": array.tobytes(),
    }


def iter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """Rows of Arrow batches as dictionaries, one at a time; bytes stay views on the batch."""
    for batch in batches:
        names = batch.schema.names
        columns = [_views(c) if _is_bytes(c.type) else c.to_pylist() for c in batch.columns]
        for cells in zip(*columns, strict=True):
            yield dict(zip(names, cells, strict=True))


def _is_bytes(kind: pa.DataType) -> bool:
    return pa.types.is_binary(kind) or pa.types.is_large_binary(kind)


def _views(column: pa.Array) -> Iterator[pa.Buffer | None]:
    return (cell.as_buffer() if cell.is_valid else None for cell in column)


def batched(rows: Iterator[dict[str, Any]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pack rows into Arrow batches that stay small in bytes as well as in rows."""
    heavy = [f.name for f in schema if _is_bytes(f.type)]
    waiting: list[dict[str, Any]] = []
    size = 0
    for row in rows:
        waiting.append(row)
        for name in heavy:
            size += len(row[name] or b"")
        if size >= OUTPUT_BATCH_BYTES or len(waiting) >= OUTPUT_BATCH_ROWS:
            yield _batch(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield _batch(waiting, schema)


def _batch(rows: list[dict[str, Any]], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array([r[f.name] for r in rows], type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def flat_map(fn: Callable[[dict[str, Any]], Iterator[dict[str, Any]]], schema: T.StructType):
    """Turn a row -> rows function into a function for ``mapInArrow``."""
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for row in iter_rows(batches) for out in fn(row)), arrow_schema)

    return run


CODE_COUNTS = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("code", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)


def count_codes(codes: Callable[[dict[str, Any]], np.ndarray]):
    """For ``mapInArrow``: ``image_id, code, n`` of small non-negative codes per row.

    Neighbouring rows of one image are added up before anything leaves the task, and results are
    built as columns.
    """
    schema = to_arrow_schema(CODE_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, total = None, np.zeros(0, dtype=np.int64)
        done: list[tuple[str, np.ndarray, np.ndarray]] = []
        held = 0

        def close() -> None:
            nonlocal held
            found = np.flatnonzero(total)
            if len(found):
                done.append((image, found, total[found]))
                held += len(found)

        for row in iter_rows(batches):
            if row["image_id"] != image:
                close()
                image, total = row["image_id"], np.zeros(0, dtype=np.int64)
                if held >= OUTPUT_BATCH_ROWS:
                    yield _columns(done, schema)
                    done, held = [], 0
            counts = np.bincount(codes(row), minlength=len(total))
            counts[: len(total)] += total
            total = counts
        close()
        if done:
            yield _columns(done, schema)

    return run


def _columns(parts: list[tuple[str, np.ndarray, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    lengths = [len(p[1]) for p in parts]
    places = np.repeat(np.arange(len(parts)), lengths)
    names = pa.array([p[0] for p in parts], type=pa.string()).take(pa.array(places))
    return pa.RecordBatch.from_arrays(
        [
            names,
            pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)),
            pa.array(np.concatenate([p[2] for p in parts])),
        ],
        schema=schema,
    )
