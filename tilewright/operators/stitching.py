"""Averaging the logits of overlapping tiles and taking the best class.

Block form: tile edges cut the canvas into rectangles, each covered by a fixed set of tiles. A
rectangle covered by one tile, or only by tiles of the region that a task scores, is decided there
and travels as one byte per pixel; only rectangles that tiles from elsewhere cover too travel as
logits and are added up after the shuffle.

Long form: one row per pixel, tile and class, for logits that are columns already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tilewright.functions.blocks import (
    BLOCK_SCHEMA,
    TILE_SCHEMA,
    batched,
    flat_map,
    iter_rows,
    packed,
    pixels,
)

PIECE_SCHEMA = T.StructType([*BLOCK_SCHEMA.fields, T.StructField("cover", T.IntegerType())])


@lru_cache(maxsize=4096)
def axis_pieces(
    index: int, count: int, tile: int, stride: int, low: int, high: int
) -> list[tuple[int, int, int]]:
    """Ranges ``(start, stop, cover)`` that tile edges cut out of one tile, inside [low, high)."""
    begin, end = index * stride, index * stride + tile
    edges = {begin, end, low, high}
    for other in range(count):
        edges.update((other * stride, other * stride + tile))
    kept = sorted(e for e in edges if max(begin, low) <= e <= min(end, high))
    out = []
    for start, stop in zip(kept, kept[1:], strict=False):
        first = max(0, -(-(start - tile + 1) // stride))
        last = min(count - 1, start // stride)
        out.append((start, stop, last - first + 1))
    return out


def _pieces(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    return tile_pieces(row, pixels(row))


def tile_pieces(
    row: dict[str, Any], logits: np.ndarray, inside: tuple[int, int, int, int] | None = None
) -> Iterator[dict[str, Any]]:
    """The rectangles of one tile, but for those in ``inside`` (top, bottom, left, right on the
    canvas), whose limits are tile edges or the picture's."""
    tile, stride = row["tile"], row["stride"]
    # Only tiles within one tile length can share an edge, which bounds the edges looked at.
    spans = {}
    for axis, index, count, low, size in (
        ("y", row["tile_y"], row["rows"], row["pad_top"], row["image_height"]),
        ("x", row["tile_x"], row["cols"], row["pad_left"], row["image_width"]),
    ):
        reach = -(-tile // stride)
        base = max(0, index - reach)
        spans[axis] = [
            (a + base * stride, b + base * stride, c)
            for a, b, c in axis_pieces(
                index - base,
                min(count, index + reach + 1) - base,
                tile,
                stride,
                low - base * stride,
                low + size - base * stride,
            )
        ]
    for y_start, y_stop, y_cover in spans["y"]:
        for x_start, x_stop, x_cover in spans["x"]:
            if inside and inside[0] <= y_start < inside[1] and inside[2] <= x_start < inside[3]:
                continue
            part = logits[
                y_start - row["y0"] : y_stop - row["y0"], x_start - row["x0"] : x_stop - row["x0"]
            ]
            cover = y_cover * x_cover
            if cover == 1:
                part = np.argmax(part, axis=-1).astype(np.uint8)
            yield {
                "image_id": row["image_id"],
                "tile_y": row["tile_y"],
                "tile_x": row["tile_x"],
                "y0": y_start - row["pad_top"],
                "x0": x_start - row["pad_left"],
                "cover": cover,
                **packed(part),
            }


def _decide(parts: list[dict[str, Any]]) -> dict[str, Any]:
    first = parts[0]
    if first["cover"] == 1:
        return {**first, "data": bytes(first["data"])}
    if len(parts) != first["cover"]:
        raise ValueError(
            f"{first['image_id']} at ({first['y0']}, {first['x0']}): {len(parts)} of "
            f"{first['cover']} tiles arrived"
        )
    total = np.zeros(pixels(first).shape, dtype=np.float32)
    for part in parts:
        total += pixels(part).astype(np.float32)
    average = total / np.float32(len(parts))
    return {**first, **packed(np.argmax(average, axis=-1).astype(np.uint8))}


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold runs of rows with the same rectangle; rows arrive sorted by rectangle and tile."""

    def runs() -> Iterator[dict[str, Any]]:
        run: list[dict[str, Any]] = []
        for row in iter_rows(batches):
            if run and any(run[0][k] != row[k] for k in ("image_id", "y0", "x0")):
                yield _decide(run)
                run = []
            run.append(row)
        if run:
            yield _decide(run)

    return batched(runs(), to_arrow_schema(BLOCK_SCHEMA))


def stitch_tiles(logit_tiles: DataFrame) -> DataFrame:
    """Label blocks in image coordinates from overlapping logit tiles (channels = classes).

    A rectangle has at most ceil(tile / stride) ** 2 contributors. They are added in tile order
    in single precision, so the result does not depend on partitioning.
    """
    return merge_pieces(
        logit_tiles.select(*TILE_SCHEMA.names).mapInArrow(
            flat_map(_pieces, PIECE_SCHEMA), PIECE_SCHEMA
        )
    )


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """Label blocks from rectangles: labels (``cover`` 1), or the logits of every tile on it."""
    keys = ["image_id", "y0", "x0"]
    return (
        pieces.repartition(*keys)
        .sortWithinPartitions(*keys, "tile_y", "tile_x")
        .mapInArrow(_merge_sorted, BLOCK_SCHEMA)
    )


def stitch_long(logits: DataFrame) -> DataFrame:
    """Averaged argmax from rows ``image_id, y, x, class, logit`` (one per covering tile).

    Ties go to the lowest class.
    """
    averaged = logits.groupBy("image_id", "y", "x", "class").agg(
        F.avg(F.col("logit").cast("double")).alias("logit"), F.count(F.lit(1)).alias("cover")
    )
    best = F.max(F.struct("logit", (-F.col("class")).alias("_neg"), "cover")).alias("_best")
    return averaged.groupBy("image_id", "y", "x").agg(best).select(
        "image_id",
        "y",
        "x",
        (-F.col("_best._neg")).cast("int").alias("label"),
        F.col("_best.cover").alias("cover"),
    )
